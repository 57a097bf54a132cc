"""Training corpus pipeline: reject toxic documents, drop near copies, mix sources, encode and decode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.bpe import encode_and_decode
from transcript_jobs.llm.near_duplicates import Settings, near_duplicates
from transcript_jobs.llm.queries import MIX, digest, table
from transcript_jobs.llm.source_mix import free_names, mix_sources
from transcript_jobs.llm.toxicity import fit, score_toxicity
from transcript_jobs.plans.scratch import Scratch

#: A document with this toxicity or more goes.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; rows with null texts or ids are judged by their (empty) texts.

    Repeated rows are judged alike. Other columns pass through, whatever their names.
    """
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, scorer, below=TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Documents without words, or with a null id, are in no group and stay. Rows that
    repeat an id are judged by their own texts; rows equal in id and text are one
    document and stay together. Other columns pass through, whatever their names.
    """
    found = near_duplicates(docs, Settings(words=5, percent=80))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_text"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at random so that sources take their target weights, in shuffled order.

    Null and empty texts are documents like any other; rows with equal ids are repeated
    as often as each other; null sources count with the others. Other columns pass
    through, whatever their names.
    """
    copy_col, order_col = free_names(docs.columns, "copy", "mix_key")
    return mix_sources(docs, MIX, other_weight=1.0, copy_col=copy_col, order_col=order_col).drop(copy_col, order_col)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each row.

    Null texts are empty and have no tokens; null ids and repeated rows pass through;
    other columns are left out.
    """
    return digest(encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", reject_toxic), ("near copies", drop_near_copies), ("source mix", mix), ("bpe", encode)]

#: The stages include a language model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
