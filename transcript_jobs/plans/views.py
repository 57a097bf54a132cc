"""Stand-in views of transcript studies on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, title, description, transcript, label, is_long."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("video_id"),
        F.col("source").alias("title"),
        F.col("text").alias("description"),
        F.col("text").alias("transcript"),
        F.when(F.col("toxic") == 1, "fake").otherwise("real").alias("label"),
        F.when(F.col("n_chars") >= 2000, "True").otherwise("False").alias("is_long"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, video_id, true_label, prediction: truth from ``toxic``, prediction from ``quality``, every 17th an error."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model"),
        F.col("doc_id").alias("video_id"),
        F.when(F.col("toxic") == 1, "fake").otherwise("real").alias("true_label"),
        F.when(F.col("doc_id") % 17 == 0, "Error").when(F.col("quality") == 0, "fake").otherwise("real").alias("prediction"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, model, source, reference (the first half of the text), prediction (the other half)."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    half = F.floor(F.length("text") / 2).cast("int")
    return docs.select(
        F.col("doc_id").alias("pair_id"),
        F.col("lang").alias("model"),
        F.col("text").alias("source"),
        F.substring("text", F.lit(1), half).alias("reference"),
        F.substring("text", half + 1, F.length("text") - half).alias("prediction"),
    )


def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, model_name, video_id, score, error from the events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trial"), F.col("event_type").alias("model_name"), F.col("event_id").alias("video_id"), (F.col("value") / 100).alias("score"), (F.col("event_type") == "error").alias("failed"), "ts"
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (label), node_id, layer, embedding, tokens."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("node_id"), (F.col("vec_id") % 3).cast("int").alias("layer"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id") % 400 + 50).alias("tokens")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's parent: the smallest node of the layer above among the 60 ids around it, within its group."""
    n = nodes(spark, sf_dir).select("doc_id", "node_id", "layer")
    child = n.where("layer < 2").select("doc_id", F.col("node_id").alias("child_id"), "layer", F.floor(F.col("node_id") / 60).alias("band"))
    parent = n.select("doc_id", F.col("node_id").alias("parent_id"), (F.col("layer") - 1).alias("layer"), F.floor(F.col("node_id") / 60).alias("band"))
    return child.join(parent, ["doc_id", "layer", "band"]).groupBy("doc_id", "child_id").agg(F.min("parent_id").alias("parent_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
