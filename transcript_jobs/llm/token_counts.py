"""Token counts of whole texts without making the tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_jobs.llm.batches import Memo, text_blocks
from transcript_jobs.llm.bpe import Vocabulary, tokenizer_text, vocabulary
from transcript_jobs.llm.pretokens import PIECES, units
from transcript_jobs.llm.ragged import merge_words


class Counter:
    def __init__(self, v: Vocabulary, memory: int = 200_000):
        self.v, self.pieces = v, Memo(memory)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The order in which the texts are counted, and their counts."""
        order, ends, codes, distinct = units(texts, list(self.v.special))
        cut = [[u] if u in self.v.special else PIECES.findall(u) for u in distinct]
        known = {p: self.pieces.get(p) for pieces in cut for p in pieces}
        known |= {s: 1 for s in self.v.special if s in known}
        missing = [p for p, n in known.items() if n is None]
        for p, n in zip(missing, merge_words(self.v, [p.encode() for p in missing], symbols=False)[1].tolist()):
            known[p] = n
            self.pieces.put(p, n)
        of_unit = np.fromiter((sum([known[p] for p in pieces]) for pieces in cut), np.int64, len(cut))
        total = np.concatenate([[0], np.cumsum(of_unit[codes])])
        return order, np.diff(np.concatenate([[0], total[ends]]))


@lru_cache(maxsize=2)
def counter(text: str) -> Counter:
    return Counter(vocabulary(text))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of whole texts under a byte-level BPE vocabulary.

    Returns ``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens``, a row for each row. A
    null text counts as empty, with 0 of both; repeated rows and null ids pass
    through; other columns are left out, whatever their names. A special token's
    string inside a text is one token. No shuffle: each task counts its own rows,
    in blocks of a bounded number of bytes, each distinct piece of a block once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_text(spark, tokenizer_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value).count
        for block in text_blocks(batches):
            order, n = count(block.column(1))
            at = pa.array(order)
            size = pc.fill_null(pc.binary_length(block.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([block.column(0).take(at), size.take(at), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
