"""Connected components of a graph that no task sees whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_jobs.plans.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """The smallest node that each node of ``edges`` (a, b: long) reaches, as ``node, component``.

    Alternates two steps until the edges stay the same: every node links its larger
    neighbours to its smallest one, then its smaller neighbours to the smallest of
    these. In the end each node is linked to its component's smallest alone. Each
    round is written to the shared folder; rounds grow with the logarithm of the
    number of nodes. Loops and repeated edges are allowed; null ends are ignored.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = _state(now)
    for k in range(1, max_rounds + 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # The larger neighbours of a node go to its smallest.
        large = now.select(F.col("a").alias("x"), F.col("b").alias("a")).join(least, "a").select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # The smaller neighbours of a node, and the node, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = scratch.save(small.where("a <> b").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))).head())
