"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means up to this are inverted by one cumulative sum; larger ones are split into equal independent parts.
PART_MEAN = 16.0
#: Stands for all sources outside the recipe; no source has this name.
OTHERS = "\x00others"


def cumulative(mean: float) -> list[float]:
    """P(X <= k) of a Poisson variable for k = 0, 1, ... until the rest is below the steps of the hash."""
    term, total, k, out = math.exp(-mean), 0.0, 0, []
    while True:
        total += term
        out.append(min(total, 1.0))
        if k > mean and term < 1e-18:
            return out
        k += 1
        term *= mean / k


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 hash, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def repetition_rates(docs: DataFrame, weights: dict[str, float], other_weight: float, total: int | None, source_col: str) -> dict[str | None, float]:
    """Mean repetitions of a document of each source of the recipe, and of all other sources under None.

    The counts are of all documents; no more rows reach the driver than the recipe has sources, and one.
    """
    known = F.when(F.col(source_col).isin(list(weights)), F.col(source_col))
    counts = {r[0]: r[1] for r in docs.groupBy(known.alias("source")).count().collect()}
    n = sum(counts.values())
    wanted = {s: w for s, w in [*weights.items(), (None, other_weight)] if w > 0 and counts.get(s)}
    share = sum(wanted.values())
    return {s: (total or n) * wanted[s] / share / counts[s] if s in wanted else 0.0 for s in counts}


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores after it as keep it apart from ``columns`` (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    other_weight: float = 0.0,
    total: int | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str = "copy",
    order_col: str = "mix_key",
) -> DataFrame:
    """Replicate documents so that sources take their target shares, and shuffle all copies.

    Each document is repeated k times, k drawn from a Poisson distribution whose mean
    is its source's target rows over its rows, by inverting the cumulative
    distribution at a hash of seed and ``id_col``. A k of 0 leaves the document out:
    that is the sampling this operator is for. Returns the columns of ``docs`` with
    ``copy_col`` (from 1) and ``order_col`` (the hash that orders all copies); a column
    of ``docs`` with one of these names is replaced, all others stay.

    ``weights`` gives relative target weights; sources outside it, null ones
    included, share ``other_weight``; sources without rows leave their share to the
    rest. ``total`` is the expected number of rows, by default that of ``docs``.
    A null id is stood for by a hash of the whole row; rows with equal ids draw equal
    counts. Null and empty texts are rows like any other. An empty table stays empty.

    One shuffle, by a hash of (id, copy): no source, however large, meets in one task.
    """
    rates = repetition_rates(docs, weights, other_weight, total, source_col)
    docs = docs.drop(copy_col, order_col)
    steps_col, splits_col, n_col = free_names([*docs.columns, copy_col, order_col], "steps", "splits", "n")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))))
    drawn = F.lit(0)
    if used := {s: r for s, r in rates.items() if r}:
        splits = {s: math.ceil(r / PART_MEAN) for s, r in used.items()}
        tables = {s: F.array(*map(F.lit, cumulative(r / splits[s]))) for s, r in used.items()}
        source = F.when(F.col(source_col).isin(list(weights)), F.col(source_col)).otherwise(F.lit(OTHERS))
        pick = lambda of: F.create_map(*[F.lit(x) if i == 0 else x for s, v in of.items() for i, x in enumerate((OTHERS if s is None else s, v))])[source]
        docs = docs.withColumn(steps_col, pick(tables)).withColumn(splits_col, pick({s: F.lit(n) for s, n in splits.items()}))
        n = F.col(splits_col)
        below = lambda part: F.size(F.filter(steps_col, lambda step: step <= uniform(F.concat(F.lit(f"{seed}:"), part.cast("string")), key)))
        drawn = F.when(n == 1, below(F.lit(1))).when(n > 1, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda k, part: k + below(part))).otherwise(0)
    docs = docs.withColumn(n_col, drawn).drop(steps_col, splits_col)
    copies = docs.where(F.col(n_col) > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(n_col)))).drop(n_col)
    copies = copies.withColumn(order_col, F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), key, F.col(copy_col).cast("string")).cast("binary")))
    return copies.repartition(F.col(order_col)).sortWithinPartitions(order_col)
