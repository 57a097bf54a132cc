"""Choosing, de-duplicating and summarising rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcript_jobs.functions.text import is_true


def long_rows(df: DataFrame, column: str = "is_long") -> DataFrame:
    return df.where(is_true(F.col(column)))


def not_short(df: DataFrame, column: str = "transcript", least: int = 500) -> DataFrame:
    return df.where(F.length(column) >= least)


def pass_short(text: Column, changed: Column, most: int = 10_000) -> Column:
    """The text itself up to ``most`` characters, else its changed form."""
    return F.when(F.length(text) <= most, text).otherwise(changed)


def without_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the lowest ``order`` for each key; an aggregate, so it combines before the shuffle."""
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(order)).alias("row")
    return df.groupBy(F.col(key).alias("_key")).agg(row).select("row.*")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, those of the lowest hashes of seed and key."""
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    return df.orderBy(order, key).limit(n)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def table_summary(df: DataFrame, column: str) -> DataFrame:
    """Rows, columns and the rows of each value of one column."""
    n = len(df.columns)
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(n))
