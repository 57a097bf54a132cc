"""Paired non-parametric tests, false discovery control, correlations and residuals, for few features with many rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs.plans.scratch import Scratch

#: Up to so many differences the null distribution is exact, and with zeros or ties sign flips are tried up to FLIPS.
EXACT, FLIPS = 50, 13


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def rank_sum_counts(n: int) -> np.ndarray:
    """How many of the 2^n sign choices give each sum of the ranks 1 to n."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k].copy()
    return counts


def signed_rank_p(n: int, zeros: int, w: float, tie_sum: float, tied: bool, ranks: list[tuple[float, int]], alternative: str) -> float:
    """p of a signed-rank sum ``w`` of positives over ``n`` non-zero differences."""
    if n == 0:
        return 1.0
    if n + zeros <= EXACT and not zeros and not tied:
        counts = rank_sum_counts(n)
        at = int(round(w))
        low, high = counts[: at + 1].sum() / 2.0**n, counts[at:].sum() / 2.0**n
    elif n + zeros <= FLIPS:
        each = np.array([r for r, t in ranks for _ in range(t)])
        signs = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
        sums = signs @ each
        low, high = float((sums <= w + 1e-9).mean()), float((sums >= w - 1e-9).mean())
    else:
        mean = n * (n + 1) / 4
        deviation = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_sum / 2) / 24)
        z = (w - mean) / deviation
        low, high = math.erfc(-z / math.sqrt(2)) / 2, math.erfc(z / math.sqrt(2)) / 2
    return min(1.0, {"two-sided": 2 * min(low, high), "less": low, "greater": high}[alternative])


def rows_before(counts: DataFrame, by: list[str], value: str, size: str) -> DataFrame:
    """``counts`` with ``before``, the rows of the same ``by`` with a lower value, and ``total``, all its rows.

    Distinct values with how many rows have them (``size``) are sorted by ranges of
    (by, value); a range sums its own, and what the ranges before hold is added. A
    feature's values lie in as many tasks as they need: no window runs over a feature.
    """
    order = [*by, value]
    sorted_ = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # Written, so that all that follows sees the same ranges.
    sorted_ = Scratch(counts.sparkSession, "ranks").save(sorted_, "sorted")
    sums = sorted_.groupBy(*by, "_part").agg(F.sum(size).alias("_sum"))
    # A row for each feature and range.
    whole = Window.partitionBy(*by)
    earlier = F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*by, "_part", F.coalesce(earlier, F.lit(0)).alias("_start"), F.sum("_sum").over(whole).alias("total"))
    own = F.sum(size).over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    found = sorted_.withColumn("before", F.coalesce(own, F.lit(0))).join(starts, [*by, "_part"])
    return found.withColumn("before", F.col("before") + F.col("_start")).drop("_part", "_start")


def quantile_of(placed: DataFrame, by: list[str], value: str, size: str, share: float, out: str) -> DataFrame:
    """The interpolated quantile of each ``by``, from the distinct values that ``rows_before`` has placed."""
    at = F.lit(share) * (F.col("total") - 1)
    has = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col(size))
    ends = placed.where(has(F.floor(at)) | has(F.ceil(at))).groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.first(at - F.floor(at)).alias("_part"))
    return ends.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(out))


def quantile(rows: DataFrame, by: list[str], value: str, share: float, out: str = "quantile") -> DataFrame:
    """The exact interpolated quantile of the non-null values of each ``by``, with as many distinct values as there are."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_size"))
    return quantile_of(rows_before(counts, by, "_value", "_size"), by, "_value", "_size", share, out)


def signed_rank(rows: DataFrame, by: str = "feature", value: str = "delta", alternative: str = "two-sided", least: int = 3) -> DataFrame:
    """Wilcoxon's signed-rank test for each ``by``: ``n, n_zero, w_plus, p_raw``, with median and mean.

    Differences are first counted by feature and absolute value, which combines before
    the shuffle; distinct values are ranked by ranges, so that few features with many
    rows keep many tasks at work.
    With fewer than ``least`` values, or only one distinct value, p is 1.
    """
    good = rows.where(finite(F.col(value))).select(by, F.col(value).cast("double").alias("d"))
    # Halves of the signs are kept apart within one group of equal absolute values.
    counts = good.groupBy(by, F.abs("d").alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("t_plus"))
    nonzero = rows_before(counts.where("a > 0"), [by], "a", "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    few = F.when(F.col("total") <= FLIPS, F.struct("rank", "t"))
    sums = nonzero.groupBy(by).agg(
        F.sum("t").alias("n_nonzero"),
        F.sum(F.col("rank") * F.col("t_plus")).alias("w_plus"),
        F.sum((F.pow("t", F.lit(3)) - F.col("t")).cast("double")).alias("tie_sum"),
        F.max("t").alias("largest_tie"),
        F.collect_list(few).alias("ranks"),
    )
    about = good.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("n_zero"), F.avg("d").alias("mean_delta"), F.min("d").alias("low"), F.max("d").alias("high"))
    joined = about.join(quantile(good, [by], "d", 0.5, "median_delta"), by).join(sums, by, "left").na.fill({"n_nonzero": 0, "w_plus": 0.0, "tie_sum": 0.0, "largest_tie": 1})

    def p(n, zeros, w, ties, largest, ranks, count, flat):
        out = []
        for row in zip(n, zeros, w, ties, largest, ranks, count, flat):
            listed = [(r["rank"], int(r["t"])) for r in (row[5] if row[5] is not None else [])]
            out.append(1.0 if row[6] < least or row[7] else signed_rank_p(int(row[0]), int(row[1]), row[2], row[3], row[4] > 1, listed, alternative))
        return pd.Series(out)

    p = F.pandas_udf(_typed(p), "double")
    raw = p("n_nonzero", "n_zero", "w_plus", "tie_sum", "largest_tie", "ranks", "n", F.col("low") == F.col("high"))
    return joined.select(by, "median_delta", "mean_delta", "n", "n_zero", "w_plus", raw.alias("p_raw"))


def _typed(f):
    """Series in, series out, as pandas UDFs ask for."""

    def g(n: pd.Series, zeros: pd.Series, w: pd.Series, ties: pd.Series, largest: pd.Series, ranks: pd.Series, count: pd.Series, flat: pd.Series) -> pd.Series:
        return f(n, zeros, w, ties, largest, ranks, count, flat)

    return g


def summary(rows: DataFrame, by: str = "feature", value: str = "delta") -> DataFrame:
    """Median, mean and count of finite values."""
    good = rows.where(finite(F.col(value)))
    about = good.groupBy(by).agg(F.avg(value).alias("mean_delta"), F.count("*").alias("n"))
    return about.join(quantile(good, [by], value, 0.5, "median_delta"), by).select(by, "median_delta", "mean_delta", "n")


def false_discovery(tests: DataFrame, p: str = "p_raw", tie: str = "feature", level: float = 0.05, exclude: tuple[str, ...] = ("len",)) -> DataFrame:
    """Benjamini-Hochberg: ``p_fdr_bh`` and whether it is significant. One row for each feature, so one window holds them."""
    rows = tests.where(~F.col(tie).isin(*exclude)) if exclude else tests
    one = Window.partitionBy(F.lit(1))
    m = F.count("*").over(one)
    rank = F.row_number().over(one.orderBy(p, tie))
    scaled = rows.withColumn("_scaled", F.col(p) * m / rank).withColumn("_rank", rank)
    lowest = F.min("_scaled").over(one.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    adjusted = scaled.withColumn("p_fdr_bh", F.least(lowest, F.lit(1.0))).drop("_scaled", "_rank")
    return adjusted.withColumn("sig_fdr_0.05", F.col("p_fdr_bh") < level)


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) * h / a


def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation, by Student's t with n - 2 degrees."""
    out = []
    for x, k in zip(r, n):
        if k < 3 or x is None or math.isnan(x):
            out.append(float("nan"))
        else:
            out.append(0.0 if abs(x) >= 1 else beta_fraction((k - 2) / 2, 0.5, 1 - x * x))
    return pd.Series(out)


def average_ranks(counts: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``by, value, out``: the rank from 1 of each distinct value, equal rows sharing their mean, from rows (by, value, ..., t) counted ``t`` times."""
    distinct = rows_before(counts.groupBy(by, value).agg(F.sum("t").alias("n")), [by], value, "n")
    return distinct.select(by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))


def rank_correlation(good: DataFrame, by: str) -> DataFrame:
    """Spearman's ``r`` of the columns x and y for each ``by``.

    Rows are first counted by feature and both values, which combines before the
    shuffle; only distinct values are ranked.
    """
    pairs = good.groupBy(by, "x", "y").agg(F.count("*").alias("t"))
    ranks = pairs.join(average_ranks(pairs, by, "x", "rx"), [by, "x"]).join(average_ranks(pairs, by, "y", "ry"), [by, "y"])
    middle = pairs.groupBy(by).agg(((F.sum("t") + 1) / 2).alias("m"))
    a, b = F.col("rx") - F.col("m"), F.col("ry") - F.col("m")
    sums = ranks.join(middle, by).groupBy(by).agg(F.sum(a * b * F.col("t")).alias("xy"), F.sum(a * a * F.col("t")).alias("xx"), F.sum(b * b * F.col("t")).alias("yy"))
    return sums.select(by, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))


def correlations(rows: DataFrame, by: str = "feature", x: str = "delta_len", y: str = "delta", method: str = "spearman") -> DataFrame:
    """Correlation of ``y`` with ``x`` for each ``by`` with three finite pairs or more: ``r, p, n, median_delta``, by ascending p."""
    good = rows.where(finite(F.col(x)) & finite(F.col(y))).select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    found = good.groupBy(by).agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).join(quantile(good, [by], "y", 0.5, "median_delta"), by)
    if method == "spearman":
        found = found.drop("r").join(rank_correlation(good, by), by)
    found = found.where("n >= 3 AND r IS NOT NULL AND NOT isnan(r)").select(by, "r", "n", "median_delta")
    return found.withColumn("p", F.pandas_udf(correlation_p, "double")("r", "n")).orderBy("p", by)


def residuals(rows: DataFrame, by: str = "feature", x: str = "delta_len", y: str = "delta") -> DataFrame:
    """Least-squares residuals of ``y`` on ``x`` over finite pairs, with slope and intercept; features of fewer than three pairs are left out."""
    good = rows.where(finite(F.col(x)) & finite(F.col(y)))
    lines = good.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("_n")).where("_n >= 3").drop("_n")
    return good.join(lines, by).withColumn("residual", F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x)))


def residual_tests(rows: DataFrame, by: str = "feature", x: str = "delta_len", y: str = "delta") -> DataFrame:
    """Signed-rank tests of the residuals with their coefficients, by ascending p."""
    found = residuals(rows, by, x, y)
    lines = found.select(by, "slope", "intercept").distinct()
    return signed_rank(found, by, "residual").withColumnRenamed("median_delta", "median_residual").drop("mean_delta").join(lines, by).orderBy("p_raw", by)


def fitted_line(rows: DataFrame, by: str = "feature", x: str = "delta_len", y: str = "delta", steps: int = 100) -> DataFrame:
    """``steps`` points of each feature's fitted line between its least and largest ``x``."""
    found = residuals(rows, by, x, y)
    ends = found.groupBy(by).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.min("slope").alias("slope"), F.min("intercept").alias("intercept"))
    at = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    at = at.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / (steps - 1))
    return at.select(by, "step", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))
