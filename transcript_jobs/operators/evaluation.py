"""Scoring real/fake predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("real", "fake")


def with_correctness(df: DataFrame, truth: str = "true_label", predicted: str = "prediction", lower: bool = False) -> DataFrame:
    t = F.lower(F.col(truth)) if lower else F.col(truth)
    return df.withColumn("is_correct", F.coalesce(t == F.col(predicted), F.lit(False)))


def valid_predictions(df: DataFrame, predicted: str = "prediction") -> DataFrame:
    return df.where(F.col(predicted).isin(*LABELS))


def confusion(df: DataFrame, truth: str = "true_label", predicted: str = "prediction", by: str = "model") -> DataFrame:
    """One row for each ``by`` with the four cells, from one aggregation that combines before the shuffle."""
    cell = lambda t, p: F.sum(F.when((F.col(truth) == t) & (F.col(predicted) == p), 1).otherwise(0)).alias(f"cm_act_{t}_pred_{p}")
    return df.groupBy(by).agg(*[cell(t, p) for t in LABELS for p in LABELS])


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def metrics(cells: DataFrame, by: str = "model") -> DataFrame:
    """Accuracy, precision, recall and F1 of both classes, support-weighted F1 and Matthews correlation."""
    rr, rf, fr, ff = (F.col(f"cm_act_{t}_pred_{p}").cast("double") for t in LABELS for p in LABELS)
    n = rr + rf + fr + ff
    rp, rc, fp, fc = ratio(rr, rr + fr), ratio(rr, rr + rf), ratio(ff, ff + rf), ratio(ff, ff + fr)
    rf1, ff1 = ratio(2 * rr, 2 * rr + fr + rf), ratio(2 * ff, 2 * ff + rf + fr)
    spread = F.sqrt((rr + fr) * (rr + rf) * (ff + rf) * (ff + fr))
    return cells.select(
        by,
        ratio(rr + ff, n).alias("accuracy"),
        ratio(rf1 * (rr + rf) + ff1 * (fr + ff), n).alias("f1_weighted"),
        rp.alias("real_precision"),
        rc.alias("real_recall"),
        rf1.alias("real_f1"),
        fp.alias("fake_precision"),
        fc.alias("fake_recall"),
        ff1.alias("fake_f1"),
        *[F.col(f"cm_act_{t}_pred_{p}") for t in LABELS for p in LABELS],
        ratio(rr * ff - rf * fr, spread).alias("mcc"),
    )


def evaluate(df: DataFrame, truth: str = "true_label", predicted: str = "prediction", by: str = "model") -> DataFrame:
    return metrics(confusion(valid_predictions(df, predicted), truth, predicted, by), by)


def errors(df: DataFrame, truth: str = "ground_truth", predicted: str = "prediction") -> DataFrame:
    return df.where(F.col(truth) != F.col(predicted))


def error_counts(df: DataFrame, truth: str = "ground_truth", predicted: str = "prediction") -> DataFrame:
    return errors(df, truth, predicted).groupBy(truth).agg(F.count("*").alias("n_errors"))


def errors_with_quotes(wrong: DataFrame, records: DataFrame, order: str = "ord", most: int = 200) -> DataFrame:
    """Each error with the start of the first quote of its screening record; of several records of an id the last holds."""
    quote = F.coalesce(F.substring(F.get("candidates", F.lit(0))["quote"], 1, most), F.lit(""))
    last = records.groupBy(F.trim("video_id").alias("video_id")).agg(F.max_by(quote, F.col(order)).alias("extracted_snippet"))
    joined = wrong.withColumn("video_id", F.trim("video_id")).join(last, "video_id", "left")
    return joined.withColumn("extracted_snippet", F.coalesce("extracted_snippet", F.lit("")))
