"""Quality of summaries and of sweep trials."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transcript_jobs.functions.stems import Stems, stems
from transcript_jobs.functions.text import ngrams, tokens
from transcript_jobs.operators.stats import quantile


def rouge_n(pairs: DataFrame, n: int, key: list[str], reference: str = "reference", prediction: str = "prediction", pattern: str = "[a-z0-9]+", stem: bool = False) -> DataFrame:
    """Precision, recall and F1 of shared n-grams for each pair, of stems instead of words if ``stem``.

    Both sides' n-grams are tagged and counted in one shuffle; a pair is then summed
    in place. Pairs without n-grams on a side score 0.
    """
    # One row for each side, so that a text is cut into words once and not again for each n-gram.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col(reference).alias("text")), F.struct(F.lit(1).alias("side"), F.col(prediction).alias("text")))
    words = pairs.select(*key, F.inline(sides)).select(*key, "side", tokens(F.col("text"), pattern).alias("words"))
    words = words.withColumn("words", stems(F.col("words"))) if stem else words
    each = words.select(*key, "side", F.explode(ngrams(F.col("words"), n)).alias("gram"))
    side = lambda k: F.sum(F.when(F.col("side") == k, 1).otherwise(0))
    counts = each.groupBy(*key, "gram").agg(side(0).alias("r"), side(1).alias("p"))
    sums = counts.groupBy(*key).agg(F.sum(F.least("r", "p")).alias("hit"), F.sum("r").alias("r"), F.sum("p").alias("p"))
    scored = pairs.select(*key).join(sums, key, "left")
    share = lambda d: F.when(F.coalesce(F.col(d), F.lit(0)) > 0, F.col("hit") / F.col(d)).otherwise(F.lit(0.0))
    precision, recall = share("p"), share("r")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return scored.select(*key, precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence.

    The places of ``a`` are the bits of one integer, of which a 0 marks a step of the
    table's row: a token of ``b`` changes a whole row by one addition.
    """
    places: dict = defaultdict(list)
    wanted = set(b)
    for i, t in enumerate(a):
        if t in wanted:
            places[t].append(i)
    masks = {t: sum(1 << i for i in at) for t, at in places.items()}
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        if m := masks.get(t):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(reference: Column, prediction: Column, stem: bool = False) -> Column:
    """Precision, recall and F1 of the longest common subsequence of two token arrays, of their stems if ``stem``."""

    def run(refs: pd.Series, preds: pd.Series) -> pd.DataFrame:
        rows = []
        for r, p in zip(refs, preds):
            r, p = ([] if x is None else list(x) for x in (r, p))
            n = common_length(r, p) if len(r) >= len(p) else common_length(p, r)
            precision, recall = n / len(p) if len(p) else 0.0, n / len(r) if len(r) else 0.0
            rows.append((precision, recall, 2 * precision * recall / (precision + recall) if n else 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    sides = [stems(c) if stem else c for c in (reference, prediction)]
    return F.pandas_udf(run, "precision double, recall double, f1 double")(*sides)


def f1_of(hits: int, predicted: int, wanted: int) -> float:
    """F1 of that many hits among what is predicted and what is wanted, 0 without hits."""
    if not hits:
        return 0.0
    precision, recall = hits / predicted, hits / wanted
    return 2 * precision * recall / (precision + recall)


def stemmed_f1(reference: Column, prediction: Column, pattern: str = "[a-z0-9]+", longer_than: int = 3) -> Column:
    """F1 of stemmed words, pairs of words and the longest common subsequence of two texts: ``rouge1, rouge2, rougeL``.

    As ``rouge_n`` and ``rouge_l`` with ``stem``, but within the row: both texts are
    cut and stemmed once for all three, and nothing is shuffled.
    """

    def run(refs: pd.Series, preds: pd.Series) -> pd.DataFrame:
        known, rows = Stems(longer_than), []
        for texts in zip(refs, preds):
            r, p = ([known[w] for w in re.findall(pattern, t)] for t in texts)
            grams = [(Counter(r), Counter(p)), (Counter(zip(r, r[1:])), Counter(zip(p, p[1:])))]
            shared = [sum(min(n, b[x]) for x, n in a.items() if x in b) for a, b in grams]
            longest = common_length(r, p) if len(r) >= len(p) else common_length(p, r)
            rows.append((f1_of(shared[0], len(p), len(r)), f1_of(shared[1], len(p) - 1, len(r) - 1), f1_of(longest, len(p), len(r))))
        return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"])

    sides = [F.lower(F.coalesce(c, F.lit(""))) for c in (reference, prediction)]
    return F.pandas_udf(run, "rouge1 double, rouge2 double, rougeL double")(*sides)


def greedy_match(prediction: Column, reference: Column) -> Column:
    """Precision, recall and F1 of the best cosine of each token's vector on the other side."""

    def run(preds: pd.Series, refs: pd.Series) -> pd.DataFrame:
        rows = []
        for p, r in zip(preds, refs):
            if p is None or r is None or not len(p) or not len(r):
                rows.append((0.0, 0.0, 0.0))
                continue
            x, y = (np.array([np.asarray(v, float) for v in s]) for s in (p, r))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
            c = x @ y.T
            precision, recall = float(c.max(axis=1).mean()), float(c.max(axis=0).mean())
            rows.append((precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    return F.pandas_udf(run, "precision double, recall double, f1 double")(prediction, reference)


def word_set(sentence: Column) -> Column:
    """The different words of a sentence, as hashes."""
    return F.array_distinct(F.transform(tokens(sentence), lambda w: F.xxhash64(w)))


def containment(source: Column, summary: Column) -> Column:
    """A stand-in pair score of two word sets: the share of the summary sentence's words that the source sentence has."""
    return F.when(F.size(summary) > 0, F.size(F.array_intersect(summary, source)) / F.size(summary)).otherwise(F.lit(0.0))


def sentence_blocks(pairs: DataFrame, key: list[str], source: Column, summary: Column, block: int) -> DataFrame:
    """Each pair as rows of at most ``block`` sentences of either side: ``key, _pair, _first, _source, _summary``.

    A long document is many rows, which tasks share. Pairs without sentences on a side
    have none.
    """
    rows = pairs.select(*key, F.monotonically_increasing_id().alias("_pair"), source.alias("_m"), summary.alias("_s")).where("size(_m) > 0 AND size(_s) > 0")
    starts = lambda c: F.explode(F.sequence(F.lit(1), F.size(c), F.lit(block)))
    cut = rows.withColumn("_at", starts("_m")).withColumn("_first", starts("_s"))
    return cut.select(*key, "_pair", "_first", F.slice("_m", F.col("_at"), block).alias("_source"), F.slice("_s", F.col("_first"), block).alias("_summary"))


def mean_of_best(scored: DataFrame, key: list[str]) -> DataFrame:
    """The mean over summary sentences (``_place``) of the best of their blocks' scores (``_best``); maxima combine before they are shuffled."""
    best = scored.groupBy(*key, "_pair", "_place").agg(F.max("_best").alias("_best"))
    return best.groupBy(*key, "_pair").agg(F.avg("_best").alias("consistency")).drop("_pair")


def consistency(
    pairs: DataFrame,
    key: list[str],
    source_sentences: str,
    summary_sentences: str,
    prepare: Callable[[Column], Column] = word_set,
    scorer: Callable[[Column, Column], Column] = containment,
    block: int = 64,
) -> DataFrame:
    """Mean over summary sentences of the best score against any source sentence.

    ``prepare`` is taken of each sentence once, ``scorer`` of each two prepared ones,
    both built-in expressions; see ``model_consistency`` for a model. Sentences are
    crossed within blocks of a pair. Pairs without sentences on a side have no row;
    rows that repeat a key are scored apart.
    """
    blocks = sentence_blocks(pairs, key, F.transform(source_sentences, prepare), F.transform(summary_sentences, prepare), block)
    best = F.transform("_summary", lambda s: F.array_max(F.transform("_source", lambda m: scorer(m, s))))
    # The size refers to the block once more, which keeps it from being cut again within the loop.
    each = blocks.select(*key, "_pair", "_first", F.posexplode(F.when(F.size("_source") > 0, best)).alias("_k", "_best"))
    return mean_of_best(each.withColumn("_place", F.col("_first") + F.col("_k")), key)


def score_blocks(batches: Iterator[pa.RecordBatch], scorer: Callable[[list[str], list[str]], Sequence[float]], batch: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (others, first, source, summary): each summary sentence's place and its best score in its block.

    Sentence pairs stream from block to block: the scorer gets ``batch`` of them at a
    time, whatever rows they come from, and no more than that many are held.
    """
    for rows in batches:
        sides = [rows.column(c).to_pylist() for c in ("_source", "_summary")]
        ends = np.cumsum([0] + [len(x) for x in sides[1]])
        best = np.full(int(ends[-1]), -np.inf)
        held: tuple[list, list, list] = ([], [], [])

        def score() -> None:
            if held[0]:
                found = np.asarray(scorer(held[0], held[1]), float)
                if len(found) != len(held[0]):
                    raise ValueError(f"the scorer gave {len(found)} scores for {len(held[0])} pairs")
                np.maximum.at(best, held[2], found)
            for x in held:
                x.clear()

        for row, (source, summary) in enumerate(zip(*sides)):
            for k, sentence in enumerate(summary):
                for other in source:
                    held[0].append(other)
                    held[1].append(sentence)
                    held[2].append(int(ends[row]) + k)
                    if len(held[0]) == batch:
                        score()
        score()
        sizes = np.diff(ends)
        row = pa.array(np.repeat(np.arange(rows.num_rows), sizes))
        kept = {c: rows.column(c).take(row) for c in rows.schema.names if c not in ("_source", "_summary", "_first")}
        place = np.repeat(rows.column("_first").to_numpy(), sizes) + np.arange(len(best)) - np.repeat(ends[:-1], sizes)
        yield pa.RecordBatch.from_pydict(kept | {"_place": pa.array(place.astype(np.int32)), "_best": pa.array(best)})


def model_consistency(
    pairs: DataFrame, key: list[str], source_sentences: str, summary_sentences: str, scorer: Callable[[list[str], list[str]], Sequence[float]], batch: int = 256, block: int = 64, parts: int | None = None
) -> DataFrame:
    """As ``consistency``, with a model that scores a batch of (source sentence, summary sentence) pairs.

    The two sides of a pair are cut into blocks of at most ``block`` sentences, so that
    a long document is many rows, which ``parts`` deals out over as many tasks before
    any model call; pairs of sentences exist in batches of ``batch`` within a task
    alone. Maxima are combined before they are shuffled by pair and sentence. Null
    sentences score as empty ones; pairs without sentences on a side have no row;
    rows that repeat a key are scored apart.
    """
    clean = lambda c: F.transform(c, lambda s: F.coalesce(s, F.lit("")))
    blocks = sentence_blocks(pairs, key, clean(source_sentences), clean(summary_sentences), block)
    blocks = blocks.repartition(parts) if parts else blocks
    kept = [f for f in blocks.schema if f.name not in ("_source", "_summary", "_first")]
    made = T.StructType([*kept, *T.StructType.fromDDL("_place int, _best double")])
    return mean_of_best(blocks.mapInArrow(lambda batches: score_blocks(batches, scorer, batch), made), key)


def scored_part(source: Column, most: int = 10_000) -> Column:
    """What a scorer with a window of ``most`` characters sees of a source."""
    return F.substring(source, 1, most)


def scored_or_null(score: Column, source: Column, summary: Column, summarised: Column, failed: Column) -> Column:
    """The score under the rules of a run: null if not summarised, 0 for empty texts and errors."""
    blank = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(summary, F.lit("")) == "")
    return F.when(~summarised, None).when(blank | failed, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def model_row(scores: DataFrame, columns: list[str], seconds: str = "seconds", by: str = "model") -> DataFrame:
    """One row for each model: samples, means, total and mean generation time."""
    means = [F.avg(c).alias(f"avg_{c}") for c in columns]
    return scores.groupBy(by).agg(F.count("*").alias("n_samples"), *means, F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("seconds_each"))


def union_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def objective(scores: DataFrame, by: list[str], score: str = "score", large: bool = False) -> DataFrame:
    """Mean + 0.25 x 10th percentile (interpolated) - 0.10 x population deviation; 0 without scores.

    A trial's distinct scores are held in one task; with ``large``, for few trials of
    very many documents, they are ranked by ranges over many. Both are exact.
    """
    if large:
        about = scores.groupBy(*by).agg((F.avg(score) - 0.10 * F.stddev_pop(score)).alias("_rest"))
        low = quantile(scores, by, score, 0.1, "_low")
        return about.join(low, by, "left").select(*by, F.coalesce(F.col("_rest") + 0.25 * F.col("_low"), F.lit(0.0)).alias("value"))
    value = F.avg(score) + 0.25 * F.percentile(score, 0.1) - 0.10 * F.stddev_pop(score)
    return scores.groupBy(*by).agg(F.coalesce(value, F.lit(0.0)).alias("value"))


def best_trial(trials: DataFrame, value: str = "value", order: str = "trial") -> DataFrame:
    """The trial of the highest value, the earliest of equals."""
    return trials.agg(F.max_by(F.struct(*trials.columns), F.struct(F.col(value), -F.col(order))).alias("t")).select("t.*")


def with_duration(trials: DataFrame, start: str = "datetime_start", end: str = "datetime_complete") -> DataFrame:
    return trials.withColumn("duration_seconds", (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6)


def error_log(trials: DataFrame, errors: str = "errors") -> DataFrame:
    """One row for each error in the trials' arrays of (video_id, reason)."""
    return trials.select(*[c for c in trials.columns if c != errors], F.inline(errors))
