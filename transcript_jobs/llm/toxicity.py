"""Toxicity by class-conditional Kneser-Ney models of the letters of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from transcript_jobs.llm.batches import gather, text_blocks
from transcript_jobs.plans.scratch import Scratch

#: Letters in the longest gram: a letter and those before it in its word.
ORDER = 4
#: Orders below this share their counts between the classes.
SHARED = 3
DISCOUNT = 0.75
#: Marks that stand before a word, once for each letter of the longest context, and after it.
BEGIN, END = "\x01", "\x02"
#: Words in a window.
WINDOW = 16
#: Differences of words, in nats, over which their shares are counted.
STEPS = (2.0, 5.0)
#: The logarithms of at most so many grams, the most frequent of the texts at hand, go to all tasks (16 bytes each); those of the others are joined.
HEAD = 500_000
#: Bytes of text handled at once. What a block needs stays with the Python worker.
BLOCK_BYTES = 1_000_000


def letters_only(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of letters (and marks) of each text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    return pc.split_pattern(pc.utf8_trim(plain, " "), " ")


class Spelled:
    """All words as one string of code points, each after ``ORDER - 1`` begin marks and before an end mark.

    ``ends`` are the places where a gram ends, ``word`` the word of each, ``hashes``
    a hash of the gram that ends there.
    """

    def __init__(self, words: list[str]):
        self.text = "".join(f"{BEGIN * (ORDER - 1)}{w}{END}" for w in words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.ends = np.arange(len(self.word)) + (self.word + 1) * (ORDER - 1)
        code = np.frombuffer(self.text.encode("utf-32-le"), "<u4").astype(np.uint64)
        hashed = np.zeros(len(self.ends), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(ORDER - 1, -1, -1):
                hashed = (hashed ^ code[self.ends - k]) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(31)
        self.hashes = hashed

    def distinct(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different grams, the place among ``ends`` of the first of each, and which of them each place has."""
        _, first, which = np.unique(self.hashes, return_index=True, return_inverse=True)
        return [self.text[e - ORDER + 1 : e + 1] for e in self.ends[first].tolist()], first, which


def list_grams(sides: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of texts, and with two ``sides`` of their labels, the different grams of a block and how often each occurs on each side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            lists = letters_only(block.column(0))
            flat = lists.flatten().dictionary_encode()
            code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            side = np.repeat(block.column(1).to_numpy(), sizes) if sides > 1 else np.zeros(len(code))
            words = flat.dictionary.to_pylist()
            spelled = Spelled(words)
            grams, _, which = spelled.distinct()
            # An empty word is what a text without letters leaves.
            real = np.array([bool(w) for w in words], float)
            counts = [np.bincount(which, (np.bincount(code[side == s], minlength=len(words)) * real)[spelled.word], len(grams)).astype(np.int64) for s in range(sides)]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *map(pa.array, counts)], ["gram", *(f"w{s}" for s in range(sides))])

    return run


@dataclass
class KneserNey:
    """Two interpolated models, of ordinary and of toxic words, as one table.

    ``known`` has for each gram of each order its counts ``w0, w1``; for each context
    the sum ``t0, t1`` of the counts of its grams and their number ``k0, k1``. The
    highest order has counts of occurrences; a lower one counts the different letters
    that stand before a gram, but for grams that begin with a begin mark, which keep
    their counts. Orders under SHARED add up both classes, so that what is rare in
    either falls back on the same counts.
    """

    counts: DataFrame
    contexts: DataFrame
    letters: int

    @classmethod
    def of(cls, grams: DataFrame, scratch: Scratch) -> KneserNey:
        """From the grams of the highest order with their counts (gram, w0, w1)."""
        level, levels = grams, [grams]
        for n in range(ORDER - 1, 0, -1):
            short = F.substring("gram", 2, n)
            kept = lambda w: F.sum(F.when(short.startswith(BEGIN), F.col(w)).otherwise((F.col(w) > 0).cast("long"))).alias(w)
            level = scratch.save(level.groupBy(short.alias("gram")).agg(kept("w0"), kept("w1")), f"order-{n}")
            levels.append(level)
        counts = levels[0]
        for n, level in zip(range(ORDER - 1, 0, -1), levels[1:]):
            both = F.col("w0") + F.col("w1")
            counts = counts.union(level.select("gram", both.alias("w0"), both.alias("w1")) if n < SHARED else level)
        contexts = counts.groupBy(context(F.col("gram")).alias("context")).agg(
            F.sum("w0").alias("t0"), F.sum("w1").alias("t1"), F.count_if(F.col("w0") > 0).alias("k0"), F.count_if(F.col("w1") > 0).alias("k1")
        )
        return cls(counts, scratch.save(contexts, "contexts"), max(2, level.count()))

    def differences(self, asked: DataFrame, scratch: Scratch) -> DataFrame:
        """The rows of ``asked`` (gram, of the highest order) with ``x``, the logarithm of the last letter's probability as toxic over that as ordinary.

        Each different gram of each order is looked up once; its probability takes that
        of the gram without its first letter, order by order.
        """
        orders = F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda n: F.substring(F.col("gram"), F.lit(ORDER + 1) - n, n))
        every = asked.select(F.explode(orders).alias("gram")).distinct().withColumn("context", context(F.col("gram")))
        every = every.join(self.counts, "gram", "left").join(self.contexts, "context", "left").na.fill(0)
        every = scratch.save(every, "asked")
        known = None
        for n in range(1, ORDER + 1):
            here = every.where(F.length("gram") == n)
            if known is None:
                here = here.withColumns({"p0": F.lit(1.0 / (self.letters + 1)), "p1": F.lit(1.0 / (self.letters + 1))})
            else:
                here = here.join(known.withColumnRenamed("gram", "short"), F.substring("gram", 2, n - 1) == F.col("short"))
            known = here.select("gram", *(probability(k) for k in range(2)))
        return asked.join(known.select("gram", (F.log("p1") - F.log("p0")).alias("x")), "gram")


def context(gram: Column) -> Column:
    """A gram without its last letter."""
    return F.substring(gram, F.lit(1), F.length(gram) - 1)


def probability(k: int) -> Column:
    """The discounted count of a gram in its context, and what the discount leaves by the shorter gram's probability."""
    w, t, kinds, p = (F.col(f"{c}{k}") for c in "wtkp")
    return F.when(t > 0, F.greatest(w - DISCOUNT, F.lit(0.0)) / t + F.lit(DISCOUNT) * kinds / t * p).otherwise(p).alias(f"p{k}")


def features(differences: Callable[[list[str]], np.ndarray], texts: pa.Array) -> np.ndarray:
    """For each text: the length-normalised difference of all its words and of its best window, and the shares of words with a difference over each of STEPS."""
    lists = letters_only(texts)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    each = differences(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    mean = lambda values: np.bincount(row, values, len(sizes)) / np.maximum(sizes, 1)
    total = np.concatenate([[0.0], np.cumsum(each)])
    at = np.arange(len(each))
    windows = (total[np.minimum(at + WINDOW, ends[row])] - total[at]) / WINDOW
    best, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        best[some] = np.maximum.reduceat(windows, (ends - sizes)[some])
    return np.stack([mean(each), best, *(mean((each > step).astype(float)) for step in STEPS)], axis=1)


class Calibration:
    """Logistic regression on standardised features and their squares, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._wide(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            penalty = np.full(len(self.w), ridge)
            penalty[0] = 1e-6
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, z.T @ (p - y) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z**2], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._wide(x) @ self.w, -30, 30)))


@dataclass
class Scorer:
    """A fitted model; without both classes among the labels every text has the same score, the share of toxic labels."""

    model: KneserNey | None
    calibration: Calibration | None
    prior: float


def _measured(docs: DataFrame, model: KneserNey, text_col: str, head: int = HEAD) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """``docs`` with one more column, and a function that gives the features of a batch of its rows.

    All different grams of the texts are looked up in the model's tables. Those of the
    ``head`` most frequent are sent to every task; the others reach their texts by a
    join, in the last column, if there are any.
    """
    scratch = Scratch(docs.sparkSession, "toxicity-grams")
    asked = docs.select(F.col(text_col).alias("text")).mapInArrow(list_grams(1), "gram string, w0 long").groupBy("gram").agg(F.sum("w0").alias("times"))
    asked = scratch.save(asked, "times")
    grams = scratch.save(model.differences(asked, scratch), "differences")
    # One row for each number of times: the least one for which the grams that are so frequent fit into the head.
    sizes = sorted(((r["times"], r["count"]) for r in grams.groupBy(F.least("times", F.lit(10_000)).alias("times")).count().collect()), reverse=True)
    total = np.cumsum([n for _, n in sizes])
    fit = int(np.searchsorted(total, head, side="right"))
    least = sizes[fit - 1][0] if fit else float("inf")
    hashes, x = np.zeros(0, np.uint64), np.zeros(0)
    if fit:
        top = grams.where(F.col("times") >= F.lit(least)).select("gram", "x").toArrow()
        # The begin mark of a first letter's gram is its own, so that all grams are spelled alike.
        hashes, x = _hashes(top["gram"].to_pylist()), top["x"].to_numpy()
        order = np.argsort(hashes)
        hashes, x = hashes[order], x[order]
    shared = docs.sparkSession.sparkContext.broadcast((hashes, x))
    if fit == len(sizes):
        docs = docs.withColumn("_rare", F.lit(None).cast("array<struct<gram:string,x:double>>"))
    else:
        # Features depend on the text alone, so that equal texts have one row of rare grams.
        key = F.md5(F.coalesce(F.col(text_col), F.lit("")))

        def list_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, limit=BLOCK_BYTES):
                lists = letters_only(block.column(0))
                flat = lists.flatten().dictionary_encode()
                spelled = Spelled(flat.dictionary.to_pylist())
                grams, first, which = spelled.distinct()
                far = ~_found(shared.value[0], spelled.hashes[first])[1]
                # Rows of the texts' words, then of the words' rare grams.
                row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                pairs = np.unique(np.stack([row, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)], axis=1), axis=0)
                of_word = np.flatnonzero(far[which])
                starts = np.searchsorted(spelled.word[of_word], np.arange(len(flat.dictionary) + 1))
                n = np.diff(starts)
                at, _ = gather(starts[:-1], n, pairs[:, 1])
                out = np.unique(np.stack([np.repeat(pairs[:, 0], n[pairs[:, 1]]), which[of_word[at]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([block.column(1).take(pa.array(out[:, 0])), pa.array([grams[k] for k in out[:, 1].tolist()], pa.string())], ["key", "gram"])

        rare = docs.select(F.col(text_col).alias("text"), key.alias("key")).mapInArrow(list_rare, "key string, gram string").distinct()
        rare = rare.join(grams.select("gram", "x"), "gram").groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("gram", "x")).alias("_rare"))
        docs = docs.withColumn("_key", key).join(rare, "_key", "left").drop("_key")

    def measure(block: pa.RecordBatch) -> np.ndarray:
        own = block.column(block.num_columns - 1).flatten()
        rare_x = own.field("x").to_numpy(zero_copy_only=False)
        rare_hashes = _hashes(own.field("gram").to_pylist())
        rare_hashes, first = np.unique(rare_hashes, return_index=True)

        def look(words: list[str]) -> np.ndarray:
            spelled = Spelled(words)
            at, near = _found(shared.value[0], spelled.hashes)
            out = np.zeros(len(at))
            out[near] = shared.value[1][at[near]]
            if not near.all():
                out[~near] = rare_x[first[_found(rare_hashes, spelled.hashes[~near])[0]]]
            return np.bincount(spelled.word, out, len(words)) * np.array([bool(w) for w in words], float)

        return features(look, block.column(block.schema.get_field_index(text_col)))

    return docs, measure


def _hashes(grams: list[str]) -> np.ndarray:
    """The hashes that ``Spelled`` gives these grams."""
    code = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, ORDER)
    hashed = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            hashed = (hashed ^ code[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(31)
    return hashed


def _found(ordered: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among ordered ones, and whether it is there."""
    if not len(ordered):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return at, ordered[at] == keys


def fold(doc_id: Column) -> Column:
    """Four folds by the CRC-32 of the id as text; fold 2 is held out, folds 0 and 1 are counted, fold 3 calibrates."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", calibration_rows: int = 4000, head: int = HEAD) -> Scorer:
    """Fit on the labelled rows outside fold 2.

    All of folds 0 and 1 are counted on the executors, gram by gram; the models stay
    there as tables. At most ``calibration_rows`` of fold 3, those of the lowest
    hashes, give the weights of the features. Null labels and ids are left out; of
    several labels of a document the highest holds. No other column is read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.save(known.withColumn("fold", fold(F.col("id"))).where("fold <> 2"), "labels")
    share = float(known.agg(F.avg("toxic")).head()[0] or 0.0)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The fold is known from the id, so that only texts of folds 0 and 1 are dealt out; labels grow with the texts and are never broadcast.
    counted = texts.where(fold(F.col("id")) < 2).join(known.where("fold < 2 AND toxic IN (0, 1)").select("id", "toxic").hint("shuffle_hash"), "id")
    grams = counted.select("text", "toxic").mapInArrow(list_grams(2), "gram string, w0 long, w1 long").groupBy("gram").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    grams = scratch.save(grams.where("w0 + w1 > 0"), "grams")
    if not all(grams.agg(F.sum("w0"), F.sum("w1")).head()):
        return Scorer(None, None, share)
    model = KneserNey.of(grams, scratch)
    chosen = known.where("fold = 3").orderBy(F.xxhash64("id", F.lit(11)), "id").limit(calibration_rows).select("id", "toxic").toArrow()
    if not chosen.num_rows:
        return Scorer(None, None, share)
    sample = scratch.save(texts.join(F.broadcast(spark.createDataFrame(chosen, "id long, toxic int")), "id"), "calibration")
    sample, features_of = _measured(sample, model, "text", head)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(features_of(block).tolist(), pa.list_(pa.float64())), block.column(2)], ["id", "x", "toxic"])

    seen = sample.mapInArrow(measure, "id long, x array<double>, toxic int").toArrow().sort_by("id")
    y = np.array(seen["toxic"].to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return Scorer(None, None, share)
    return Scorer(model, Calibration(np.array(seen["x"].to_pylist()), y), share)


def score_toxicity(docs: DataFrame, scorer: Scorer, text_col: str = "text", head: int = HEAD, score_col: str = "toxicity", below: float | None = None) -> DataFrame:
    """All columns and rows of ``docs`` with ``score_col``, a score from 0 to 1 of the whole text alone.

    A column of that name is replaced. With ``below`` only the rows with a lower score
    are returned, with the columns of ``docs`` alone: their other columns are not
    copied before they are rejected. Null texts are empty and have the score of a text
    without words. Each different gram is looked up once, at the call; texts are
    shuffled only if there are more different grams than ``head``.
    """
    if scorer.model is None:
        if below is not None:
            return docs if scorer.prior < below else docs.limit(0)
        return docs.withColumn(score_col, F.lit(scorer.prior))
    kept = docs if below is not None else docs.drop(score_col)
    names = kept.columns
    # Inside the task columns are known by their place: no name of the table can clash.
    plain = kept.toDF(*(f"c{k}" for k in range(len(names))))
    scored, features_of = _measured(plain, scorer.model, f"c{names.index(text_col)}", head)
    calibration, at = scorer.calibration, names.index(text_col)
    fields = plain.schema.fields if below is not None else [*plain.schema.fields, StructField("score", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, f"c{at}", BLOCK_BYTES):
            scores = calibration.score(features_of(block))
            if below is not None:
                yield block.select(block.schema.names[:-1]).filter(pa.array(scores < below))
            else:
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(scores)], [*block.schema.names[:-1], "score"])

    return scored.mapInArrow(run, StructType(fields)).toDF(*names, *([] if below is not None else [score_col]))
