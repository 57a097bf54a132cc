"""Lexicon counts, cohorts and paired changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_jobs.functions.text import tokens

#: Rules of a lexicon that travel to every task; a larger one is joined.
MOST_RULES = 200_000


def token_counts(texts: DataFrame, id_col: str, text_col: str, pattern: str = r"\p{L}+") -> DataFrame:
    """How often each document has each word: ``id, token, n``."""
    return texts.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col), pattern)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


def known_rules(rules: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact rules, one for each pattern and category, and prefix rules, each by itself; rules of unknown categories are left out."""
    known = rules.join(categories.select("cat_id"), "cat_id", "left_semi")
    return known.where(~F.col("is_prefix")).select("pattern", "cat_id").distinct(), known.where("is_prefix").select("rule_id", "pattern", "cat_id").distinct()


class Lexicon:
    """Rules as a tree of letters: a node has the categories of the prefix rules that end there, and those of exact rules.

    A word is walked once, whatever the number of rules.
    """

    def __init__(self, exact: list[tuple[str, int]], prefix: list[tuple[str, int]]):
        self.root: dict = {}
        self.known: dict[str, dict[int, int]] = {}
        for slot, rules in (("begun", prefix), ("whole", exact)):
            for pattern, cat in rules:
                node = self.root
                for c in pattern:
                    node = node.setdefault(c, {})
                # Names of slots are longer than a letter, so that they meet no letter's branch.
                node.setdefault(slot, []).append(cat)

    def hits(self, word: str) -> dict[int, int]:
        """How often a word counts for each category."""
        out: dict[int, int] = {}
        node, walked = self.root, 0
        for cat in node.get("begun", ()):
            out[cat] = out.get(cat, 0) + 1
        for c in word:
            if (node := node.get(c)) is None:
                break
            walked += 1
            for cat in node.get("begun", ()):
                out[cat] = out.get(cat, 0) + 1
        if node is not None and walked == len(word):
            for cat in node.get("whole", ()):
                out[cat] = out.get(cat, 0) + 1
        return out

    @classmethod
    def of(cls, exact: DataFrame, prefix: DataFrame) -> Lexicon | None:
        """The rules on the driver, if they are no more than MOST_RULES."""
        found = [[(r["pattern"], r["cat_id"]) for r in df.select("pattern", "cat_id").limit(MOST_RULES + 1).collect()] for df in (exact, prefix)]
        return cls(*found) if sum(map(len, found)) <= MOST_RULES else None


def match_vocabulary(vocabulary: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Hits of each distinct token in each category: ``token, cat_id, hits``.

    Exact rules of one pattern count once for a category; every prefix rule that
    matches counts by itself. Ids without a category are ignored. Up to MOST_RULES
    rules travel to the tasks as a tree of letters; more are met by equality, with
    each token under its beginnings of the lengths that prefix rules have.
    """
    exact, prefix = known_rules(rules, categories)
    words = vocabulary.select("token").distinct()
    tree = Lexicon.of(exact, prefix)
    if tree is not None:

        def found(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda w: [{"cat_id": c, "hits": n} for c, n in tree.hits(w).items()])

        return words.select("token", F.inline(F.pandas_udf(found, "array<struct<cat_id: int, hits: bigint>>")("token")))
    whole = words.join(exact, words["token"] == exact["pattern"]).select("token", "cat_id")
    # A lexicon's prefix lengths: a handful of numbers.
    lengths = [r[0] for r in prefix.select(F.length("pattern")).distinct().collect()]
    if not lengths:
        return whole.groupBy("token", "cat_id").agg(F.count("*").alias("hits"))
    starts = words.select("token", F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("k")).where("k <= length(token)")
    begun = starts.select("token", F.expr("substring(token, 1, k)").alias("pattern")).join(prefix, "pattern").select("token", "cat_id")
    return whole.unionByName(begun).groupBy("token", "cat_id").agg(F.count("*").alias("hits"))


def category_scores(texts: DataFrame, rules: DataFrame, categories: DataFrame, id_col: str = "video_id", text_col: str = "text", pattern: str = r"\p{L}+") -> DataFrame:
    """100 x hits / tokens of every document and category, 0 where there are none: ``id_col, cat_id, name, score``.

    Rules count as in ``match_vocabulary``. With up to MOST_RULES of them a row's words
    are counted where they stand, each distinct word of a batch walked once, and
    nothing is shuffled; with more, words meet the rules by a join.
    """
    exact, prefix = known_rules(rules, categories)
    # Categories of a lexicon are few; every document has a row for each.
    cats = sorted((r["cat_id"], r["name"]) for r in categories.select("cat_id", "name").collect())
    tree = Lexicon.of(exact, prefix)
    if tree is None:
        return joined_scores(texts, exact, prefix, categories, id_col, text_col, pattern)
    place = {c: [k for k, (cat, _) in enumerate(cats) if cat == c] for c, _ in cats}

    def score(lists: pd.Series) -> pd.Series:
        met: dict[str, list[tuple[int, int]]] = {}
        out = []
        for words in lists:
            total = np.zeros(len(cats))
            for w in words if words is not None else ():
                if (hits := met.get(w)) is None:
                    hits = met[w] = [(k, n) for c, n in tree.hits(w).items() for k in place[c]]
                for k, n in hits:
                    total[k] += n
            out.append(100.0 * total / max(len(words) if words is not None else 0, 1))
        return pd.Series(out)

    scored = texts.select(F.col(id_col), F.pandas_udf(score, "array<double>")(tokens(F.col(text_col), pattern)).alias("_scores"))
    named = F.array(*[F.struct(F.lit(c).cast("int").alias("cat_id"), F.lit(name).alias("name"), F.get("_scores", F.lit(k)).alias("score")) for k, (c, name) in enumerate(cats)])
    return scored.select(id_col, F.inline(named))


def joined_scores(texts: DataFrame, exact: DataFrame, prefix: DataFrame, categories: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """``category_scores`` by joins: a word's count in a document is shuffled by the word, once for each length of prefix rules."""
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), tokens(F.col(text_col), pattern).alias("w"))
    each = rows.select("_row", F.explode("w").alias("token")).groupBy("_row", "token").agg(F.count("*").alias("n"))
    lengths = sorted(r[0] for r in prefix.select(F.length("pattern")).distinct().collect())
    keys = F.array(F.struct(F.lit(0).alias("k"), F.col("token").alias("pattern")), *[F.struct(F.lit(k).alias("k"), F.substring("token", 1, k).alias("pattern")) for k in lengths])
    asked = each.select("_row", "n", F.inline(F.filter(keys, lambda x: (x["k"] == 0) | (F.length(F.col("token")) >= x["k"]))))
    all_rules = exact.select(F.lit(0).alias("k"), "pattern", "cat_id").unionByName(prefix.select(F.length("pattern").alias("k"), "pattern", "cat_id"))
    sums = asked.join(all_rules, ["k", "pattern"]).groupBy("_row", "cat_id").agg(F.sum("n").alias("hits"))
    all_ = categories.groupBy().agg(F.array_sort(F.collect_list(F.struct("cat_id", "name"))).alias("cats"))
    grid = rows.select("_row", "_id", F.size("w").alias("total")).crossJoin(F.broadcast(all_)).select("_row", "_id", "total", F.inline("cats"))
    joined = grid.join(sums, ["_row", "cat_id"], "left")
    return joined.select(F.col("_id").alias(id_col), "cat_id", "name", F.coalesce(100.0 * F.col("hits") / F.col("total"), F.lit(0.0)).alias("score"))


def join_methods(texts: DataFrame, predictions: DataFrame, transcripts: DataFrame, key: str = "video_id") -> DataFrame:
    """Texts, predictions and transcripts of ids that have all three; narrow tables are joined first, texts last."""
    return predictions.join(texts, key).join(transcripts, key)


def cohort(predictions: DataFrame, truth: str, predicted: str, target: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    """Rows of one truth and one prediction, within the target ids if given."""
    rows = predictions.where((F.col("true_label") == truth) & (F.col("prediction") == predicted))
    return rows if target is None else rows.join(target.select(key).distinct(), key, "left_semi")


def cohorts(methods: DataFrame, target: DataFrame, key: str = "video_id") -> DataFrame:
    """Fake rows of each method within the target, as ``missed`` (called real) or ``kept`` (called fake), in one pass over the union of methods."""
    rows = methods.where((F.col("true_label") == "fake") & F.col("prediction").isin("real", "fake"))
    rows = rows.join(target.select(key).distinct(), key, "left_semi")
    return rows.withColumn("outcome", F.when(F.col("prediction") == "real", "missed").otherwise("kept"))


def write_cohorts(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).partitionBy("method", "outcome").parquet(path)


def text_lengths(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.groupBy("method", "outcome").agg(F.count("*").alias("n"), F.avg(F.length(text_col)).alias("avg_length"), F.min(F.length(text_col)).alias("min_length"), F.max(F.length(text_col)).alias("max_length"))


def deltas(base: DataFrame, method: DataFrame, key: str = "video_id") -> DataFrame:
    """Paired features in long form: ``key, feature, base, method, delta``."""
    joined = base.select(key, "feature", F.col("value").alias("base")).join(method.select(key, "feature", F.col("value").alias("method")), [key, "feature"])
    return joined.withColumn("delta", F.col("method") - F.col("base"))


def wide(long_form: DataFrame, features: list[str], key: str = "video_id", column: str = "delta") -> DataFrame:
    """One row for each id with a column for each feature; the features are given, so no pass looks for them."""
    return long_form.groupBy(key).pivot("feature", features).agg(F.first(column))
