"""Quality rules: repetition within a document, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcript_jobs.plans.scratch import Scratch

#: White space between words, and marks that are counted as symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"

#: The lowest bits of a window's number hold its place, the others bits of its hash, so that sorting numbers brings equal windows together.
PLACE_BITS = 31

@dataclass(frozen=True)
class Rules:
    """A line is removed if more different documents of its host have it than ``least``, and than ``share`` of
    the host's documents or ``most`` of them. A document is depleted with less than ``left`` of its words left.

    Lines that hold more than 1 / ``heavy`` of all lines, of which there are at most ``heavy``, meet the documents
    by a broadcast of their hashes, others by a shuffle; this has no effect on the result."""

    least: int = 20
    share: float = 0.005
    most: int = 1000
    left: float = 0.3
    min_words: int = 50
    repeat_percent: int = 50
    heavy: int = 50_000

    def limit(self, documents: Column) -> Column:
        """The most documents of a host that may have a line."""
        return F.greatest(F.lit(self.least), F.least(F.lit(self.most), F.floor(documents * self.share)))


def window_hash(words: Column, i: Column) -> Column:
    """The hash of the three words from place ``i``, from the hashes of all words."""
    return F.get(words, i).bitwiseXOR(F.shiftleft(F.get(words, i + 1), 1)).bitwiseXOR(F.shiftleft(F.get(words, i + 2), 2))


def window_numbers(words: Column) -> Column:
    """A number for each window of three words, of bits of its hash and its place, in ascending order; null for fewer words."""
    number = lambda i: F.coalesce(F.shiftleft(window_hash(words, i), PLACE_BITS).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))
    return F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), number)))


def beside(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The items of an ordered array that are the same as the one before or after."""
    return F.filter(ordered, lambda x, i: F.coalesce(same(x, F.get(ordered, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(ordered, i - 1)), F.lit(False)))


def candidates(numbers: Column, words: Column) -> Column:
    """The windows that share the bits of their number with another one, with all of their hash, in its order."""
    near = beside(numbers, lambda a, b: F.shiftrightunsigned(a, PLACE_BITS) == F.shiftrightunsigned(b, PLACE_BITS))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    return F.array_sort(F.transform(near, lambda x: F.struct(window_hash(words, place(x)).alias("hash"), place(x).alias("place"))))


def covered(places: Column) -> Column:
    """How many words the windows at these ascending places cover together."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)


def normalised_lines(text: Column, host: Column) -> Column:
    """Each line (lower case, digits as 0, one blank between words) as a hash, which is the host's own, and its words; 0 words for a blank line."""
    flat = F.regexp_replace(F.translate(F.lower(text), "123456789", "000000000"), r"[\x20\x09\x0B-\x0D]+", " ")
    words = lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1)
    return F.transform(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: F.struct(F.xxhash64(host, x).alias("line"), words(x).alias("words")))


def text_rules(docs: DataFrame, text: str) -> DataFrame:
    """The other columns and counts within each text: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    All in the row, without a shuffle of words: windows of three words become numbers,
    which are sorted, so that equal ones meet.
    """
    kept, body = [c for c in docs.columns if c != text], F.col(text)
    rows = docs.select(
        *kept,
        F.transform(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_words"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"),
    )
    rows = rows.withColumn("_numbers", window_numbers(F.col("_words")))
    rows = rows.withColumn("_near", candidates(F.col("_numbers"), F.col("_words")))
    rows = rows.withColumn("_places", F.array_sort(F.transform(beside(F.col("_near"), lambda a, b: a["hash"] == b["hash"]), lambda x: x["place"])))
    return rows.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered(F.col("_places")), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def frequent_lines(rows: DataFrame, rules: Rules) -> DataFrame:
    """The lines (``line``, and how many ``rows`` have it) that more of a host's different documents have than its limit.

    Rows of equal text are one document of their host. Counts are combined before the
    shuffles, so that no line, host or text meets as rows; hosts meet their lines in
    32 parts each.
    """
    texts = rows.groupBy("host", "body").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))
    each = texts.select("host", "copies", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: x["words"] > 0), lambda x: x["line"]))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("documents"), F.sum("copies").alias("rows")).where(F.col("documents") > rules.least)
    sizes = rows.select("host", "body").distinct().groupBy("host").agg(rules.limit(F.count("*")).alias("limit"))
    dealt = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(31))))
    met = counts.withColumn("part", F.pmod("line", F.lit(32)).cast("int")).join(dealt, ["host", "part"])
    return met.where(F.col("documents") > F.col("limit")).select("line", "rows")


def judge_quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts, failed rules, lines to remove and a verdict for each document.

    A document fails the base rules with fewer than ``min_words`` words, or if more
    than ``repeat_percent`` of them stand in three-word windows that occur twice or
    more. Its lines that too many different documents of its host have are to be
    removed; a document that they leave too little of is depleted. ``kept`` is true
    if it neither fails nor is depleted. See ``Rules``.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    removed_lines`` (places of lines from 0, ascending; null if none),
    ``removed_words, base_failed, kept``, a row for each row. Null texts are empty,
    and fail; null hosts are a host together. Rows of equal text count as one document
    of their host, so that copies do not condemn each other; all get the same verdict.
    Null and repeated ids pass through; other columns are left out, whatever their
    names. An empty table gives no rows.

    Texts are read once and not shuffled; lines are, as hashes, but for frequent ones.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), host.alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("body"), normalised_lines(F.col("text"), F.col("host")).alias("lines"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(text_rules(rows, "text"), "rows")
    frequent = scratch.save(frequent_lines(rows, rules), "frequent")
    total = rows.agg(F.sum(F.size("lines"))).head()[0] or 0
    heavy = F.col("rows") > total / rules.heavy
    lines = rows.select("row", F.posexplode("lines").alias("place", "x")).select("row", "place", "x.line", "x.words").where("words > 0")
    hot = lines.join(F.broadcast(frequent.where(heavy).select("line", F.lit(True).alias("hot"))), "line", "left")
    hot = hot.where(F.col("hot")).select("row", "place", "words").unionByName(hot.where(F.col("hot").isNull()).join(frequent.where(~heavy).select("line"), "line").select("row", "place", "words"))
    removed = hot.groupBy("row").agg(F.array_sort(F.collect_list("place")).alias("removed_lines"), F.sum("words").alias("removed_words"))
    judged = rows.drop("lines", "host", "body").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < rules.left * F.col("n_words")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_lines", "removed_words"]
    return judged.select(F.col("id").alias(id_col), *counts, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines at these places."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
