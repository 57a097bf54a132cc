"""Column expressions that clean, normalise and measure texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of model output, and what normalisation for search drops.
FINAL_MARK = "<|channel|>final<|message|>"
MESSAGE_MARK = "<|message|>"
SEARCH_DROPS = "、。！？.,!\"'\\"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_description(c: Column) -> Column:
    """Null to empty, then without URLs, with single blanks, none before a full stop or comma, and stripped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iU)https?://\S+|www\.\S+", "")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return strip(F.regexp_replace(c, r" ([、。,.!?])", "$1"))


def is_true(c: Column) -> Column:
    """A truth value from its text in any case."""
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def normal_label(c: Column) -> Column:
    return F.lower(strip(c))


def normal_verdict(c: Column, starts: bool = False) -> Column:
    """``real`` or ``fake`` if the text is, ends with (or, if ``starts``, starts with) that word, else ``Error``."""
    text = normal_label(F.coalesce(c, F.lit("")))
    ends = (lambda w: text.startswith(w)) if starts else (lambda w: text.endswith(w))
    return F.when(ends("real"), "real").when(ends("fake"), "fake").otherwise("Error")


def final_answer(c: Column) -> Column:
    """What a model says after its last final mark (or message mark), up to the next control mark, without other marks."""
    tail = F.when(F.instr(c, FINAL_MARK) > 0, F.substring_index(c, FINAL_MARK, -1)).when(F.instr(c, MESSAGE_MARK) > 0, F.substring_index(c, MESSAGE_MARK, -1)).otherwise(c)
    tail = F.split(tail, r"<\|(?:start|end|channel)\|>", 2)[0]
    return strip(F.regexp_replace(tail, r"<\|[^|]*\|>", ""))


def search_form(c: Column) -> Column:
    """Without white space and without the marks that quotes often lose."""
    return F.translate(F.regexp_replace(c, r"(?U)\s+", ""), SEARCH_DROPS, "")


def sentences_by_punctuation(c: Column) -> Column:
    """Sentences that end with a terminator and the punctuation right after it; a dot between digits ends none."""
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?s).*?(?:[。！？!?｡．.]\p{P}{0,8}(?!\p{P})(?<!\d\.(?=\d))|\z)"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences_by_line(c: Column) -> Column:
    """Sentences that end with 。！？ or a line break, unless a closing bracket follows."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), r"(?<=[。！？\n])(?![」』)])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences_latin(c: Column) -> Column:
    """Sentences of Latin script: after . ! ? before a blank, and at line breaks."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?]) +|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def tokens(c: Column, pattern: str = r"\p{L}+") -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by blanks."""
    if n == 1:
        return words
    at = F.sequence(F.lit(0), F.size(words) - n)
    runs = F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def chunk_budget(length: Column, rate: Column, cap: int = 2048) -> Column:
    """Target characters of a chunk's summary and the tokens to make for it."""
    target = F.greatest((length * rate).cast("int"), F.lit(200))
    return F.struct(target.alias("chunk_target"), F.least((target * F.lit(1.5)).cast("int"), F.lit(cap)).alias("max_tokens"))


def final_budget(length: Column, rate: Column) -> Column:
    """Target characters of a final summary, whether the final pass is needed for ``length`` characters, and its token budget."""
    target = (length * rate).cast("int")
    return F.struct(
        target.alias("target"),
        (length > F.lit(1.2) * target).alias("needed"),
        F.greatest(F.lit(64), (target * F.lit(1.1) / F.lit(1.2)).cast("int")).alias("max_tokens"),
    )


def duplicated_suffix(names: Sequence[str], prefix: str, keep: Sequence[str] = ()) -> list[Column]:
    """Columns under a prefix, but for those in ``keep``."""
    return [F.col(n) if n in keep else F.col(n).alias(f"{prefix}{n}") for n in names]
