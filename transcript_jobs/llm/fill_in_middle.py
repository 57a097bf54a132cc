"""Fill-in-middle transformation of whole texts in Spark SQL functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Form:
    """Where a text is cut and how its parts are arranged.

    ``unit`` is the pattern of a unit, of which no text is cut within; it has to cover
    every character. ``middle_percent`` of the texts are rearranged, ``suffix_first_percent``
    of those with the suffix first.
    """

    seed: int = 7
    unit: str = r"[^\n]*\n|[^\n]+"
    middle_percent: int = 100
    suffix_first_percent: int = 50
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    def __post_init__(self):
        marks = [self.prefix_mark, self.suffix_mark, self.middle_mark]
        for a in marks:
            for b in marks:
                # Else a mark could appear where the end of a text meets the start of a mark, and no parser would find the parts.
                if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                    raise ValueError(f"marks must not be empty, hold or overlap each other: {a!r}, {b!r}")
        if len(set(marks)) < 3:
            raise ValueError("marks must differ")


def draw(key: Column, seed: int, k: int) -> Column:
    """The k-th of eight unsigned 32-bit integers that a seed and a key give."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 8 * k + 1, 8), 16, 10).cast("long")


def between(c: Column, start: str, stop: str) -> Column:
    """What stands after the mark ``start`` and before the next mark ``stop``."""
    return F.substring_index(F.substring_index(c, start, -1), stop, 1)


def restore(output: Column, form: Column, how: Form = Form()) -> Column:
    """The exact text, parsed from an output and the name of its form."""
    p, s, m = how.prefix_mark, how.suffix_mark, how.middle_mark
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(output, p, s), middle, between(output, s, m))
    spm = F.concat(between(output, p, m), middle, between(output, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, how: Form = Form(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rearrange each whole text so that a model learns to fill in its middle.

    A text is cut at two of its units, drawn from the seed and the id alone, into
    prefix, middle and suffix: ``psm`` puts the suffix before the middle, ``spm`` the
    suffix before all; a text that is empty, holds a mark, or is not drawn stays
    ``plain``. ``restore`` gives back the text.

    Returns ``id_col, n`` (units), ``form, prefix_chars, middle_chars`` (null if
    plain) and ``output``, a row for each row. Null texts are empty. Repeated rows,
    and rows of one id, are cut by the same draws; a null id draws like an empty one.
    Other columns are left out, whatever their names. An empty table gives no rows.

    Each row is worked on where it is read: no shuffle, no Python, and memory of one
    text at a time.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.array(*[draw(key, how.seed, k) for k in range(4)]).alias("h"))
    marks = "|".join(re.escape(x) for x in (how.prefix_mark, how.suffix_mark, how.middle_mark))
    rows = rows.select("id", "text", "h", F.regexp_extract_all("text", F.lit(how.unit), F.lit(0)).alias("units"), F.col("text").rlike(marks).alias("marked"))
    n = F.size("units")
    ends = [F.col("h")[k] % (n + 1) for k in (0, 1)]
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h")[2] % 100 >= how.middle_percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < how.suffix_first_percent, "spm").otherwise("psm")
    cuts = rows.select("id", "text", "units", form.alias("form"), F.least(*ends).cast("int").alias("low"), F.greatest(*ends).cast("int").alias("high"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, size), ""))
    low, high = F.col("low"), F.col("high")
    parts = cuts.select("id", "text", "form", n.cast("long").alias("n"), part(F.lit(1), low).alias("prefix"), part(low + 1, high - low).alias("middle"), part(high + 1, n - high).alias("suffix"))
    p, s, m = F.lit(how.prefix_mark), F.lit(how.suffix_mark), F.lit(how.middle_mark)
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    size = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return parts.select(F.col("id").alias(id_col), "n", "form", size("prefix"), size("middle"), output.alias("output"))
