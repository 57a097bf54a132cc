"""Fill-in-middle against plain Python, and the forms that a parser must tell apart."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from transcript_jobs.llm.fill_in_middle import Form, fill_in_middle, restore

LONG = "".join(f"line {i}\n" for i in range(30_000))
TEXTS = [(1, "a\nb\nc\nd"), (2, ""), (3, None), (None, "x\ny\nz\n"), (4, "one line"), (5, "has <S> inside\nb\n"), (6, "\n\n\n\n"), (7, LONG), (8, "é\r\nü😀\n<\n<P\n>\nS>"), (8, "other text\nof one id\nand more"), (4, "one line")]


def plain_python(key, text, seed=7, middle=100, first=50):
    text, key = text or "", "" if key is None else str(key)
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= middle:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if h[3] % 100 < first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("how", [Form(), Form(seed=3, middle_percent=60, suffix_first_percent=20)])
def test_equals_plain_python_and_restores(spark, how):
    rows = TEXTS + [(k, "\n".join(f"{k} {j}" for j in range(k % 9))) for k in range(100, 200)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, units string, form int")
    made = fill_in_middle(docs, how).withColumn("back", restore(F.col("output"), F.col("form"), how)).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made))) == sorted(
        repr((k, *plain_python(k, t, how.seed, how.middle_percent, how.suffix_first_percent))) for k, t in rows
    )
    assert sorted(r.back for r in made) == sorted(t or "" for _, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_empty_table_and_string_ids(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = spark.createDataFrame([("a-1", "x\ny\nz")], "name string, body string")
    row = fill_in_middle(named, id_col="name", text_col="body").head()
    assert (row.name, row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == ("a-1", *plain_python("a-1", "x\ny\nz"))


def test_other_marks_and_units(spark):
    how = Form(unit=r".|\n", prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")
    docs = spark.createDataFrame([(k, "[pre [suf mid] text\n<P>") for k in range(50)], "doc_id long, text string")
    made = fill_in_middle(docs, how).select("output", restore(F.col("output"), F.col("form"), how).alias("back")).collect()
    assert {r.back for r in made} == {"[pre [suf mid] text\n<P>"} and len({r.output for r in made}) > 20


@pytest.mark.parametrize("marks", [("", "b", "c"), ("ab", "bc", "x"), ("aa", "b", "c"), ("aba", "x", "y"), ("<P>", "<P>", "<M>"), ("<P>", "<<P>>", "<M>")])
def test_marks_that_no_parser_could_tell_apart_are_refused(marks):
    with pytest.raises(ValueError):
        Form(prefix_mark=marks[0], suffix_mark=marks[1], middle_mark=marks[2])


def test_plan_has_no_shuffle_and_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
