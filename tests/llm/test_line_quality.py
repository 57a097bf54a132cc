"""Quality rules against plain Python: counts within texts, shared lines of hosts, and verdicts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from transcript_jobs.llm.line_quality import Rules, judge_quality, without_lines

SCHEMA = "doc_id long, text string, source string, host string, lines string, row long"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def normal(line):
    return re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[1-9]", "0", line.lower())).strip(" ")


def within(text):
    w = words_of(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    places = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places)


def plain_verdicts(rows, rules):
    texts = defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
    having = {s: Counter(x for t in ts for x in {normal(x) for x in t.split("\n")} if x) for s, ts in texts.items()}
    out = []
    for i, t, s in rows:
        t = t or ""
        n, *rest = within(t)
        limit = max(rules.least, min(rules.most, int(len(texts[s]) * rules.share)))
        gone = [k for k, x in enumerate(t.split("\n")) if having[s][normal(x)] > limit]
        removed = sum(len(words_of(t.split("\n")[k])) for k in gone)
        failed = n < rules.min_words or 100 * rest[3] > rules.repeat_percent * n
        out.append((i, n, *rest, gone or None, removed, failed, not failed and n - removed >= rules.left * n))
    return out


def some_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, menu = "Read more: page 12 of 99", "Home | About <b>  us\t& more"
    rows = []
    for i in range(150):
        body = [line(rnd.randrange(1, 30)) for _ in range(rnd.randrange(0, 9))]
        if i % 2:
            body.insert(rnd.randrange(len(body) + 1), common.replace("12", str(i % 9 + 10)))
        if i % 5 == 0:
            body += [menu.upper(), menu, menu]
        if i % 11 == 0:
            body += body
        rows.append((i, "\n".join(body), "big" if i % 3 else f"s{i % 4}"))
    long_line = "\n".join("the same footer of all pages of this host with many words in it to read here" for _ in range(4))
    rows += [(200 + i, f"{long_line}\nown {i} and more\n" + line(i % 7), "big") for i in range(30)]
    clean = line(80)
    # Copies of one text, of which no line is to be removed for that.
    rows += [(300 + i, clean + "\n" + line(0), "big") for i in range(40)]
    return rows + [(None, None, None), (None, "", "big"), (5, " \n\t\n \r\n", ""), (7, "a b", None), (7, "x y z " * 400, None), (8, "one 😀 two\x0b#three\x85four", "s1"), (9, "\n".join(line(3) for _ in range(20_000)), "s2"), (9, "a a a a a", "s2")]


@pytest.mark.parametrize("rules", [Rules(), Rules(least=5, share=0.1, most=12, left=0.5, min_words=20, repeat_percent=30), Rules(heavy=1)])
def test_equals_plain_python(spark, rules):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in judge_quality(docs, rules).collect()]
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(plain_verdicts(rows, rules), key=key)


def test_shared_lines_deplete_and_copies_do_not(spark):
    rules = Rules()
    verdict = {r.doc_id: r for r in judge_quality(spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in some_rows()], SCHEMA)).collect() if r.doc_id}
    assert not any(verdict[200 + i].kept for i in range(30)) and all(verdict[200 + i].removed_lines == [0, 1, 2, 3] for i in range(30))
    assert all(verdict[300 + i].kept and not verdict[300 + i].removed_words for i in range(40))
    assert rules.left == 0.3


def test_lines_are_removed_from_texts(spark):
    rows = spark.createDataFrame([("a\nb\nc", [1]), ("a\n\nb", [0, 2]), ("a", None), ("a", [0])], "t string, gone array<int>")
    assert [r[0] for r in rows.select(without_lines(F.col("t"), F.col("gone"))).collect()] == ["a\nc", "", "a", ""]


def test_empty_table(spark):
    assert judge_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_and_no_window(spark):
    docs = spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in some_rows()], SCHEMA)
    plan = judge_quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Window", "CartesianProduct"))
