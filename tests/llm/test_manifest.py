"""The Merkle manifest against plain Python, over one and more rounds of blocks."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from transcript_jobs.llm.manifest import Shape, build_manifest, folded, hex_text, leaf_digest, proof_digest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def reduced(nodes, arity):
    """The root of a list of digests, and each node's siblings on the way to it."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k, place in enumerate(at):
            run = runs[place // arity]
            paths[k] += run[: place % arity] + run[place % arity + 1 :]
        at, level = [p // arity for p in at], [digest(*run) for run in runs]
    return level[0], paths


def plain_manifest(rows, arity):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs, found = [], []
    for name in names:
        ordered = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = reduced([leaf(r) for r in ordered], arity)
        subs.append(sub)
        found.append([(r[0], leaf(r), sub, path) for r, path in zip(ordered, paths)])
    root, tops = reduced(subs, arity)
    return sorted(((i or -1, d, sub, root, digest(*path, *top)) for group, top in zip(found, tops) for i, d, sub, path in group))


def some_rows(n, sources):
    rnd = random.Random(n)
    rows = [(i, f"s{min(rnd.randrange(2 * sources), sources)}", rnd.choice(["en", None]), rnd.randrange(99), f"text {i}\nmore é") for i in range(1, n)]
    return rows + [(None, None, None, None, None), (None, "s1", "", 0, ""), (7, "s1", "en", 5, "a"), (7, "s1", "en", 5, "a"), (7, "", "en", 5, "b" * 200_000), (0, "ÿ", "x", 1, "z"), (3, "😀", "x", 1, "z")]


@pytest.mark.parametrize("shape,n,sources", [(Shape(), 700, 3), (Shape(3, 1), 120, 9), (Shape(2, 2), 150, 2), (Shape(3, 2), 1, 1)])
def test_equals_plain_python(spark, shape, n, sources):
    rows = some_rows(n, sources)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    made = build_manifest(docs, shape=shape)
    got = made.select("*", proof_digest(F.col("proof")).alias("p"), folded(F.col("leaf"), F.col("proof")).alias("f")).collect()
    assert sorted((r.doc_id or -1, r.leaf, r.subroot, r.root, r.p) for r in got) == plain_manifest(rows, shape.arity)
    assert all(r.f == r.root for r in got)


def test_changed_row_is_found_by_its_proof_and_columns_pass(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in some_rows(60, 2)], SCHEMA)
    changed = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.concat("text", F.lit("!")))
    made = build_manifest(docs, also={"pos": F.unhex(changed), "length": F.length("text")}, shape=Shape(3, 1))
    rows = made.select("length", "root", folded(hex_text(F.col("pos")), F.col("proof")).alias("f")).collect()
    assert len(rows) == 66
    # The row of nulls is not changed by an exclamation mark.
    assert [r.length for r in rows if r.f == r.root] == [None]


def test_empty_table(spark):
    assert build_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
