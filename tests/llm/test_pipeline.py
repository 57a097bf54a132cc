"""The corpus pipeline stage by stage against plain Python."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from transcript_jobs.llm import queries
from transcript_jobs.llm.source_mix import cumulative

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
    return out


def test_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "source mix", "bpe"]
    assert all(s.columns == COLUMNS for s in stages[:-1]) and stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_toxic_documents_go(spark, stages):
    scored = {r["doc_id"]: r["predicted"] for r in queries.op4_toxicity(spark, DATA).collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == {i for i, p in scored.items() if not p}


def test_one_of_each_group_stays(stages):
    rows = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(rows)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == [i for i in ids if find(i) == i]


def test_mix(stages):
    rows = [(r["doc_id"], r["source"]) for r in stages[2].collect()]
    known = lambda s: s if s in queries.MIX else None
    n = Counter(known(s) for _, s in rows)
    share = sum(queries.MIX.get(s, 1.0) for s in n)
    want = Counter()
    for i, s in rows:
        steps = cumulative(len(rows) * queries.MIX.get(s, 1.0) / share / n[known(s)])
        u = int(hashlib.md5(f"0:1|{i}".encode()).hexdigest()[:12], 16) / 2**48
        want[i] = sum(step <= u for step in steps)
    assert Counter(r["doc_id"] for r in stages[3].collect()) == +want


def test_encoding(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[3].collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, stages[4].collect())) == want


def test_stages_on_hard_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (2, "", "en", "src0", 0), (None, "words of no one", "en", "other", 3), (5, "a " * 50_000, "en", "src1", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).count() == 5
    assert corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).count() == 5
    assert set(corpus_pipeline.run(spark, str(tmp_path)).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    # Columns whose names the operators use pass through all stages but the last.
    named = docs.withColumns({c: F.lit(42) for c in ("toxicity", "copy", "mix_key", "n", "id", "text_hash", "score", "gone_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        named = stage(spark, named, str(tmp_path))
        assert named.columns == [*docs.columns, "toxicity", "copy", "mix_key", "n", "id", "text_hash", "score", "gone_id"]
        assert all(r["copy"] == r["toxicity"] == r["text_hash"] == r["gone_id"] == 42 for r in named.collect())


def test_an_id_with_two_texts_keeps_the_one_of_its_own(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "x y z q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, "").collect())) == [rows[0], rows[2]]


def test_sql_of_queries(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, DATA), con.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        rows = sorted(tuple(map(str, (r[c] for c in order))) for r in got.select(*[F.col(c) for c in order]).collect())
        assert rows == sorted(tuple(str(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), name
