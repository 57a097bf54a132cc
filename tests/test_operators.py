"""Worked rows for screening, quality, evaluation, retrieval, lexicon and statistics."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcript_jobs.operators import evaluation as E
from transcript_jobs.operators import lexicon as L
from transcript_jobs.operators import quality as Q
from transcript_jobs.operators import retrieval as R
from transcript_jobs.operators import screening as X
from transcript_jobs.operators import stats as A
from transcript_jobs.operators.models import embed
from transcript_jobs.plans.summarise import recursive_summary
from transcript_jobs.plans.tree import Clustering, build_tree, clusters_within_budget, soft_clusters
from transcript_jobs.sources import tables as IO


def test_parse_candidates(spark):
    text = "<CANDIDATE><QUOTE> 治った </QUOTE><TYPE>型2</TYPE></CANDIDATE><CANDIDATE><QUOTE>チャンネル登録を</QUOTE></CANDIDATE><CANDIDATE><TYPE>1</TYPE></CANDIDATE>"
    rows = spark.createDataFrame([(text,), ("該当なし",), ("nothing",), (None,)], "o string").select(X.parse_candidates(F.col("o")).alias("c"), X.parse_status(F.col("o")).alias("s")).collect()
    assert [(c["quote"], c["type"], c["reason"]) for c in rows[0]["c"]] == [("治った", 2, "")]
    assert [r["c"] for r in rows[1:]] == [[], [], []]
    assert [r["s"] for r in rows] == ["success"] + ["success_no_candidates"] * 3


def test_align_quotes(spark):
    rows = [("コーヒーは癌を防ぐ", ["コーヒーは必ず癌を防ぐのです"]), ("今日は雨", ["水は体に良い"]), ("。、", ["何か"]), ("癌を防ぐ", ["水。", "癌を防ぐのです。"]), ("良いのです。水は", ["体に良いのです。", "水は青い。"])]
    df = spark.createDataFrame(rows, "quote string, sentences array<string>")
    got = {r["quote"]: r for r in X.align_quotes(df).collect()}
    assert got["コーヒーは癌を防ぐ"]["score"] == pytest.approx(0.782608695652174) and got["コーヒーは癌を防ぐ"]["found"]
    assert got["今日は雨"]["error"] == "low_confidence_match" and got["今日は雨"]["score"] == pytest.approx(0.2)
    assert got["。、"]["error"] == "quote_empty"
    assert got["癌を防ぐ"]["score"] == 1.0 and got["癌を防ぐ"]["context"] == "水。癌を防ぐのです。"
    assert got["良いのです。水は"]["score"] == 1.0


def test_context_window(spark):
    s = [str(i) for i in range(10)]
    df = spark.createDataFrame([(s, 0), (s, 5), (s, 9)], "s array<string>, i int")
    assert [r[0] for r in df.select(X.context_window(F.col("s"), F.col("i"))).collect()] == ["0123", "345678", "789"]


def test_merge_fragments():
    assert X.merge_fragments(["0123456789ABCDE", "56789ABCDEXYZ", "0123456789ABCDE", "Q"]) == "0123456789ABCDEXYZ\n……\nQ"
    assert X.merge_fragments(["abcdefghijk", "ijkLMN"]) == "abcdefghijk\n……\nijkLMN"
    assert X.merge_fragments([]) == ""


def test_merge_fragments_of_long_texts(spark, tmp_path):
    import random

    from transcript_jobs.plans.queries import QUERIES

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (45_000, 79, 80, 0)]
    # Parts that come again, contained ones and long runs.
    texts += [texts[0][:20_000] + texts[0][5_000:30_000], "na" * 5_000 + texts[0][:500] + "na" * 300, "x" * 33_000 + "y"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["merged"] for r in QUERIES["x6_merge_fragments"](spark, str(tmp_path)).collect()}

    def plain(parts: list[str]) -> str:
        merged = parts[0]
        for part in parts[1:]:
            if part not in merged:
                n = next((n for n in range(len(part), 9, -1) if merged.endswith(part[:n])), 0)
                merged += part[n:] if n else "\n……\n" + part
        return merged

    assert got == {i: plain([x[k : k + 100] for k in range(0, len(x) // 80 * 80 + 1, 80)]) for i, x in enumerate(texts)}
    assert got[0] == texts[0]


def test_searches_of_any_number_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (300, 4)).astype(float)
    nodes = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "node_id long, tokens long, embedding array<double>")
    asked = nodes.select(F.col("node_id").alias("query_id"), "embedding").where("query_id % 2 = 0")
    for name, n in (("MOST_QUERIES", 20), ("QUERY_BLOCK", 40), ("NODE_CHUNK", 70)):
        monkeypatch.setattr(R, name, n)
    got = {(r["query_id"], r["rank"]): r["node_id"] for r in R.inner_product_search(nodes, asked, 7).collect()}
    assert got == {(q, k + 1): i for q in range(0, 300, 2) for k, i in enumerate(sorted(range(300), key=lambda i: (-(v[q] @ v[i]), i))[:7])}
    far = {(r["query_id"], r["node_id"]): r["distance"] for r in R.query_distances(nodes, asked, "L1").collect()}
    assert far == {(q, i): np.abs(v[q] - v[i]).sum() for q in range(0, 300, 2) for i in range(300)}


def test_route(spark):
    kind = "video_id long, flagged_count int, candidates array<struct<context_step2:string,requires_full_context_check:boolean>>"
    records = [(1, 0, []), (2, 1, [("ctx", False)]), (3, 1, [("chunk", True)]), (4, 1, [(" ", False)]), (9, 1, [("x", False)])]
    videos = spark.createDataFrame([(i, "fake", f"full{i}", 0) for i in range(1, 5)], "video_id long, label string, transcript string, ord int")
    got = {r["video_id"]: (r["logic_type"], r["context"]) for r in X.route(spark.createDataFrame(records, kind), videos).collect()}
    assert got == {1: ("auto_real_step1", ""), 2: ("llm_partial_context", "ctx"), 3: ("llm_full_transcript", "full3"), 4: ("llm_full_transcript_fallback", "full4")}


@pytest.mark.parametrize(
    "cells, accuracy, f1, real, fake, mcc",
    [
        ((4, 6, 1, 63), 0.9054054054, 0.8914177335, 0.5333333333, 0.9473684211, 0.5235227664),
        ((8, 2, 24, 40), 0.6486486486, 0.7042082514, 0.3809523810, 0.7547169811, None),
        ((10, 0, 64, 0), 0.1351351351, 0.0321750322, 0.2380952381, 0.0, 0.0),
        ((7, 3, 14, 50), 0.7702702703, 0.8002295099, 0.4516129032, 0.8547008547, 0.3649330084),
    ],
)
def test_recorded_metrics(spark, cells, accuracy, f1, real, fake, mcc):
    named = [("real", "real"), ("real", "fake"), ("fake", "real"), ("fake", "fake")]
    rows = [("m", t, p) for (t, p), n in zip(named, cells) for _ in range(n)] + [("m", "real", "Error")]
    got = E.evaluate(spark.createDataFrame(rows, "model string, true_label string, prediction string")).head()
    assert got["accuracy"] == pytest.approx(accuracy) and got["f1_weighted"] == pytest.approx(f1)
    assert got["real_f1"] == pytest.approx(real) and got["fake_f1"] == pytest.approx(fake)
    assert mcc is None or got["mcc"] == pytest.approx(mcc)


def test_longest_common_subsequence(spark):
    df = spark.createDataFrame([("the cat sat on the mat".split(), "the cat on the red mat".split()), ([], ["a"])], "r array<string>, p array<string>")
    first, empty = (r[0] for r in df.select(Q.rouge_l(F.col("r"), F.col("p"))).collect())
    assert first["f1"] == pytest.approx(5 / 6) and empty["f1"] == 0.0
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 12)))) for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert Q.common_length(a, b) == t[-1][-1]


def test_greedy_match(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.6, 0.8]], [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])], "p array<array<double>>, r array<array<double>>")
    got = df.select(Q.greedy_match(F.col("p"), F.col("r"))).head()[0]
    assert (round(got["precision"], 6), round(got["recall"], 6), round(got["f1"], 6)) == (1.0, 0.933333, 0.965517)


def test_consistency_and_objective(spark):
    scores = {("s0", "a"): 0.2, ("s0", "b"): 0.9, ("s1", "a"): 0.5, ("s1", "b"): 0.1}
    scorer = lambda s, m: F.coalesce(*[F.when((s == k[0]) & (m == k[1]), v) for k, v in scores.items()])
    df = spark.createDataFrame([(1, ["s0", "s1"], ["a", "b"])], "id int, s array<string>, m array<string>")
    assert Q.consistency(df, ["id"], "s", "m", lambda x: x, scorer).head()["consistency"] == pytest.approx(0.7)
    got = Q.objective(spark.createDataFrame([(1, x) for x in (0.2, 0.4, 0.6, 0.8)], "t int, score double"), ["t"]).head()["value"]
    assert got == pytest.approx(0.542639320225)


def test_distances_of_zero_vectors_come_last(spark):
    d = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, [0.0, 1.0])], "doc_id int, node_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<double>")
    got = [(r["node_id"], r["distance"]) for r in R.ranked(R.query_distances(d, asked), ["query_id"]).orderBy("rank").collect()]
    assert got == [(2, 0.0), (3, 1.0), (1, None)]


def test_rank_correlation_with_ties(spark):
    rng = __import__("random").Random(3)
    rows = [("a", float(rng.randint(0, 6)), float(rng.randint(-9, 9))) for _ in range(500)] + [("b", 1.0, float(k)) for k in range(5)]
    d = spark.createDataFrame(rows, "feature string, delta_len double, delta double")
    got = {r["feature"]: r["r"] for r in A.correlations(d).collect()}
    frame = __import__("pandas").DataFrame([r[1:] for r in rows[:500]])
    want = frame.rank().corr().iloc[0, 1]
    # A feature whose values are all equal has no correlation.
    assert set(got) == {"a"} and got["a"] == pytest.approx(want)


def test_types_in_any_digits(spark):
    outputs = [f"<CANDIDATE><QUOTE>a long quote</QUOTE><TYPE>{t}</TYPE><REASON>r</REASON></CANDIDATE>" for t in ("型２", "型٣です", "4", "", "99999999999", "no")]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(outputs)], "video_id int, output string")
    assert [r["type"] for r in X.candidate_rows(d).orderBy("video_id").collect()] == [2, 3, 4, 0, 0, 0]


def test_budgeted_retrieval(spark):
    rows = [(1, i, t, i / 10) for i, t in enumerate((900, 900, 300, 100))]
    d = spark.createDataFrame(rows, "doc_id int, node_id long, tokens long, distance double")
    assert [r["node_id"] for r in R.collapsed(d, ["doc_id"], 9, 2000).orderBy("rank").collect()] == [0, 1]
    assert [r["node_id"] for r in R.until_crossed(d, ["doc_id"], 9, 2000).orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        R.distance(F.lit(1), F.lit(1), "other")


def test_lexicon(spark, tmp_path):
    rules = spark.createDataFrame([(0, "run", False, 1), (1, "run", False, 2), (2, "ru", True, 1), (3, "r", True, 1), (4, "run", False, 9)], "rule_id int, pattern string, is_prefix boolean, cat_id int")
    cats = spark.createDataFrame([(1, "A"), (2, "B")], "cat_id int, name string")
    texts = spark.createDataFrame([(1, "run rat"), (2, ""), (3, None)], "video_id int, text string")
    got = {(r["video_id"], r["name"]): r["score"] for r in L.category_scores(texts, rules, cats).collect()}
    assert got == {(1, "A"): 200.0, (1, "B"): 50.0, (2, "A"): 0.0, (2, "B"): 0.0, (3, "A"): 0.0, (3, "B"): 0.0}
    path = tmp_path / "lexicon.dic"
    path.write_text("%\n1 first\n2\tsecond one\n%\nnew york*\t1 2\nbroken\nru* 1\n")
    names, parsed = IO.read_lexicon(spark, str(path))
    assert sorted(map(tuple, names.collect())) == [(1, "first"), (2, "second one")]
    assert sorted((r["pattern"], r["is_prefix"], r["cat_id"]) for r in parsed.collect()) == [("new york", True, 1), ("new york", True, 2), ("ru", True, 1)]
    (tmp_path / "bad.dic").write_text("%\n1 a\n")
    with pytest.raises(ValueError):
        IO.read_lexicon(spark, str(tmp_path / "bad.dic"))


def deltas(spark, **features):
    return spark.createDataFrame([(f, float(x)) for f, xs in features.items() for x in xs], "feature string, delta double")


def test_recorded_signed_ranks(spark):
    rows = deltas(
        spark,
        insight=[-i for i in range(1, 14)],
        female=[*range(1, 12), 0, 0],
        swear=[1, 2, 3, 4] + [0] * 9,
        they=[1] + [0] * 12,
        male14=[-1, -2, 3, *[-i for i in range(4, 12)], 0, 0, 0],
        flat=[0, 0, 0, 0],
        two=[1, 2],
    )
    p = {r["feature"]: r["p_raw"] for r in A.signed_rank(rows).collect()}
    assert p["insight"] == pytest.approx(0.000244140625, abs=1e-12)
    assert p["female"] == pytest.approx(0.0009765625, abs=1e-12)
    assert p["swear"] == pytest.approx(0.125, abs=1e-12)
    assert p["they"] == 1.0 and p["flat"] == 1.0 and p["two"] == 1.0
    assert p["male14"] == pytest.approx(0.0076457617, abs=1e-9)


def test_false_discovery(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.2), ("len", 0.0)], "feature string, p_raw double")
    got = {r["feature"]: r["p_fdr_bh"] for r in A.false_discovery(rows).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in {"a": 0.04, "b": 0.0533333, "c": 0.0533333, "d": 0.2}.items()}


def test_residuals_and_correlation_p(spark):
    rows = spark.createDataFrame([("f", float(x), float(y)) for x, y in zip((1, 2, 3, 4), (2, 1, 4, 5))], "feature string, delta_len double, delta double")
    got = sorted(A.residuals(rows).collect(), key=lambda r: r["delta_len"])
    assert (got[0]["intercept"], got[0]["slope"]) == (pytest.approx(0), pytest.approx(1.2))
    assert [r["residual"] for r in got] == pytest.approx([0.8, -1.4, 0.4, 0.2])
    # Student's t with 2 degrees has a closed form: p = 1 - |r| for n = 4.
    assert A.correlation_p([0.3], [4])[0] == pytest.approx(0.7) and math.isnan(A.correlation_p([0.3], [2])[0])


def test_soft_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.05, (30, 16)) for m in (-3, 0, 3)])
    found = soft_clusters(x)
    assert set(np.concatenate(found)) == set(range(90)) and len(found) >= 3
    tokens = np.full(90, 100)
    assert all(tokens[c].sum() <= 1500 or len(c) == 1 for c in clusters_within_budget(x, tokens, how=Clustering(budget=1500)))
    assert [list(c) for c in soft_clusters(x[:5])] == [[0, 1, 2, 3, 4]]


def test_tree(spark):
    from transcript_jobs.functions.text import sentences_latin, tokens
    from transcript_jobs.operators.models import hashed_embedding

    text = " ".join(f"Word{i % 7} number{i} stands here." for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, "Short."), (3, None)], "doc_id long, text string")
    nodes, edges = build_tree(docs, lambda c: hashed_embedding(tokens(c)), lambda c: F.substring(c, 1, 60), most_tokens=20, sentences=sentences_latin, how=Clustering(budget=200))
    rows = nodes.select("doc_id", "node_id", "layer").collect()
    ids = [r["node_id"] for r in rows if r["doc_id"] == 1]
    assert sorted(ids) == list(range(len(ids))) and max(r["layer"] for r in rows) >= 1
    children = {r["child_id"] for r in edges.where("doc_id = 1").collect()}
    assert {r["node_id"] for r in rows if r["doc_id"] == 1 and r["layer"] == 0} <= children
    assert [(r["layer"]) for r in rows if r["doc_id"] == 2] == [0]


def test_recursive_summary(spark):
    half = lambda prompts: [p[-1]["content"].split("\n\n", 1)[1][::2] for p in prompts]
    docs = spark.createDataFrame([(1, "あいう。" * 300), (2, "短い。"), (3, None)], "video_id int, transcript string")
    got = {r["video_id"]: r for r in recursive_summary(docs, half, most_chars=200, final_chars=300, final_pass=False).collect()}
    assert got[2]["summary"] == "短い。" and got[3]["summary"] == "" and got[1]["rounds"] >= 2 and len(got[1]["summary"]) <= 300
    same = lambda prompts: [p[-1]["content"].split("\n\n", 1)[1] for p in prompts]
    stuck = {r["video_id"]: r["rounds"] for r in recursive_summary(docs, same, most_chars=200, final_chars=300, max_rounds=2).collect()}
    assert stuck[1] == 2


def test_embeddings_of_length_one(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "", None] * 7)], "id int, text string").coalesce(1)
    asked = lambda batch: [[3.0 * len(t), 4.0 * len(t), 0.0 * len(batch)] for t in batch]
    got = {r["id"]: r["embedding"] for r in embed(texts, asked, normalise=True).collect()}
    assert all(got[i] == pytest.approx([0.6, 0.8, 0.0] if i % 3 == 0 else [0.0] * 3) for i in range(21))
    assert {tuple(r["embedding"]) for r in embed(texts, asked).collect()} == {(6.0, 8.0, 0.0), (0.0, 0.0, 0.0)}
