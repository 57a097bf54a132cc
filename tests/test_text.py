"""Worked rows for texts, chunks, prompts and model stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from transcript_jobs.functions import chunks as C
from transcript_jobs.functions import text as T
from transcript_jobs.operators import models as M
from transcript_jobs.operators import prompts as P
from transcript_jobs.operators import select as S


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).head()[0]


def test_clean_description(spark):
    text = "サイト https://ex.jp/a?b=1　参照 。 次  行\n終 www.x.jp"
    assert value(spark, text, T.clean_description) == "サイト 参照。 次 行 終"
    assert value(spark, None, T.clean_description) == ""


@pytest.mark.parametrize("said, verdict", [(" Real\n", "real"), ("xfake", "fake"), ("maybe", "Error"), (None, "Error")])
def test_normal_verdict(spark, said, verdict):
    assert value(spark, said, T.normal_verdict) == verdict


def test_final_answer(spark):
    assert value(spark, "<|channel|>analysis<|message|>x<|end|><|channel|>final<|message|> 要約 <|end|>", T.final_answer) == "要約"
    assert value(spark, "plain", T.final_answer) == "plain"


def test_sentences(spark):
    text = "本当？！はい。「そう。」次です。3.5点. End."
    assert value(spark, text, T.sentences_by_punctuation) == ["本当？！", "はい。「", "そう。」", "次です。", "3.5点.", "End."]
    assert value(spark, "健康です。\n「ほんと？」と言う！次", T.sentences_by_line) == ["健康です。", "「ほんと？」と言う！", "次"]


def test_char_packing():
    assert C.pack_by_chars(["abc", "de", "fghijklm", "no"], 5) == ["abcde", "fghij", "klmno"]
    assert C.pack_by_chars(["abcdefgh", "ij"], 5, hard_slice=False) == ["", "abcdefgh", "ij"]
    assert C.pack_by_chars([], 5) == []


def test_sliding():
    assert C.slide(["aaa", "bbb", "ccc", "ddd", "eee"], 7, 1) == [("aaabbbccc", 0), ("cccdddeee", 2), ("eee", 4)]
    assert [s for _, s in C.slide(["aaa", "bbb", "ccc", "ddd"], 100, 3)] == [0, 1, 2, 3]
    assert [s for _, s in C.slide(["aaa", "bbb", "ccc", "ddd"], 100, 3, emit_tails=False)] == [0]


def test_token_packing():
    count = lambda s: len(s.split())
    assert C.pack_by_tokens(["a b", "c d e f:g h", "i"], 3, 0, count, parity=True) == ["c d e f", "g h", "a bi"]
    assert C.pack_by_tokens(["a b", "c d e f:g h", "i"], 3, 0, count) == ["a b", "c d e f", "g h", "i"]


def test_safe_blocks():
    text = "あ" * 25_000 + "。" + "い" * 50 + "。"
    blocks = C.split_safely(text)
    assert "".join(blocks) == text and max(map(len, blocks)) <= 10_000
    assert C.split_safely("") == []


def test_fit_to_window(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 50), 45), (" ".join(["w"] * 50), 95), (None, 10)], "t string, used int")
    rows = df.select(P.fit_to_window(F.col("t"), F.col("used"), 100, 20).alias("f"), F.lit(1).alias("video_id"))
    got = [r["f"] for r in rows.collect()]
    assert (got[0]["allowed_len"], got[0]["is_truncated"], got[0]["original_len"], len(got[0]["text"].split())) == (35, True, 50, 35)
    assert (got[1]["allowed_len"], got[1]["text"], got[1]["original_len"]) == (0, "", 50)
    assert (got[2]["text"], got[2]["is_truncated"]) == ("", False)
    assert [r["overflow_tokens"] for r in P.truncation_log(rows, "f").collect()] == [15, 50]


def test_fit_with_tokenizer(spark):
    df = spark.createDataFrame([("abcdef", 1)], "t string, used int")
    got = df.select(P.fit_with_tokenizer(F.col("t"), F.col("used"), 5, 1, list, "".join).alias("f")).head()["f"]
    assert (got["text"], got["is_truncated"], got["original_len"], got["allowed_len"]) == ("abc", True, 6, 3)


def test_budgets(spark):
    got = spark.range(1).select(T.chunk_budget(F.lit(900), F.lit(0.2)).alias("b")).head()["b"]
    assert (got["chunk_target"], got["max_tokens"]) == (200, 300)


def test_generate_keeps_going(spark):
    def model(prompts):
        if any(p == "bad" for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, prompt string").coalesce(1)
    got = {r["id"]: (r["output"], r["error"]) for r in M.generate(rows, model, on_error="Error").collect()}
    assert got == {1: ("A", None), 2: ("Error", "no"), 3: ("C", None)}


def test_cache(spark):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3), ("k3", 4)], "key string, n int")
    cache = spark.createDataFrame([("k1", "kept"), ("k3", None)], "key string, output string")
    found, new = M.with_cache(rows, cache, lambda m: m.withColumn("output", F.concat(F.lit("new-"), "key")))
    assert sorted((r["n"], r["output"]) for r in found.collect()) == [(1, "kept"), (2, "new-k2"), (3, "new-k2"), (4, "new-k3")]
    assert sorted(r["key"] for r in new.collect()) == ["k2", "k3"]


def test_first_of_each_and_sample(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "a", "z")], "ord int, id string, v string")
    assert sorted((r["id"], r["v"]) for r in S.first_of_each(rows, "id", "ord").collect()) == [("a", "x"), ("b", "y")]
    many = spark.range(100)
    assert S.seeded_sample(many, "id", 7).collect() == S.seeded_sample(many.orderBy(F.desc("id")), "id", 7).collect()
