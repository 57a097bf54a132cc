"""Stems, common subsequences, aligned quotes, overlaps and sentence pairs against plain forms of the same."""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from transcript_jobs.functions.stems import stem, stems
from transcript_jobs.operators import quality as Q
from transcript_jobs.operators import screening as X
from transcript_jobs.plans import queries as core
from test_plain import data, run  # noqa: F401

#: Words and their stems, from the description of the algorithm and its exceptions.
STEMS = """caresses caress|ponies poni|ties tie|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl
sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|skies sky|relational relat|conditional condit|rational ration|valenci valenc
hesitanci hesit|digitizer digit|conformabli conform|radicalli radic|differentli differ|vileli vile|analogousli analog|vietnamization vietnam|predication predic|operator oper|feudalism feudal
decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl|triplicate triplic|formative form|formalize formal|electriciti electr
electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit
replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler
probate probat|rate rate|cease ceas|controll control|roll roll|dying die|died die|dies die|tried tri|flies fli|enjoy enjoy|say say|cry cri|crying cri|news news|innings inning
generalizations gener|oscillators oscil|archaeology archaeolog|cheerfully cheer|ion ion|bees bee|as as|is is|be be|yes ye|lying lie|succeed succeed|toys toy|playing play|employment employ"""


def test_worked_stems():
    pairs = [p.split(" ") for line in STEMS.split("\n") for p in line.split("|")]
    assert {w: stem(w) for w, _ in pairs} == dict(pairs)


def test_stems_of_arrays(spark):
    rows = spark.createDataFrame([(["running", "was", "dogs", "dogs", "the", "2020s"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in rows.select(stems(F.col("w"))).collect()] == [["run", "was", "dog", "dog", "the", "2020"], [], None]


def plain_rouge(a, b, n):
    a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (a, b))
    hit = sum((a & b).values())
    return 2 * hit / (sum(a.values()) + sum(b.values())) if hit else 0.0


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_stemmed_scores(spark, data):  # noqa: F811
    import re

    words = lambda t: [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", t.lower())]
    want = {}
    for i, t in data[1].items():
        if t is not None:
            a, b = words(t[: len(t) // 2]), words(t[len(t) // 2 :])
            n = plain_common(a, b)
            want[i] = [plain_rouge(a, b, 1), plain_rouge(a, b, 2), 2 * n / (len(a) + len(b)) if n else 0.0]
    assert {r[0]: list(r[1:]) for r in run(spark, data, "q1_rouge_stemmed", "pair_id", "rouge1", "rouge2")} == {i: pytest.approx(w[:2], abs=1e-6) for i, w in want.items()}
    assert dict(run(spark, data, "q2_rouge_l_stemmed", "pair_id", "rougeL")) == {i: pytest.approx(w[2], abs=1e-6) for i, w in want.items()}
    means = {r[0]: r[1:] for r in run(spark, data, "q2_stemmed_means", "model", "n_samples", "avg_rouge1", "avg_rouge2", "avg_rougeL")}
    for lang, odd in (("en", 1), ("ja", 0)):
        rows = [w for i, w in want.items() if i % 2 == odd]
        assert means[lang] == (len(rows), *(pytest.approx(sum(c) / len(rows), abs=1e-5) for c in zip(*rows)))


def test_common_length_of_long_lists():
    rnd = random.Random(3)
    a, b = ([rnd.randrange(40) for _ in range(n)] for n in (700, 500))
    assert Q.common_length(a, b) == Q.common_length(b, a) == plain_common(a, b)
    start = time.time()
    Q.common_length([rnd.randrange(5000) for _ in range(20_000)], [rnd.randrange(5000) for _ in range(20_000)])
    assert time.time() - start < 5


def plain_align(q, s):
    """Every sentence and every two neighbours put to the matcher."""
    ratio = lambda x: SequenceMatcher(None, q, x).ratio()
    score, at = 0.0, -1
    for k, x in enumerate(s):
        if x and ratio(x) > score:
            score, at = ratio(x), k
    if score < 0.95:
        for k, x in enumerate(a + b for a, b in zip(s, s[1:])):
            r = 1.0 if q in x else ratio(x)
            if r > score:
                score, at = r, k
            if q in x:
                break
    return score, at


def test_alignment_equals_the_matcher_on_every_sentence():
    rnd = random.Random(11)
    quotes, sentences = [], []
    for k in range(300):
        letters = "ab" if k % 3 == 0 else "abcdefgh "
        line = lambda n: "".join(rnd.choice(letters) for _ in range(n))
        s = [line(rnd.randrange(0, 40 if k % 5 else 260)) for _ in range(rnd.randrange(0, 12))]
        joined = "".join(s)
        at = rnd.randrange(len(joined) + 1)
        q = list(joined[at : at + rnd.randrange(1, 70)] or "x")
        for _ in range(rnd.randrange(0, 6)):
            q[rnd.randrange(len(q))] = rnd.choice(letters)
        quotes.append("".join(q))
        sentences.append(s)
    found = X.align_rest(pd.Series(quotes), pd.Series(sentences))
    # No sentence holds its quote where the matcher is asked.
    asked = [k for k, (q, s) in enumerate(zip(quotes, sentences)) if not any(q in x for x in s)]
    assert len(asked) > 150
    for k in asked:
        assert (found["score"][k], found["at"][k]) == plain_align(quotes[k], sentences[k])


def test_overlaps():
    rnd = random.Random(4)
    for _ in range(3000):
        text, part = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 14))) for _ in "12")
        least = rnd.randrange(1, 5)
        want = next((n for n in range(min(len(text), len(part)), least - 1, -1) if text.endswith(part[:n])), 0)
        assert X.overlap(text, part, least) == want


@pytest.mark.parametrize("unit", ["ab", "abcdefghij klm nopq", "a" * 50 + "b"])
def test_long_fragments_merge_in_time(unit):
    one = (unit * 1_000_000)[:1_000_000]
    a, b = one + "x", one[500_000:] + "x" + one
    start = time.time()
    assert X.merge_fragments([a, b]) == one + "x" + one
    assert time.time() - start < 3


def test_pairs_stream_to_a_model(spark):
    def scorer(sources, summaries):
        assert len(sources) == len(summaries) <= 7
        return [len(set(a) & set(b)) / 10 for a, b in zip(sources, summaries)]

    rnd = random.Random(2)
    line = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 6)))
    rows = [(k, "x", [line() for _ in range(rnd.randrange(0, 9))], [line() for _ in range(rnd.randrange(0, 9))]) for k in range(40)] + [(1, "y", ["a", None], ["a", None]), (99, "x", None, ["a"]), (98, "x", [], ["a"])]
    df = spark.createDataFrame(rows, "id int, first string, m array<string>, s array<string>")
    for block, parts in ((64, None), (2, 3)):
        got = sorted((r["id"], round(r["consistency"], 9)) for r in Q.model_consistency(df, ["id", "first"], "m", "s", scorer, batch=7, block=block, parts=parts).collect())
        share = lambda a, b: len(set(a or "") & set(b or "")) / 10
        assert got == sorted((k, round(sum(max(share(a, b) for a in m) for b in s) / len(s), 9)) for k, _, m, s in rows if m and s)


def test_one_long_document_is_many_rows(spark):
    text = [f"word{k % 50} {k}" for k in range(1500)]
    df = spark.createDataFrame([(1, text, text[:700])], "id int, m array<string>, s array<string>")

    # A batch is far smaller than the million pairs; more than it in a call fails.
    def scorer(a, b):
        if len(a) > 2000:
            raise ValueError("too many at once")
        return [float(x == y) for x, y in zip(a, b)]

    assert Q.model_consistency(df, ["id"], "m", "s", scorer, batch=2000, parts=8).head()["consistency"] == 1.0


def test_stemmed_scores_within_the_row(spark, tmp_path):
    """All three measures as the operators that shuffle have them, one row for each pair though ids repeat, and no row for each word."""
    texts = [("Running dogs ran; the CATS sat", "the dogs are running and a cat sits"), ("", "word"), ("one", "one"), (None, None), ("\u212aelvin \u0130stanbul ran", "kelvin istanbul runs"), ("a b a b a b", "b a b a")]
    pairs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "pair_id int, reference string, prediction string")
    got = {r["pair_id"]: r["s"] for r in pairs.select("pair_id", Q.stemmed_f1(F.col("reference"), F.col("prediction")).alias("s")).collect()}
    for n in (1, 2):
        for r in Q.rouge_n(pairs, n, ["pair_id"], stem=True).collect():
            assert got[r["pair_id"]][f"rouge{n}"] == r["f1"]
    tokens = [[stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (t or "").lower())] for t in sum(texts, ())]
    for i, (a, b) in enumerate(zip(tokens[::2], tokens[1::2])):
        n = plain_common(a, b)
        assert got[i]["rougeL"] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0)
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (1, "a dog ran, a dog ran", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = core.QUERIES["q2_stemmed_means"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["n_samples"] for r in found.collect()] == [2] and "Join" not in plan and "Generate" not in plan
