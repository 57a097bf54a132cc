"""Core queries that SQL does not express against plain Python, on a small fixture that has Japanese, long, blank, repeated and null texts."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest

from transcript_jobs.functions import chunks as C
from transcript_jobs.plans import queries as core

WORDS = "the cat sat on a mat and 12 dogs, thin (very thin) ran in the zoo; was it 3.5 km? yes! wow... no. 水は体に良い。 癌を防ぐ！」 ええ？！ 終わり".split(" ")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """The folder of the tables, and the texts by id."""
    rng = np.random.default_rng(7)
    text = lambda n: "".join(str(rng.choice(WORDS)) + str(rng.choice([" ", " ", " ", " ", "\n"])) for _ in range(n))
    texts = [text(int(n)) for n in rng.integers(5, 250, 24)] + [text(1500), "", " \n ", None, "?" * 12 + "!a", "no stop at all", "a" * 4000]
    texts += texts[:2]
    path = str(tmp_path_factory.mktemp("plain"))
    docs = [(i, t, "en" if i % 2 else "ja", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    turns = [(c, t, "user" if t % 2 else "assistant", text(3 + t)) for c in range(4) for t in reversed(range(c + 1))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(i, text(12)) for i in range(6)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kinds = ["view", "click", "buy", "error"]
    events = [(i, i % 9 + i % 5, kinds[i % 4], float(np.round(60 + rng.normal(i % 4 - 1, 6), int(rng.integers(0, 3))))) for i in range(600)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path, dict(enumerate(texts)), turns


def run(spark, data, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in core.QUERIES[name](spark, data[0]).collect()), key=repr)


def listed(rows):
    return sorted(rows, key=repr)


def punctuated(t):
    """Sentences, a character at a time."""
    mark = lambda c: unicodedata.category(c).startswith("P")
    digit = lambda k: 0 <= k < len(t) and t[k] in "0123456789"
    out, start, i = [], 0, 0
    while i < len(t):
        if t[i] in "。！？!?｡．.":
            j = i + 1
            while j < len(t) and mark(t[j]):
                j += 1
            if j - i <= 9 and not (t[j - 1] == "." and digit(j - 2) and digit(j)):
                out.append(t[start:j])
                start = i = j
                continue
        i += 1
    return [s.strip() for s in [*out, t[start:]] if s.strip()]


def lined(t):
    out, now = [], ""
    for c, after in zip(t.strip(), [*t.strip()[1:], ""]):
        now += c
        if c in "。！？\n" and (not after or after not in "」』)"):
            out.append(now)
            now = ""
    return [s.strip() for s in [*out, now] if s.strip()]


def latin(t):
    return [s.strip() for s in re.split(r"(?<=[.!?]) +|\n+", t or "") if s.strip()]


def words(t):
    return re.findall(r"[^\W\d_]+", (t or "").lower())


def vector(t):
    v = np.zeros(32)
    for w in words(t):
        v[zlib.crc32(w.encode()) % 32] += 1
    return v / max(np.linalg.norm(v), 1e-300)


def test_sentences(spark, data):
    assert run(spark, data, "t1_sentences_by_punctuation", "doc_id", "pos", "sentence") == listed((i, k, s) for i, t in data[1].items() for k, s in enumerate(punctuated(t or "")))


def test_safe_blocks(spark, data):
    got = defaultdict(dict)
    for i, pos, n in run(spark, data, "t3_safe_blocks", "doc_id", "pos", "n"):
        got[i][pos] = n
    assert {i: sum(got[i].values()) for i in data[1]} == {i: len(t or "") for i, t in data[1].items()}
    assert max(n for d in got.values() for n in d.values()) <= 10_000


@pytest.mark.parametrize(
    "name, columns, cut",
    [
        ("t4_char_chunks", ("doc_id", "pos", "chunk"), lambda t: C.pack_by_chars(punctuated(t), 3000)),
        ("t5_char_chunks_unsliced", ("doc_id", "pos", "chunk"), lambda t: C.pack_by_chars(punctuated(t), 1536, hard_slice=False)),
        ("t6_sliding_chunks", ("doc_id", "pos", "text", "start_idx"), lambda t: C.slide(lined(t), 4000, 3)),
        ("t7_token_chunks", ("doc_id", "pos", "chunk"), lambda t: C.pack_by_tokens(lined(t), 100, 1, C.count_words)),
        ("r1_tree_leaves", ("doc_id", "node_id", "text", "tokens"), lambda t: [(c, C.count_words(c)) for c in C.pack_by_tokens(latin(t), 100, 0, C.count_words)]),
    ],
)
def test_chunks(spark, data, name, columns, cut):
    """The packers themselves are tested on worked rows."""
    flat = lambda c: c if isinstance(c, tuple) else (c,)
    assert run(spark, data, name, *columns) == listed((i, k, *flat(c)) for i, t in data[1].items() for k, c in enumerate(cut(t or "")))


def test_embeddings(spark, data):
    got = dict(run(spark, data, "m2_embed", "doc_id", "embedding"))
    assert set(got) == set(data[1]) and all(np.allclose(got[i], vector(t)) for i, t in data[1].items())


def test_recursive_summaries(spark, data):
    def shorten(t, rounds=0):
        if len(t) <= 3000:
            return t, rounds
        parts = C.pack_by_chars(latin(t), 1500)
        if len(parts) <= 1:
            return parts[0] if parts else t, rounds
        return shorten(" ".join(". ".join(p.split(". ")[::4]) for p in parts), rounds + 1) if rounds < 10 else (t, rounds)

    assert run(spark, data, "m4_recursive_summary", "video_id", "summary", "rounds") == listed((i, *shorten(t or "")) for i, t in data[1].items())

    def smoothed(t):
        """What was joined from parts is put to the model once more."""
        text, rounds = shorten(t)
        return (". ".join(text.split(". ")[::4]) if rounds else text), rounds

    assert run(spark, data, "m4_smoothed_summary", "video_id", "summary", "rounds") == listed((i, *smoothed(t or "")) for i, t in data[1].items())


def rouge(t):
    a, b = words(t[: len(t) // 2]), words(t[len(t) // 2 :])
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    n = table[-1][-1]
    return (n / len(b), n / len(a), 2 * n / (len(a) + len(b))) if n else (0.0, 0.0, 0.0)


def test_longest_common_subsequences(spark, data):
    want = {i: rouge(t) for i, t in data[1].items() if t is not None}
    got = {r[0]: r[1:] for r in run(spark, data, "q2_rouge_l", "pair_id", "precision", "recall", "f1")}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)
    means = {r[0]: r[1:] for r in run(spark, data, "q2_rouge_means", "model", "n_samples", "avg_precision", "avg_recall", "avg_f1")}
    for lang, odd in (("en", 1), ("ja", 0)):
        rows = [s for i, s in want.items() if i % 2 == odd]
        assert means[lang] == (len(rows), *(pytest.approx(x, abs=2e-6) for x in np.mean(rows, axis=0)))


def test_greedy_matches(spark, data):
    got = {r[0]: r[1:] for r in run(spark, data, "q3_greedy_match", "conv_id", "precision", "recall", "f1")}
    for c in range(4):
        v = np.array([vector(t) for _, _, _, t in sorted(x for x in data[2] if x[0] == c)])
        near = v[: (len(v) + 1) // 2] @ v.T
        p, r = near.max(axis=1).mean(), near.max(axis=0).mean()
        assert got[c] == pytest.approx((p, r, 2 * p * r / (p + r) if p + r else 0.0))
    means = {r[0]: r[1:] for r in run(spark, data, "q3_mean_matches", "model", "n_samples", "avg_f1")}
    assert means == {"m0": (2, pytest.approx((got[0][2] + got[3][2]) / 2, abs=1e-5)), "m1": (1, pytest.approx(got[1][2], abs=1e-5)), "m2": (1, pytest.approx(got[2][2], abs=1e-5))}


def screened(data):
    """For each video its quotes as they should be found: (quote, found, context, score, error)."""
    form = lambda s: "".join(c for c in s if not c.isspace() and c not in "、。！？.,!\"'\\")
    out = {}
    for i, t in data[1].items():
        quote = (t or "")[40:100]
        quote = (quote.replace(" the ", " a ") if i % 3 == 0 else quote).strip()
        out[i] = []
        if i % 7 == 0 or t is None or len(quote) < 5:
            continue
        sentences = latin(t)
        q, s = form(quote), [form(x) for x in sentences]
        if not q:
            out[i] = [(quote, False, "", None, "quote_empty")]
            continue
        score, at = next(((1.0, k) for k, x in enumerate(s) if x and q in x), (0.0, -1))
        ratio = lambda x: SequenceMatcher(None, q, x).ratio()
        if at < 0:
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
        found = score >= 0.65 and at >= 0
        out[i] = [(quote, found, "".join(sentences[max(at - 2, 0) : at + 4]) if found else "", round(score, 6), None if found else "low_confidence_match")]
    return out


def test_aligned_quotes(spark, data):
    want = screened(data)
    assert any(not q[1] for qs in want.values() for q in qs) and any(0 < (q[3] or 0) < 1 for qs in want.values() for q in qs)
    assert run(spark, data, "x3_align_quotes", "video_id", "quote", "found", "context", "score", "error") == listed((i, *q) for i, qs in want.items() for q in qs)


def routed(data):
    out = []
    for i, quotes in screened(data).items():
        label, full = ("fake" if i % 4 == 0 else "real"), data[1][i] or ""
        if not quotes:
            out.append((i, label, "auto_real_step1", "", 0))
        elif quotes[0][1] and quotes[0][2].strip():
            out.append((i, label, "llm_partial_context", quotes[0][2], 1))
        else:
            out.append((i, label, "llm_full_transcript" if full.strip() and not quotes[0][1] else "llm_full_transcript_fallback", full, 1))
    return out


def test_routes_and_verdicts(spark, data):
    want = routed(data)
    assert run(spark, data, "x7_route", "video_id", "ground_truth", "logic_type", "context", "step1_flagged_count") == listed(want)
    said = ["real" if kind == "auto_real_step1" or len(c) % 2 else "fake" for _, _, kind, c, _ in want]
    cells = [sum(r[1] == a and s == b for r, s in zip(want, said)) for a in ("real", "fake") for b in ("real", "fake")]
    got = core.QUERIES["x8_screening_verdicts"](spark, data[0]).collect()
    assert len(got) == 1 and got[0]["accuracy"] == pytest.approx((cells[0] + cells[3]) / sum(cells))
    assert got[0]["real_f1"] == pytest.approx(2 * cells[0] / (2 * cells[0] + cells[1] + cells[2])) and got[0]["fake_f1"] == pytest.approx(2 * cells[3] / (2 * cells[3] + cells[1] + cells[2]))


def features(data):
    rows = duckdb.sql(f"SELECT event_type, round(value - 60, 2), (user_id % 7)::DOUBLE FROM read_parquet('{data[0]}/events.parquet/*.parquet')").fetchall()
    return {f: np.array([r[1:] for r in rows if r[0] == f]) for f in {r[0] for r in rows}}


def mean_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def signed_rank(d):
    """Shares of sums of positive ranks below and above, by the normal approximation."""
    d = d[d != 0]
    ranks, n = mean_ranks(np.abs(d)), len(d)
    # The variance of a sum of ranks with random signs is a quarter of the sum of their squares.
    z = (ranks[d > 0].sum() - n * (n + 1) / 4) / math.sqrt((ranks**2).sum() / 4)
    return math.erfc(-z / math.sqrt(2)) / 2, math.erfc(z / math.sqrt(2)) / 2


def test_signed_ranks(spark, data):
    tails = {f: signed_rank(x[:, 0]) for f, x in features(data).items()}
    got = dict(run(spark, data, "a1_signed_rank", "feature", "p_raw"))
    assert set(got) == set(tails) and all(got[f] == pytest.approx(min(1, 2 * min(t)), rel=1e-9) for f, t in tails.items())
    one = {r[:2]: r[2] for r in run(spark, data, "a2_one_sided_rank", "feature", "alternative", "p_raw")}
    assert one == {("view", "less"): pytest.approx(tails["view"][0], rel=1e-9), ("click", "greater"): pytest.approx(tails["click"][1], rel=1e-9)}


def test_correlations(spark, data):
    got = {r[0]: r[1:] for r in run(spark, data, "a5_correlation_tests", "feature", "r", "p", "n")}
    for f, x in features(data).items():
        r, n = np.corrcoef(mean_ranks(x[:, 1]), mean_ranks(x[:, 0]))[0, 1], len(x)
        # The density of r without correlation, summed from |r| to 1.
        grid = np.linspace(-1, 1, 2_000_001)
        density = (1 - grid**2) ** ((n - 4) / 2)
        assert got[f] == (pytest.approx(r), pytest.approx(2 * density[grid >= abs(r)].sum() / density.sum(), rel=1e-3), n)


def test_residual_tests(spark, data):
    got = {r[0]: r[1:] for r in run(spark, data, "a7_residual_tests", "feature", "slope", "intercept", "p_raw")}
    for f, x in features(data).items():
        slope, intercept = np.polyfit(x[:, 1], x[:, 0], 1)
        p = min(1, 2 * min(signed_rank(np.round(x[:, 0] - intercept - slope * x[:, 1], 9))))
        assert got[f] == (pytest.approx(slope), pytest.approx(intercept), pytest.approx(p, rel=1e-3))


def test_two_spaces(spark, data, monkeypatch):
    built = []
    made = core.build_tree
    monkeypatch.setattr(core, "build_tree", lambda *a, **k: built.append(made(*a, **k)) or built[-1])
    got = defaultdict(list)
    for doc, q, node, rank in run(spark, data, "r4_two_spaces", "doc_id", "query_id", "node_id", "rank"):
        got[doc, q].append((rank, node))
    nodes = built[0][0].collect()
    shape = lambda t: np.array([len(t), 1 + sum(c in "aeiou" for c in t)], float)
    for r in nodes:
        assert np.allclose(r["embeddings"]["search"], shape(r["text"])) and np.allclose(r["embeddings"]["cluster"], vector(r["text"])) and r["embedding"] == r["embeddings"]["cluster"]
    asked = [(k, core.QUESTION_FORM.format(q)) for k, q in enumerate(core.QUESTIONS)]
    for doc in {r["doc_id"] for r in nodes}:
        for q, text in asked:
            near = []
            for r in nodes:
                if r["doc_id"] == doc:
                    v, w = shape(r["text"]), shape(text)
                    near.append((1 - v @ w / np.linalg.norm(v) / np.linalg.norm(w), r["node_id"]))
            found = [dict((n, d) for d, n in near)[n] for _, n in sorted(got[doc, q])]
            assert np.allclose(found, [d for d, _ in sorted(near)[:3]], atol=1e-9)


def test_trees_and_searches(spark, data, monkeypatch):
    built = []
    made = core.build_tree
    monkeypatch.setattr(core, "build_tree", lambda *a, **k: built.append(made(*a, **k)) or built[-1])
    layers = {r[:2]: r[2:] for r in run(spark, data, "r4_tree_nodes", "doc_id", "layer", "n_nodes", "tokens")}
    leaves = {i: C.pack_by_tokens(latin(t or ""), 100, 0, C.count_words) for i, t in data[1].items()}
    assert {i: v for (i, layer), v in layers.items() if layer == 0} == {i: (len(c), sum(map(C.count_words, c))) for i, c in leaves.items() if c}
    assert {i for i, layer in layers if layer == 1} == {i for i, c in leaves.items() if len(c) > 11}
    # Every node of a layer but the last has a parent in the next one, whose text its children give.
    nodes = {(r["doc_id"], r["node_id"]): r for r in built[0][0].collect()}
    children = defaultdict(list)
    for e in built[0][1].collect():
        assert nodes[e["doc_id"], e["parent_id"]]["layer"] == nodes[e["doc_id"], e["child_id"]]["layer"] + 1
        children[e["doc_id"], e["parent_id"]].append(e["child_id"])
    assert set(children) == {k for k, r in nodes.items() if r["layer"] > 0}
    one_line = lambda t: re.sub(r"\r?\n", " ", t) + "\n\n"
    for (doc, node), below in children.items():
        assert nodes[doc, node]["text"] == ". ".join("".join(one_line(nodes[doc, c]["text"]) for c in sorted(below)).split(". ")[::4])

    kept = []
    retrieve = core.r15_tree_retrieval
    monkeypatch.setattr(core, "r15_tree_retrieval", lambda *a: kept.append(retrieve(*a)) or kept[-1])
    judged = run(spark, data, "r15_tree_predictions", "doc_id", "true_label", "prediction", "n_chars")
    got = dict((r["doc_id"], r["context_text"]) for r in kept[0].collect())
    asked = [(k, core.QUESTION_FORM.format(q)) for k, q in enumerate(core.QUESTIONS)]
    want = {}
    for doc in {d for d, _ in nodes}:
        contexts = []
        for _, question in asked:
            q, found = vector(question), []
            for (d, n), r in nodes.items():
                if d == doc:
                    v = vector(r["text"])
                    found.append((round(1 - v @ q, 9) if v.any() and q.any() else math.inf, n, r))
            used, parts = 0, []
            for _, _, r in sorted(found, key=lambda x: x[:2])[:9]:
                used += r["tokens"]
                if used <= 2000:
                    parts.append(one_line(r["text"]))
            if "".join(parts).strip(" "):
                contexts.append("".join(parts))
        if contexts:
            want[doc] = "\n\n".join(contexts)
    assert got == want
    verdicts = [(i, len(f"Title: src{i % 3}\nDescription: \nText:\n{c}")) for i, c in want.items()]
    assert judged == listed((i, "fake" if i % 4 == 0 else "real", "fake" if n % 2 else "real", n) for i, n in verdicts)
