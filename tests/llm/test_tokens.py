"""Tokenizing operators against the tokenizers library."""

from __future__ import annotations

import json
import random
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from transcript_jobs.llm import pretokens
from transcript_jobs.llm.bpe import Encoder, Vocabulary, encode_and_decode
from transcript_jobs.llm.ragged import merge_words
from transcript_jobs.llm.token_counts import Counter, count_tokens
from transcript_jobs.llm.token_files import ChunkEncoder, read_token_files, write_token_files

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "B", "the", " ", "  ", "   ", "\n", "\t", "\r\n", " ", "'s", "'RE", "'", "1", "23", "²", "½", "Ⅷ", "é", "é", "É", "日本", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x01", "\x1c", "\x85", "　", "ß", "İ", "_", "!!", "ʰ", "​", "ΑΣ", "\0", "aaaaaaa", " x"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(open(BYTE, encoding="utf-8").read())


@pytest.fixture(scope="module")
def encoders(vocabulary):
    return Encoder(vocabulary), Counter(vocabulary), ChunkEncoder(open(WORD, encoding="utf-8").read())


def in_order(order, ends, ids):
    out = [None] * len(ends)
    for k, (s, e) in enumerate(zip([0, *ends], ends)):
        out[order[k]] = ids[s:e].tolist()
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(max_size=40)), min_size=1, max_size=8))
def test_same_as_library(library, encoders, texts):
    encode, count, chunk = encoders
    want = [e.ids for e in library[BYTE].encode_batch(texts, add_special_tokens=False)]
    order, ids, ends = encode.encode(pa.array(texts, pa.string()))
    assert in_order(order, ends, ids) == want
    order, n = count.count(pa.array(texts, pa.string()))
    assert [int(n[list(order).index(k)]) for k in range(len(texts))] == [len(w) for w in want]
    ids, ends = chunk.encode(pa.array(texts, pa.string()))
    assert in_order(range(len(texts)), ends, ids) == [e.ids for e in library[WORD].encode_batch(texts, add_special_tokens=False)]


def test_pairs_that_fit(vocabulary):
    rng = np.random.default_rng(0)
    a, b = rng.choice(2000, 3000), rng.choice(2000, 3000)
    assert vocabulary.fit(a, b).tolist() == [vocabulary.merge(vocabulary.bytes[x] + vocabulary.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


def test_ragged_merging(vocabulary):
    words = [b"aaaaaaa", b"", b"hello", b"x", b"abcabcabc" * 50, "日本語".encode()]
    ids, sizes = merge_words(vocabulary, words)
    ends = np.cumsum(sizes).tolist()
    assert [ids[s:e].tolist() for s, e in zip([0, *ends], ends)] == [vocabulary.merge(w) for w in words]


def test_long_unspaced_words(library, vocabulary, encoders):
    rng = np.random.default_rng(5)
    word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 50_000))
    want = library[BYTE].encode(word, add_special_tokens=False).ids
    ids, sizes = merge_words(vocabulary, [b"ab", word.encode(), b"", b"zz"])
    ends = np.cumsum(sizes).tolist()
    assert ids[ends[0] : ends[1]].tolist() == want
    encode, count, _ = encoders
    assert encode.encode(pa.array([word]))[1].tolist() == want and count.count(pa.array([word]))[1].tolist() == [len(want)]


def test_words_of_all_lengths_at_once(library, vocabulary, encoders):
    rng = np.random.default_rng(9)
    letters = [list("ab"), list("abcdefghij"), list("etaoinshrdlu"), ["日", "本", "語", "a"], ["aaaa", "b"], ["=", "-"], ["0", "1"]]
    words = ["".join(rng.choice(letters[k % 7], int(rng.integers(0, 900)))) for k in range(140)] + ["a" * n for n in (255, 256, 257, 258, 1001)] + ["", "b"]
    raw = [w.encode() for w in words]
    ids, sizes = merge_words(vocabulary, raw)
    ends = np.cumsum(sizes).tolist()
    assert [ids[s:e].tolist() for s, e in zip([0, *ends], ends)] == [vocabulary.merge(w) for w in raw]
    none, counts = merge_words(vocabulary, raw, symbols=False)
    assert not len(none) and counts.tolist() == sizes.tolist()
    assert encoders[1].count(pa.array(words))[1].tolist() == [len(e.ids) for e in library[BYTE].encode_batch(words, add_special_tokens=False)]


def test_megabytes_without_a_space(library, vocabulary):
    rng = np.random.default_rng(6)
    word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4_000_000))
    start = time.time()
    count = Counter(vocabulary).count(pa.array([word]))[1].tolist()
    assert time.time() - start < 60
    assert count == [len(library[BYTE].encode(word, add_special_tokens=False).ids)]


@pytest.mark.parametrize(
    "change",
    [
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": None},
        {"normalizer": {"type": "NFC"}},
        {"decoder": {"type": "BPEDecoder"}},
        {"model": {"ignore_merges": True}},
        {"model": {"byte_fallback": True}},
        {"model": {"end_of_word_suffix": "</w>"}},
        {"model": {"dropout": 0.1}},
        {"model": {"type": "WordPiece"}},
        {"added_tokens": [{"id": 50256, "content": "<|endoftext|>", "lstrip": True}]},
    ],
)
def test_other_tokenizers_are_refused(change):
    spec = json.load(open(BYTE, encoding="utf-8"))
    spec |= {k: spec["model"] | v if k == "model" else v for k, v in change.items()}
    with pytest.raises(ValueError):
        Vocabulary(json.dumps(spec))


ROWS = [(1, "Hello world <|endoftext|> again", "x"), (2, None, "y"), (2, None, "y"), (3, "", None), (None, "é日本", "z"), (4, "word " * 40_000 + "q" * 20_000, "l")]


@pytest.fixture(scope="module")
def rows(spark):
    # Extra columns with names that the operators use themselves.
    return spark.createDataFrame(ROWS, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1)).withColumn("n_tokens", F.lit(2)).withColumn("id", F.lit(3))


def test_round_trip(spark, library, rows):
    got = encode_and_decode(rows, BYTE)
    assert got.columns == ["doc_id", "ids", "decoded"]
    key = lambda r: (str(r[0]), str(r[1])[:50])
    want = sorted(((i, library[BYTE].encode(t or "", add_special_tokens=False).ids) for i, t, _ in ROWS), key=key)
    found = sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=key)
    assert found == want
    assert sorted(r["decoded"] for r in got.collect()) == sorted(t or "" for _, t, _ in ROWS)
    assert encode_and_decode(rows.limit(0), BYTE).count() == 0


def test_counts(spark, library, rows):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(rows, BYTE).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(library[BYTE].encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS), key=str)
    assert count_tokens(rows.limit(0), BYTE).count() == 0


def test_token_files(spark, library, rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    write_token_files(rows, path, WORD, end_id=2, block_tokens=50)
    got = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read_token_files(spark, path).collect()]
    got.sort(key=lambda r: r[1])
    want = [(i, library[WORD].encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [(i, ids) for i, _, ids in got] == want
    assert [s for _, s, _ in got] == [0, *np.cumsum([len(ids) for _, ids in want]).tolist()[:-1]]
    assert [r["doc_id"] for r in read_token_files(spark, path, [3]).collect()] == [3]
    crc = zlib.crc32(np.array(want[1][1], "<u4").tobytes())
    assert read_token_files(spark, path, [1]).select(F.crc32("ids")).head()[0] == crc
    write_token_files(rows.limit(0), f"file://{tmp_path}/none", WORD, end_id=2)
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.lists(st.sampled_from(["'s", "'ll", "'re", "'", "s", " ", "　", "é", "\n", "1", "<|endoftext|>"]), max_size=12).map("".join), st.text(max_size=40), st.none()), min_size=1, max_size=8), st.integers(0, 7))
def test_pieces_of_all_texts_at_once(texts, skip):
    special = ["<|endoftext|>"]
    texts = texts[skip % len(texts) :]
    ends, codes, distinct = pretokens.cut_pieces(pa.array([*"ab", *texts], pa.string()).slice(2), special)
    cut = pretokens.regex.compile(pretokens.regex.escape(special[0]))
    assert [[distinct[c].decode() for c in codes[s:e]] for s, e in zip([0, *ends], ends)] == [pretokens._pieces(t or "", cut) for t in texts]


def test_pieces_of_every_code_point():
    texts = ["".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 64)]
    ends, codes, distinct = pretokens.cut_pieces(pa.array(texts), [])
    assert [[distinct[c].decode() for c in codes[s:e]] for s, e in zip([0, *ends], ends)] == [pretokens.PIECES.findall(t) for t in texts]


def test_guesses_of_many_words(vocabulary):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeéßö日 ", k=rng.choice([0, 1, 5, 40, 255, 256, 257, 600]))).encode() for _ in range(200)]
    encoder = Encoder(vocabulary)
    flat, sizes = encoder.guess_all(words)
    ends = np.cumsum(sizes).tolist()
    assert [flat[s:e].tolist() for s, e in zip([0, *ends], ends)] == [encoder.guess(w) for w in words]


def test_decoding_of_bytes_that_are_no_text(vocabulary):
    ids = vocabulary.byte_id[[0xC3, 0x41, 0x42]].astype(np.int32)
    assert Encoder(vocabulary).decode(ids, np.array([1, 1, 2, 3])).to_pylist() == ["\ufffd", "", "A", "B"]


def test_new_words_take_few_calls_of_python(library, vocabulary):
    """A corpus goes on having new words; what they cost is what encoding costs."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choices(["th", "en", "er", "ou", "chl", "ñ", "ge", "tion"], k=rng.randrange(3, 8))) for _ in range(20_000)})
    rng.shuffle(words)
    texts = [",%%% ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
    encoder = Encoder(vocabulary)
    encoder.encode(pa.array(["a b"]))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        order, ids, ends = encoder.encode(pa.array(texts))
    finally:
        sys.setprofile(None)
    assert in_order(order, ends, ids) == [e.ids for e in library[BYTE].encode_batch(texts, add_special_tokens=False)]
    assert calls < 12 * len(words)
