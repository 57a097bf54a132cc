"""What a task of the pipeline holds at once, and links of units against brute force."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from transcript_jobs.llm import bpe
from transcript_jobs.llm import near_duplicates as N
from transcript_jobs.llm import toxicity as T
from transcript_jobs.llm.batches import text_blocks


def peak_mb(f) -> float:
    """MB that Python and numpy take at once while ``f`` runs."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def unit(sets, components, sides, same):
    lists = pa.array([np.asarray(x, np.int64) for x in sets], pa.list_(pa.int64()))
    n = len(sets)
    return pa.table({"rep": pa.array(range(n), pa.int64()), "component": pa.array(components, pa.int64()), "side": pa.array(sides, pa.int32()), "same": pa.array([same] * n), "shingles": lists})


def test_a_unit_of_two_blocks_takes_little_memory():
    rng = np.random.default_rng(1)
    sets = [rng.choice(2**62, 300, replace=False) for _ in range(2048)]
    table = unit(sets, range(2048), [1 + k % 2 for k in range(2048)], False)
    assert peak_mb(lambda: N.unit_links(table, 80)) < 60


@pytest.mark.parametrize("same", [True, False])
def test_links_of_a_unit(monkeypatch, same):
    monkeypatch.setattr(N, "MATRIX_CELLS", 100)
    monkeypatch.setattr(N, "JUDGED_CELLS", 50)
    rnd = random.Random(5)
    base = [rnd.sample(range(10**6), 40) for _ in range(6)]
    sets = []
    for k in range(60):
        other = rnd.randrange(0, 6)
        sets.append(sorted({*base[k % 6][other:], *rnd.sample(range(10**6), other)} if k else {*range(900)}))
    sides = [1 if same or k % 4 else 2 for k in range(60)]
    components = [k % 50 for k in range(60)]
    got = N.unit_links(unit(sets, components, sides, same), 80)
    want = []
    for a in range(60):
        for b in range(60):
            x, y = set(sets[a]), set(sets[b])
            if sides[a] == 1 and (same or sides[b] == 2) and components[a] != components[b] and 100 * len(x & y) >= 80 * len(x | y):
                want.append((a, b))

    def groups(links):
        top = list(range(60))
        for _ in range(60):
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        return top

    pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    assert want and set(pairs) <= set(want) and groups(pairs) == groups(want)


def test_large_sets_are_compared_exactly():
    # 100 * common is 5 less than 85 * union; in single precision both would be 85 * union.
    union = next(u for u in range(1_000_013, 4_000_000, 20) if float(np.float32(85 * u - 5)) >= 85 * u)
    common = (85 * union - 5) // 100
    assert 100 * common == 85 * union - 5
    table = unit([np.arange(union), np.arange(common)], [0, 1], [1, 2], False)
    assert N.unit_links(table, 85).num_rows == 0
    table = unit([np.arange(union), np.arange(common + 1)], [0, 1], [1, 2], False)
    assert N.unit_links(table, 85).num_rows == 1


def test_blocks_take_little_memory():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(300_000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert batch.nbytes > 4_000_000

    def sketch():
        for block in text_blocks([batch], limit=N.BLOCK_BYTES):
            N.sketches(*N.shingle_sets(block.column(0), 5), 160)

    encoder = bpe.encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    encoder.encode(pa.array(texts[:1]))

    def encode():
        for block in text_blocks([batch], limit=bpe.BLOCK_BYTES):
            encoder.encode(block.column(0))

    assert peak_mb(sketch) < 15
    assert peak_mb(lambda: list(T.list_grams(1)([batch]))) < 90
    assert peak_mb(encode) < 130
