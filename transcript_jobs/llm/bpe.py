"""Byte-level BPE on numpy arrays: encoding by speculation, exact merging, decoding, and counting."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.batches import Memo, gather, text_blocks
from transcript_jobs.llm.pretokens import cut_pieces
from transcript_jobs.llm.ragged import NEVER, merge_words


#: Bytes of text handled at once. What a block needs stays with the Python worker.
BLOCK_BYTES = 1_000_000
#: Bytes from which a word that fails is merged with a heap instead of in rounds; both give the same tokens.
LONG_WORD = 256


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of byte-level BPE."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def tokenizer_text(spark: SparkSession, path: str) -> str:
    """A tokenizer's file: a few MB, whatever the corpus. A path without a scheme is the driver's own."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).head()[0]
    with open(path, encoding="utf-8") as f:
        return f.read()


#: What a tokenizer's file must say of how it works, each with the values that mean what is done here.
KNOWN = {
    "normalizer": [None],
    "pre_tokenizer.type": ["ByteLevel"],
    "pre_tokenizer.add_prefix_space": [False],
    "pre_tokenizer.use_regex": [True, None],
    "decoder.type": ["ByteLevel"],
    "model.type": ["BPE", None],
    "model.dropout": [None, 0.0],
    "model.continuing_subword_prefix": [None, ""],
    "model.end_of_word_suffix": [None, ""],
    "model.byte_fallback": [False, None],
    "model.ignore_merges": [False, None],
}


def check_shape(spec: dict) -> None:
    """Refuse a tokenizer that works otherwise than plain byte-level BPE, as its ids would be wrong."""
    for name, good in KNOWN.items():
        part = spec
        for key in name.split("."):
            part = (part or {}).get(key)
        if not any(part is g or part == g and type(part) is type(g) for g in good):
            raise ValueError(f"this tokenizer has {name} = {part!r}; byte-level BPE with {good[0]!r} is supported")
    for token in spec["added_tokens"]:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"this tokenizer matches {token['content']!r} by more than its string")


class Tree:
    """The tree of the tokens' bytes: a table of its edges, by the node above and the byte."""

    def __init__(self, id_of: dict[bytes, int]):
        node, keys = {b"": 0}, []
        for token in id_of:
            for k in range(1, len(token) + 1):
                if token[:k] not in node:
                    keys.append(node[token[: k - 1]] << 8 | token[k - 1])
                    node[token[:k]] = len(keys)
        # The last one stands for no node.
        self.token = np.full(len(keys) + 2, -1, np.int32)
        for token, i in id_of.items():
            self.token[node[token]] = i
        keys, n_bits = np.array(keys, np.int64), max(8, len(keys).bit_length() + 2)
        self.shift, self.mask = 64 - n_bits, (1 << n_bits) - 1
        self.key, self.child = np.full(1 << n_bits, -1, np.int64), np.full(1 << n_bits, -1, np.int32)
        # Edges whose place is taken try the next one, all at once.
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.key[at] < 0
            self.key[at[free]] = keys[left[free]]
            mine = self.key[at] == keys[left]
            self.child[at[mine]] = left[mine] + 1
            left, at = left[~mine], at[~mine] + 1 & self.mask

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node below each node by a byte, or -1."""
        key = node.astype(np.int64) << 8 | byte
        at = self.place(key)
        there, out = self.key[at], self.child[at]
        todo = np.flatnonzero(there != key)
        out[todo] = -1
        todo = todo[there[todo] >= 0]
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            there = self.key[at[todo]]
            found = there == key[todo]
            out[todo[found]] = self.child[at[todo[found]]]
            todo = todo[~found & (there >= 0)]
        return out


class Vocabulary:
    """A tokenizer's tokens and merges as arrays.

    The ranks of the merges rise from a token's parts to the token, so merges are
    applied in the order of their ranks and a token's edges grow in that order too.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        check_shape(spec)
        model = spec["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.size = size
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        ids = {token: i for token, i in model["vocab"].items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.byte_id[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        self.keys = left * size + right
        order = np.argsort(self.keys)
        self.keys, self.key_rank, self.key_made = self.keys[order], order.astype(np.int64), made[order]
        self.id_of = {self.bytes[i]: i for t, i in ids.items() if t not in self.special}
        self.reach: dict[bytes, int] = {}
        for b in self.id_of:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))
        self._left, self._right, self._made = left, right, made

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's merge (NEVER if there is none) and its place among the sorted merges."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER), at

    @property
    def edges(self):
        """For each token the tokens that stand at its right and its left edge while it is built, and when each comes to be."""
        if not hasattr(self, "_edges"):
            born = np.full(self.size, -1, np.int64)
            parts: dict[int, tuple[int, int]] = {}
            for r, (a, b, m) in enumerate(zip(self._left.tolist(), self._right.tolist(), self._made.tolist())):
                if m not in parts:
                    parts[m], born[m] = (a, b), r
            sides = []
            for side in (1, 0):
                chains: list[list[int]] = [[i] for i in range(self.size)]
                for m in sorted(parts, key=lambda t: born[t]):
                    chains[m] = [*chains[parts[m][side]], m]
                deep = max(map(len, chains))
                token = np.zeros((self.size, deep), np.int64)
                until = np.full((self.size, deep), NEVER, np.int64)
                for i, chain in enumerate(chains):
                    token[i, : len(chain)] = chain
                    until[i, : len(chain) - 1] = born[chain[1:]]
                sides += [token, until]
            self._edges = sides
        return self._edges

    @property
    def tree(self) -> Tree:
        if not hasattr(self, "_tree"):
            self._tree = Tree(self.id_of)
        return self._tree

    @property
    def token_bytes(self) -> pa.Array:
        if not hasattr(self, "_token_bytes"):
            self._token_bytes = pa.array(self.bytes, pa.binary())
        return self._token_bytes

    @property
    def whole(self) -> np.ndarray:
        """Whether the bytes of a token merge to that token."""
        if not hasattr(self, "_whole"):
            self._whole = np.array([bool(b) and self.merge(b) == [i] for i, b in enumerate(self.bytes)])
        return self._whole

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of two tokens merge to just these two.

        Follows both edges at the border in the order in which they grow; the pair
        does not fit if at some time the two edge tokens merge before either grows.
        Of equal merges the one further left comes first.
        """
        right, right_until, left, left_until = self.edges
        i, j, ok = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.ones(len(a), bool)
        todo = np.arange(len(a))
        while len(todo):
            x, y, p, q = a[todo], b[todo], i[todo], j[todo]
            grow_left, grow_right = right_until[x, p], left_until[y, q]
            rank, _ = self.lookup(right[x, p], left[y, q])
            clash = (rank < grow_left) & (rank <= grow_right) & (rank < NEVER)
            ok[todo[clash]] = False
            go = ~clash & ((grow_left < NEVER) | (grow_right < NEVER))
            first = grow_left <= grow_right
            i[todo[go & first]] += 1
            j[todo[go & ~first]] += 1
            todo = todo[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, the leftmost of equals, with a heap so that long words stay cheap."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], k, *p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            r = after[k]
            if ids[k] != a or r >= n or ids[r] != b:
                continue
            ids[k], ids[r] = self.rank[a, b][1], -1
            after[k] = after[r]
            if after[k] < n:
                before[after[k]] = k
                if (p := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], k, *p))
            if before[k] >= 0 and (p := (ids[before[k]], ids[k])) in self.rank:
                heapq.heappush(heap, (self.rank[p][0], before[k], *p))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=4)
def vocabulary(text: str) -> Vocabulary:
    """One per Python worker and tokenizer."""
    return Vocabulary(text)


class Encoder:
    """Encodes texts piece by piece: guess, check all guesses at once, merge where a guess fails."""

    def __init__(self, v: Vocabulary, memory: int = 120_000):
        self.v, self.pieces = v, Memo(memory)
        self.special = {t.encode(): np.array([i], "<i4").tobytes() for t, i in v.special.items()}

    def guess(self, word: bytes) -> list[int]:
        """The longest token at each place, from the left; ``reach`` is the length of the longest token with these two first bytes."""
        out, at, n, ids, reach = [], 0, len(word), self.v.id_of, self.v.reach
        while at < n:
            stop = min(n, at + reach.get(word[at : at + 2], 1))
            while (i := ids.get(word[at:stop])) is None:
                stop -= 1
            out.append(i)
            at = stop
        return out

    def guess_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``guess`` of many words at once, one word after the other, and how many tokens each has.

        All words walk down the tree of the tokens together, a byte a step; one that
        cannot go on takes the longest token that it met and begins again after it.
        """
        tree, n_bytes = self.v.tree, np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(n_bytes)
        token = np.full(len(raw), -1, np.int32)
        mine = np.flatnonzero((n_bytes > 0) & (n_bytes <= LONG_WORD))
        at, end = ends[mine] - n_bytes[mine], ends[mine]
        begin, stop, best, node = at.copy(), at.copy(), np.full(len(at), -1, np.int32), np.zeros(len(at), np.int32)
        while len(at):
            node = tree.step(node, raw[at])
            met, at = tree.token[node], at + 1
            good = met >= 0
            best, stop = np.where(good, met, best), np.where(good, at, stop)
            stuck = np.flatnonzero((node < 0) | (at == end))
            if len(stuck):
                token[begin[stuck]] = best[stuck]
                node[stuck] = 0
                begin[stuck] = at[stuck] = stop[stuck]
                go = np.ones(len(at), bool)
                go[stuck[stop[stuck] == end[stuck]]] = False
                at, end, begin, stop, best, node = (x[go] for x in (at, end, begin, stop, best, node))
        for k in np.flatnonzero(n_bytes > LONG_WORD).tolist():
            where = int(ends[k] - n_bytes[k])
            for i in self.guess(words[k]):
                token[where] = i
                where += len(self.v.bytes[i])
        n_tokens = np.concatenate([[0], np.cumsum(token >= 0)])
        return token[token >= 0].astype(np.int64), n_tokens[ends] - n_tokens[ends - n_bytes]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes of 32-bit integers."""
        flat, sizes = self.guess_all(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, which = np.unique(flat[inside] * self.v.size + flat[inside + 1], return_inverse=True)
        fits = self.v.fit(pairs // self.v.size, pairs % self.v.size)
        bad = np.zeros(len(words), bool)
        bad[owner[inside[~fits[which]]]] = True
        bad[owner[~self.v.whole[flat]]] = True
        raw, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        out = [raw[s:e] for s, e in zip([0, *ends], ends)]
        again = np.flatnonzero(bad).tolist()
        # Rounds over all words at once pay for short words; a long one would need many, and is merged alone.
        for k in [k for k in again if len(words[k]) > LONG_WORD]:
            out[k] = np.array(self.v.merge(words[k]), "<i4").tobytes()
        again = [k for k in again if len(words[k]) <= LONG_WORD]
        merged, sizes = merge_words(self.v, [words[k] for k in again])
        raw, ends = merged.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        for k, s, e in zip(again, [0, *ends], ends):
            out[k] = raw[s:e]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which the texts are encoded, all ids, and where each text's ids end."""
        n_pieces, piece_of, pieces = cut_pieces(texts, list(self.v.special))
        ids = self.pieces.get_all(pieces)
        missing = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(missing, self.encode_words([pieces[k] for k in missing])):
            ids[k] = self.special.get(pieces[k], x)
            self.pieces.put(pieces[k], ids[k])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<i4")
        at, after = gather(np.cumsum(sizes) - sizes, sizes, piece_of)
        return np.arange(len(texts)), flat[at], np.concatenate([[0], after])[n_pieces]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids that end at ``ends``; what is no UTF-8 is replaced."""
        _, at, data = self.v.token_bytes.take(pa.array(ids)).buffers()
        at = np.frombuffer(at, np.int32)[np.concatenate([[0], ends])]
        texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), data])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def encoder(text: str) -> Encoder:
    return Encoder(vocabulary(text))


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts with a byte-level BPE vocabulary and decode the ids again.

    Returns ``id_col``, ``ids`` (array<int>) and ``decoded``, a row for each row. A
    null text counts as empty and has no ids; ids, repeated rows and null ids of
    documents pass through; other columns are left out, whatever their names. A
    special token's string inside a text becomes its id. No shuffle: each task
    encodes its own rows, in blocks of a bounded number of bytes.

    The pieces of a block are cut together, and its distinct ones guessed greedily,
    all at once. Two neighbouring tokens are right if their joined bytes merge to
    just these two, and a piece is right if all its neighbours are. All distinct
    pairs of a block are tested at once; only pieces that fail are merged exactly.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_text(spark, tokenizer_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            order, ids, ends = enc.encode(block.column(1))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(order)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), enc.decode(ids, ends)],
                ["id", "ids", "decoded"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
