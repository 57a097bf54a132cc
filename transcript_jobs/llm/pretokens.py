"""Cutting texts into the pieces that a byte-level BPE tokenizer merges within."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern of the byte-level pre-tokenizer and the spaces of Unicode.
PIECES = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SPACE_RUN = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]\x{20}"


def units(texts: pa.Array, special: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Cut texts at spaces into units that can be tokenized alone.

    Returns the order of the texts, the end of each ordered text among all units,
    the code of each unit, and the distinct units that the codes count. A text is
    cut before each space, which no piece crosses unless a run of white space goes
    on there; texts with such runs, or with a special token's string, are cut into
    pieces one by one. Null texts are empty.
    """
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    odd = pc.match_substring_regex(texts, SPACE_RUN)
    odd = pc.or_(odd, pc.match_substring(texts, "\x01"))
    for s in special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    odd = odd.to_numpy(zero_copy_only=False).astype(bool)
    parts, order = [], np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    if not odd.all():
        plain = texts if not odd.any() else texts.filter(pa.array(~odd))
        parts.append(pc.split_pattern(pc.replace_substring(plain, " ", "\x01 "), "\x01"))
    if odd.any():
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        parts.append(pa.array([_pieces(t, cut) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string())))
    lists = pa.concat_arrays(parts)
    flat = lists.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    return order, ends, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()


def _pieces(text: str, cut) -> list[str]:
    if cut is None:
        return PIECES.findall(text)
    out, at = [], 0
    for m in cut.finditer(text):
        out += PIECES.findall(text[at : m.start()])
        out.append(m[0])
        at = m.end()
    return out + PIECES.findall(text[at:])


LETTER, NUMBER, SPACE = 1, 2, 3


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Letter, number, white space or something else (0), for each code point."""
    every, out = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def kinds_of_bytes(raw: np.ndarray) -> np.ndarray:
    """The kind of the code point that each byte of UTF-8 belongs to."""
    table = kinds()
    out = table[:256].take(raw)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        byte = raw.take(lead + np.arange(4)[:, None], mode="clip").astype(np.int32)
        size = 2 + (byte[0] >= 0xE0) + (byte[0] >= 0xF0)
        code = byte[0] & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            code = np.where(size > k, code << 6 | byte[k] & 0x3F, code)
        kind = table.take(code, mode="clip")
        out[lead] = kind
        for k in (1, 2, 3):
            long = (size > k) & (lead + k < len(raw))
            out[lead[long] + k] = kind[long]
    return out


def cut_pieces(texts: pa.Array, special: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Cut texts into the pieces that ``PIECES`` finds, all texts at once.

    Returns the end of each text among all pieces, the code of each piece, and the
    distinct pieces that the codes count. A special token's string is a piece. Null
    texts are empty. Pieces lie in the texts without a gap, so that each is told by
    where it begins:

    * where the kind changes, but a blank goes with what follows it;
    * at the last white space of several that something follows;
    * around the endings after an apostrophe that begins a piece.
    """
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at, first = at - at[0], int(at[0])
    n = int(at[-1])
    if not n:
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64), []
    data = data.slice(first, n)
    raw = np.frombuffer(data, np.uint8)
    kind = kinds_of_bytes(raw)
    # What begins anew whatever stands before: texts, special tokens and what follows these.
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    whole = [span for s in _special_places(texts, special) for span in s]
    for s, e in whole:
        fresh[[s, e]] = True
    follows = ~fresh[1:n]
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    then = (kind[1:] != SPACE) & follows
    start[1:n] &= ~((raw[:-1] == 0x20) & then)
    last = np.flatnonzero((kind[:-1] == SPACE) & then)
    for _ in range(3):
        last = last - ((raw[last] & 0xC0) == 0x80)
    start[last] = True
    mark = np.flatnonzero((raw[:-1] == 0x27) & start[: n - 1] & follows)
    a, b = raw[mark + 1], np.where(fresh[mark + 2], 0, raw.take(mark + 2, mode="clip"))
    short = np.isin(a, np.frombuffer(b"sdmt", np.uint8))
    long = (a == ord("l")) & (b == ord("l")) | ((a == ord("v")) | (a == ord("r"))) & (b == ord("e"))
    start[mark[short | long] + 1] = False
    start[mark[short] + 2] = True
    start[mark[long] + 3] = True
    for s, e in whole:
        start[s + 1 : e] = False
    cuts = np.flatnonzero(start)
    flat = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), data]).dictionary_encode()
    return np.searchsorted(cuts, at[1:]), flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()


def _special_places(texts: pa.Array, special: list[str]) -> Iterator[list[tuple[int, int]]]:
    """The places of special tokens' strings, in bytes from the first text on, a list for each text with some."""
    found = [pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in special]
    odd = np.flatnonzero(np.any(found, axis=0)) if found else []
    if not len(odd):
        return
    cut = regex.compile(b"|".join(regex.escape(s.encode()) for s in special))
    starts = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    for k in odd.tolist():
        text = texts[k].as_py().encode()
        base = int(starts[k]) - len(text)
        yield [(base + m.start(), base + m.end()) for m in cut.finditer(text)]
