"""Merging many words at once as ragged arrays of symbols."""

from __future__ import annotations

import heapq

import numpy as np

NEVER = np.int64(1) << 40

#: Bytes beyond which words are merged rank by rank: a round over all symbols would be one of thousands for them.
LONG = 256


def merge_words(v, words: list[bytes], symbols: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that each word has left when all merges are done, one word after the other, and how many.

    In each round every word applies its own lowest-ranked pair, wherever it stands in
    the word, the leftmost of overlapping ones first. Words over ``LONG`` bytes take
    their rounds apart from the others. Without ``symbols`` only the counts are kept.
    """
    long = np.array([len(w) > LONG for w in words], bool)
    if not long.any():
        return merge_in_rounds(v, words, symbols)
    found = [merge_in_rounds(v, [w for w, x in zip(words, long) if not x], symbols), merge_by_rank(v, [w for w, x in zip(words, long) if x])]
    counts = np.zeros(len(words), np.int64)
    for which, (_, n) in zip((~long, long), found):
        counts[which] = n
    if not symbols:
        return np.zeros(0, np.int64), counts
    owner = np.concatenate([np.repeat(np.flatnonzero(which), counts[which]) for which in (~long, long)])
    return np.concatenate([x for x, _ in found])[np.argsort(owner, kind="stable")], counts


def merge_by_rank(v, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``merge_words``, but a round touches the places of one rank alone.

    Symbols keep their places and links to the symbols before and after. Places wait
    by the rank of the pair that begins there; the lowest rank that waits is the
    lowest of every word that has it, as a pair with a merged symbol ranks above the
    pair that made it.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbol = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    word = np.append(np.repeat(np.arange(len(words), dtype=np.int64), sizes), -1)
    after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
    rank, made = np.full(n, NEVER), np.zeros(n, np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def look(at: np.ndarray) -> None:
        rank[at] = NEVER
        at = at[word[at] == word[after[at]]]
        rank[at], which = v.lookup(symbol[at], symbol[after[at]])
        made[at] = v.key_made[which]
        at = at[rank[at] < NEVER]
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for places in np.split(at, cuts) if len(at) else ():
            r = int(rank[places[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(places)

    look(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        pos = np.concatenate(waiting.pop(r))
        pos = np.unique(pos[alive[pos] & (rank[pos] == r)])
        if not len(pos):
            continue
        # Of places that follow each other directly every second one merges, the first before all.
        k = np.arange(len(pos))
        begins = np.concatenate([[True], after[pos[:-1]] != pos[1:]])
        pos = pos[(k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0]
        gone = after[pos]
        symbol[pos], alive[gone] = made[pos], False
        after[pos] = after[gone]
        before[after[pos]] = pos
        left = before[pos]
        look(np.unique(np.concatenate([pos, left[left >= 0]])))
    return symbol[alive], np.bincount(word[:-1][alive], minlength=len(words))


def merge_in_rounds(v, words: list[bytes], symbols: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """As ``merge_words``, with all words in one flat array that each round goes through; a word leaves when no pair is left."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = sizes.copy()
    symbol = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    place = np.arange(len(symbol))
    # Rank and result of the pair that begins at each symbol; a word's last symbol begins none.
    rank, made = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int64)

    def look(at: np.ndarray) -> None:
        rank[at], which = v.lookup(symbol[at], symbol[at + 1])
        made[at] = v.key_made[which]

    look(np.flatnonzero(word[1:] == word[:-1]))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbol))))
        live = lowest < NEVER
        if symbols and not live.all():
            done.append((place[~live], symbol[~live]))
        pos = np.flatnonzero(live & (rank == lowest))
        if not len(pos):
            break
        begins = np.concatenate([[True], pos[1:] != pos[:-1] + 1])
        run_at = np.maximum.accumulate(np.where(begins, pos, 0))
        pos = pos[(pos - run_at) % 2 == 0]
        counts -= np.bincount(word[pos], minlength=len(words))
        symbol[pos] = made[pos]
        live[pos + 1] = False
        at = (np.cumsum(live) - 1)[pos]
        symbol, word, place, rank, made = symbol[live], word[live], place[live], rank[live], made[live]
        # Only pairs beside a merge are looked up again.
        near = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[near] = NEVER
        near = near[near + 1 < len(symbol)]
        look(near[word[near] == word[near + 1]])
    if not done:
        return np.zeros(0, np.int64), counts
    where, what = (np.concatenate(x) for x in zip(*done))
    return what[np.argsort(where, kind="stable")], counts
