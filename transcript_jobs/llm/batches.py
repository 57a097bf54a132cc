"""Helpers for Arrow batches of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task; a single longer text is handled alone.
TEXT_BYTES = 5_000_000


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Memo:
    """A dictionary of bounded size that keeps what was used lately: two generations, the older is dropped when the newer is full."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def get_all(self, keys: list) -> list:
        """``get`` of each key."""
        return [self.get(k) if v is None else v for k, v in zip(keys, map(self.young.get, keys))]

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def gather(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of the lists ``codes``, one list after the other, and the end of each list among them."""
    size = lengths[codes]
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, np.int64), ends
    steps = np.ones(int(ends[-1]), np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros(0, np.int64), ends
    first = starts[codes[full]]
    at = ends[full] - size[full]
    steps[at[0]] = first[0]
    steps[at[1:]] = first[1:] - (first[:-1] + size[full[:-1]] - 1)
    return np.cumsum(steps), ends
