"""Vectorised text helpers that run inside tasks: byte views of Arrow columns, words, word hashes.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D), lower-cased
over A-Z only, so UTF-8 sequences stay whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task: bounds the working arrays, not the text (one text is never cut).
CHUNK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) over uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; sorts ``values`` in place, which is much faster than hashing them."""
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them; a null is an empty row."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column`` (name or place); a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = column_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            end = max(start + 1, min(end, batch.num_rows))
            yield batch.slice(start, end - start)
            start = end


class Words:
    """Words of a chunk: bytes lower-cased, ``start``/``end`` offsets, ``row`` of each word, ``hash`` (mixed)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        self.data = _LOWER[data] if fold else data
        n, rows = len(data), len(offsets) - 1
        solid = ~_SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | first[:-1]))
        self.end = np.flatnonzero(solid & (~after | first[1:])) + 1
        #: The first word of each row, and one past the last of all.
        self.row_start = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.row_start)
        self.row = np.repeat(np.arange(rows), self.count)
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self._total, self._inverse = total, inverse
        self.hash = self.heads(0)

    def heads(self, length: int) -> np.ndarray:
        """Hash of each word's first ``length`` bytes, or of the whole word where it is shorter or length is 0."""
        end = np.minimum(self.end, self.start + length) if length else self.end
        return mix((self._total[end] - self._total[self.start]) * self._inverse[self.start])


def row_sums(values: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive rows; 0 for an empty row."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    return total[row_start[1:]] - total[row_start[:-1]]
