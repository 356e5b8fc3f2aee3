"""Words of text columns as numpy arrays: a whole Arrow batch at a time, without a Python object per word.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Words are
identified by 64-bit hashes, computed from prefix sums of a polynomial over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text handled at once inside a task; a single longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000
CHUNK_ROWS = 50_000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.default_rng(20_11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values one to one (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverse_powers", pow(_BASE, -1, 2**64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.cumprod(table, dtype=np.uint64)
    return _powers, _inverse_powers


@dataclass
class Words:
    """Words of consecutive texts. `first` has, for each text, the number of its first word, and one more entry at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool) -> np.ndarray:
        """64-bit hash of each word; with lower, A-Z count as a-z."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        powers, inverse = _power_tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        codes = _BYTE_CODES[_LOWER] if lower else _BYTE_CODES
        np.cumsum(codes[self.data] * powers[: len(self.data)], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * inverse[self.start])

    def texts(self, keep: np.ndarray, which: int) -> bytes:
        """The words of one text for which keep holds, joined by a space."""
        a, b = self.first[which], self.first[which + 1]
        raw = self.data.tobytes()
        return b" ".join(raw[s:e] for s, e, k in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), keep[a:b].tolist(), strict=True) if k)


def find_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest runs of bytes that a table of 256 booleans holds true, within the texts data[offsets[i]:offsets[i + 1]]."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = inside[data]
    starts = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # the end of a text ends a run
    starts[edges] = solid[1:-1][edges]
    ends[edges - 1] = solid[1:-1][edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]."""
    start, end = find_runs(data, offsets, ~_BLANK)
    return Words(data, start, end, np.searchsorted(start, offsets))


def text_batches(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive portions of a text column, one text at least in each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, min(a + CHUNK_ROWS, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1))
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) over a text column; null counts as empty."""
    a = 0
    for data, offsets in text_batches(column, limit):
        yield a, a + len(offsets) - 1, find_words(data, offsets)
        a += len(offsets) - 1


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places are left out. The caller leaves out those that cross texts."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(pow(_BASE, 2 * j + 3, 2**64))
    return mix64(out)


def whole_grams(words: Words, k: int) -> np.ndarray:
    """For each place of grams(): whether its k words belong to one text."""
    n = max(0, len(words.start) - k + 1)
    end_of = np.repeat(words.first[1:], words.counts)[:n]
    return np.arange(n) + k <= end_of
