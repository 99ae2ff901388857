"""Vectorised words, word hashes and shingles over Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z folded
to a-z. Its 64-bit hash is a polynomial over per-byte random values, taken from
prefix sums, then mixed; no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 18
SHINGLE = 5


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """The words of some texts in order; text i has hashes[bounds[i]:bounds[i+1]]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray  # byte offsets in the concatenated texts
    ends: np.ndarray
    origins: np.ndarray  # byte offset of each text, and the end
    stops: np.ndarray | None = None  # the byte that was split off a word's end, or 0

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column's texts one after another, and each text's offset; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    blob = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return blob[at[0] : at[-1]], at - at[0]


def words_of(blob: np.ndarray, origins: np.ndarray, stops: bytes = b"") -> Words:
    """The texts' words; with ``stops``, one of these bytes after an ASCII letter is no part of the word before it."""
    n = len(blob)
    space = _SPACE[blob]
    first = np.zeros(n + 1, dtype=bool)  # a text begins here, or ends before here
    first[origins] = True
    word = ~space
    opens, closes = word.copy(), word.copy()
    if n:
        opens[1:] &= space[:-1] | first[1:n]
        closes[:-1] &= space[1:] | first[1:n]
    starts, ends, split = np.flatnonzero(opens), np.flatnonzero(closes) + 1, None
    if stops:
        split = np.zeros(len(ends), np.uint8)
        last, long = blob[ends - 1], ends - starts > 1
        letter = (blob[np.maximum(ends - 2, 0)] | 0x20) - 97 < 26
        cut = np.isin(last, np.frombuffer(stops, np.uint8)) & long & letter
        split[cut] = last[cut]
        ends = ends - cut
    powers, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[blob] * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(hashes, np.searchsorted(starts, origins), starts, ends, origins, split)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most ``limit`` bytes of text, or a single longer one."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def batch_words(batch: pa.RecordBatch, column: str = "text") -> Words:
    return words_of(*text_bytes(batch.column(batch.schema.get_field_index(column))))


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and their bounds by text.

    A text of 1 to k-1 words has one shingle, its whole sequence.
    """
    h, counts = words.hashes, words.counts
    short = (counts > 0) & (counts < k)
    sizes = np.where(short, 1, np.maximum(counts - k + 1, 0))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if len(h) >= k:
        every = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            every *= _STEP
            every += h[j : len(h) - k + 1 + j]
        every = mix(every)
    else:
        every = np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(counts)), sizes)
    within = np.arange(bounds[-1]) - bounds[owner]
    at = words.bounds[owner] + within
    lone = short[owner]
    out = np.empty(len(at), np.uint64)
    out[~lone] = every[at[~lone]]
    for i in np.flatnonzero(short):
        value = len(h[words.bounds[i] : words.bounds[i + 1]])
        for x in h[words.bounds[i] : words.bounds[i + 1]].tolist():
            value = (value * 0xD6E8FEB86659FD93 + x) % 2**64
        out[bounds[i]] = mix(np.array([value ^ 0x5BD1E995], np.uint64))[0]
    return out, bounds


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, dtype=np.int64).view(np.uint64)


def unique_sum(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts (1 each by default)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]
