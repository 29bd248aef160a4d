"""Vectorised tokens of whole texts.

Texts come as one Arrow column; words are cut and hashed with numpy over the
column's own bytes, CHUNK_BYTES at a time, so that no Python object per word
exists and memory does not depend on how long the longest text is beyond that
text itself.  A-Z is lower-cased, all other bytes stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Temporary arrays take some 50 bytes for each of these; at 256 KB they fit a core's cache, too.
CHUNK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs of anything but space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Words are runs of a-z, 0-9 and non-ASCII characters (after lower-casing).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False

_PLACES = 4096
_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of the rows first..last-1: row r has hashes[bounds[r-first]:bounds[r-first+1]].

    starts and ends are byte places within `data`, the rows' lower-cased bytes.
    """

    first: int
    last: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def row(self) -> np.ndarray:
        """The row (from 0 within the chunk) of each word."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))


def _cut(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray, first: int, last: int, hashed: bool) -> Words:
    data = _LOWER[raw]
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return Words(first, last, np.zeros(0, np.uint64), np.zeros(last - first + 1, np.int64), empty, empty, data)
    if not hashed:
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[edges - 1] = inside[edges - 1]
        return Words(first, last, np.zeros(0, np.uint64), np.searchsorted(starts, offsets), starts, np.flatnonzero(closes) + 1, data)
    lengths = np.add.reduceat(inside.astype(np.int64), starts)
    place = np.arange(len(data), dtype=np.int64) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
    value = (data.astype(np.uint64) + np.uint64(1)) * _PLACE[place & (_PLACES - 1)]
    if lengths.max() > _PLACES:  # longer words use each multiplier more than once, each time another way
        value *= (np.maximum(place, 0) >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    value[~inside] = 0
    hashes = mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64))
    return Words(first, last, hashes, np.searchsorted(starts, offsets), starts, starts + lengths, data)


def cut_words(texts: pa.Array, separators: np.ndarray = SPACES, hashed: bool = True) -> Iterator[Words]:
    """The words of every row (null: none), in chunks of about CHUNK_BYTES; without hashes where only places are asked for."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, places, body = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        last = min(last, n)
        yield _cut(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], separators, first, last, hashed)
        first = last


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in order, and their bounds by row.

    A row with 1 to k-1 words has one shingle, its whole sequence; a row
    without words has none.
    """
    h, bounds = words.hashes, words.bounds
    count = np.diff(bounds)
    sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(sizes)])
    total = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(total) else 0):
        total += h[j : len(h) - k + 1 + j] * _STEP[j]
    total = mix(total)
    rows = np.flatnonzero(count >= k)
    made = np.zeros(out[-1], np.uint64)
    if len(rows):
        into = np.repeat(out[rows] - bounds[rows], sizes[rows]) * -1 + np.arange(out[-1])[np.repeat(count >= k, sizes)]
        made[np.repeat(count >= k, sizes)] = total[into]
    for r in np.flatnonzero((count > 0) & (count < k)):
        part = h[bounds[r] : bounds[r + 1]]
        made[out[r]] = mix((part * _STEP[32 : 32 + len(part)]).sum(dtype=np.uint64)[None] + np.uint64(len(part)))[0]
    return made, out
