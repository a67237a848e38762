"""Vectorised work on Arrow text columns.

A column of texts is one byte buffer with offsets. Words and their hashes are
found for many texts at once, a slice of bounded size at a time, so that the
cost per row is small and the memory does not depend on a batch's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_SPAN = 1 << 20

# White space between words; letters to lower-case.
_BLANK = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[_BLANK] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_P, _PI):
            table = np.full(_SPAN + 1, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-and-shift rounds)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(29))


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
        if isinstance(values, pa.ChunkedArray):
            values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], pa.string())
    if values.null_count:
        values = pc.fill_null(values, "" if not pa.types.is_binary(values.type) else b"")
    if pa.types.is_string_view(values.type):
        values = values.cast(pa.large_string())
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(values) + 1, values.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE, rows: int = 8192) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts and about ``limit`` bytes; a longer
    text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1), i + rows, n)
        yield i, j
        i = j


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of the table's bytes within each
    text; text i has the words first[i] to first[i + 1]."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[buf]
    flag = inside[1:-1]
    begins = flag & ~inside[:-2]
    stops = flag & ~inside[2:]
    edges = off[(off < n)]
    begins[edges] = flag[edges]
    edges = off[off > 0] - 1
    stops[edges] = flag[edges]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    n = len(starts)
    out = np.empty(n, dtype=np.uint64)
    up, down = _power_tables()
    i = 0
    while i < n:
        s0 = starts[i]
        j = int(np.searchsorted(ends, s0 + _SPAN, side="right"))
        if j <= i:  # a word longer than the tables
            word = hashlib.blake2b(buf[s0 : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(word, np.uint64)[0]
            i += 1
            continue
        part = buf[s0 : ends[j - 1]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        at, to = starts[i:j] - s0, ends[i:j] - s0
        out[i:j] = mix((sums[to] - sums[at]) * down[at])
        i = j
    return out


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive word hashes, across texts
    too: the caller leaves out those that cross."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        acc = (acc + h[k : k + n]) * _P
        acc ^= acc >> np.uint64(32)
    return mix(acc)


def shingle_sets(h: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; a text of fewer words has its
    whole sequence as one; one without words has none."""
    full = grams(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(full[a : b - size + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            out.append(grams(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
