"""Hashes that Spark lacks, vectorised over Arrow batches, and their users."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FNV-1a and CRC-32C parameters, the bigram separator.
FNV_OFFSET = np.uint64(14695981039346656037)
FNV_PRIME = np.uint64(1099511628211)
CRC32C_POLYNOMIAL = 0x82F63B78
SEPARATOR = np.uint64(0x1F)
UNIGRAM, BIGRAM = 5, 3  # weights 1.0 and 0.6 as integers of one ratio

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_TOKEN[128:] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def splitmix64(value: int) -> int:
    """The 64-bit generator step (a fixed public algorithm)."""
    wrap = (1 << 64) - 1
    value = (value + 0x9E3779B97F4A7C15) & wrap
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = ((value ^ (value >> shift)) * factor) & wrap
    return value ^ (value >> 31)


def fnv1a(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """FNV-1a of byte ranges: all ranges advance together, longest last."""
    h = np.full(len(starts), FNV_OFFSET) if state is None else state.copy()
    order = np.argsort(starts - ends, kind="stable")  # longest first
    s, n, out = starts[order], (ends - starts)[order], h[order]
    live = len(order)
    for k in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -k, side="left"))  # ranges longer than k
        out[:live] = (out[:live] ^ _LOWER[buf[s[:live] + k]]) * FNV_PRIME
    h[order] = out
    return h


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): runs of ASCII alphanumerics and bytes from
    0x80; text i has the tokens first[i] to first[i + 1]."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    off = off - off[0]
    # a gap after each text keeps its last token from the next text's first
    flag = np.zeros(len(buf) + len(off) + 1, dtype=bool)
    place = np.arange(len(buf)) + np.repeat(np.arange(len(off) - 1), np.diff(off)) + 1
    flag[place] = _TOKEN[buf]
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    spread = np.cumsum(np.bincount(place, minlength=len(flag)))  # bytes at or before
    starts, ends = spread[edge[::2]], spread[edge[1::2]]
    return buf, starts, ends, np.searchsorted(starts, off)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimension: int = 256) -> DataFrame:
    """``id, pos, weight``: the signed feature hash of tokens and bigrams, as
    integers (their ratio is 5 to 3). A text without tokens has the one feature
    ``<empty>``; a text whose weights all cancel has that one too."""
    if dimension < 8:
        raise ValueError("a hash embedding needs at least 8 dimensions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                dense = _weights(part.column(1), dimension)
                row, pos = np.nonzero(dense)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(pos.astype(np.int64)), pa.array(dense[row, pos].astype(np.int64))],
                    names=["doc_id", "pos", "weight"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, pos long, weight long")


def embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimension: int = 256) -> DataFrame:
    """``doc_id, embedding``: the same features as unit FP32 vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                dense = hash_embed(part.column(1), dimension)
                flat = pa.array(dense.ravel(), pa.float32())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, dimension), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["doc_id", "embedding"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, embedding array<float>")


def _weights(texts: pa.Array, dimension: int) -> np.ndarray:
    """Texts x dimensions: the summed integer weights."""
    buf, starts, ends, first = tokens(texts)
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    h = fnv1a(buf, starts, ends)
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, np.int64)
    both = fnv1a(buf, starts[pair + 1], ends[pair + 1], (h[pair] ^ SEPARATOR) * FNV_PRIME)
    dense = np.zeros(n * dimension)
    for hashes, who, weight in ((h, owner, UNIGRAM), (both, owner[pair], BIGRAM)):
        sign = np.where((hashes >> np.uint64(32)) & np.uint64(1), -weight, weight)
        dense += np.bincount(who * dimension + (hashes % np.uint64(dimension)).astype(np.int64), weights=sign, minlength=n * dimension)
    dense = dense.reshape(n, dimension)
    empty = fnv1a(np.frombuffer(b"<empty>", np.uint8), np.array([0]), np.array([7]))[0]
    bare = np.flatnonzero(~dense.any(axis=1))
    dense[bare, int(empty % np.uint64(dimension))] = -UNIGRAM if (empty >> np.uint64(32)) & np.uint64(1) else UNIGRAM
    return dense


def hash_embed(texts: pa.Array, dimension: int) -> np.ndarray:
    """Unit FP32 vectors of texts."""
    dense = _weights(texts, dimension)
    return (dense / np.sqrt((dense**2).sum(axis=1, keepdims=True))).astype(np.float32)


def fingerprint(dimension: int) -> str:
    return f"hash-fnv1a-v1:{dimension}"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


SEGMENT = 1024  # bytes that one step of the loop takes of each string at most


def _crc_raw(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The register, begun at 0, after each range of bytes; all advance together."""
    table = _crc_table()
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    crc = np.zeros(len(size), dtype=np.uint32)
    for k in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -k, side="left"))
        crc[:live] = table[(crc[:live] ^ buf[s[:live] + k]) & 0xFF] ^ (crc[:live] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = crc
    return out


def _zeros(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The registers after ``count`` zero bytes more. A zero byte is a linear
    map of the register's bits; its powers of two are applied in turn."""
    table = _crc_table()
    step = np.array([table[(1 << b) & 0xFF] ^ np.uint32((1 << b) >> 8) for b in range(32)], np.uint32)  # the images of single bits
    left, out = count.copy(), crc.copy()
    while left.any():
        some = np.flatnonzero(left & 1)
        out[some] = _applied(step, out[some])
        step, left = _applied(step, step), left >> 1
    return out


def _applied(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    for b in range(32):
        out ^= np.where((values >> np.uint32(b)) & np.uint32(1), images[b], np.uint32(0))
    return out


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """CRC-32C (Castagnoli) of byte strings. Strings are cut into segments that
    advance together, however long a string is; the register is linear, so each
    segment's is shifted by the bytes after it, and a string's are combined."""
    size = np.array([len(v) for v in values], dtype=np.int64)
    buf, off = np.frombuffer(b"".join(values), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    parts = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    length = np.minimum(SEGMENT, size[owner] - k * SEGMENT)
    shifted = _zeros(_crc_raw(buf, off[owner] + k * SEGMENT, length), size[owner] - k * SEGMENT - length)
    out = _zeros(np.full(len(size), 0xFFFFFFFF, np.uint32), size)  # the register's first value, shifted by all bytes
    np.bitwise_xor.at(out, owner, shifted)
    return (out ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


def crc32c(column: Column) -> Column:
    """CRC-32C of a string or binary column, as a long."""

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        found = [crc32c_of([bytes(v or b"") for v in values.slice(lo, 512).to_pylist()]) for lo in range(0, len(values), 512)]
        return pa.array(np.concatenate(found) if found else [], pa.int64())

    return run(column.cast("binary"))


def canonical_hash(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    import json

    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()
