"""Product quantization: training, encoding and asymmetric distances.

The codebook is trained on a bounded sample (``samples`` rows by hash of the
id), so the work and the driver's memory do not grow with the corpus; every row
is encoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.functions.text import rank_hash
from vesperine.operators.neighbours import matrix


@dataclass(frozen=True)
class Codebook:
    """``centroids[m, k]``: K centroids of each of M parts."""

    centroids: np.ndarray
    bits: int

    @property
    def parts(self) -> int:
        return self.centroids.shape[0]

    @property
    def code_bytes(self) -> int:
        return -(-self.parts * self.bits // 8)

    def validate(self) -> None:
        if not 1 <= self.bits <= 8 or self.centroids.shape[1] > 2**self.bits:
            raise ValueError("more centroids than codes")
        if not np.isfinite(self.centroids).all() or np.abs(self.centroids).max(initial=0) > 1:
            raise ValueError("centroids must be finite and at most 1")

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest centroid of each part; the lowest on ties."""
        m, k, d = self.centroids.shape
        out = np.empty((len(vectors), m), np.uint8)
        for part in range(m):
            out[:, part] = squared(vectors[:, part * d : (part + 1) * d], self.centroids[part]).argmin(axis=1)
        return out

    def table(self, queries: np.ndarray) -> np.ndarray:
        """Queries x M x K: minus the dot product with each centroid."""
        m, _, d = self.centroids.shape
        parts = queries.astype(np.float64).reshape(len(queries), m, d)
        return -np.einsum("qmd,mkd->qmk", parts, self.centroids.astype(np.float64))

    def distances(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Queries x vectors: one plus the summed table entries, as FP32."""
        total = np.ones((len(tables), len(codes)))
        for part in range(self.parts):
            total += tables[:, part, :][:, codes[:, part]]
        return total.astype(np.float32)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    v, c = vectors.astype(np.float64), centroids.astype(np.float64)
    return ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).astype(np.float32)


def sample(vectors: DataFrame, samples: int, seed: str) -> np.ndarray:
    """At most ``samples`` vectors by (hash of seed and id, id)."""
    got = vectors.select(rank_hash(seed, F.col("id")).alias("h"), "id", "v").filter("v is not null")
    rows = got.orderBy("h", "id").limit(samples).select("v").toArrow()
    return matrix(rows["v"].combine_chunks()) if rows.num_rows else np.zeros((0, 0), np.float32)


def spread_seeds(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centroid is drawn with a chance in proportion to its
    squared distance from the nearest so far; where all distances are zero, the
    points are taken in turn."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(points)))]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = gap.sum()
        one = int(np.searchsorted(np.cumsum(gap), rng.random() * total, side="right")) if total > 0 else len(chosen) % len(points)
        chosen.append(min(one, len(points) - 1))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def train(
    vectors: DataFrame, parts: int, bits: int, iterations: int = 10, samples: int = 4096, seed: str = "pq-42:", spread: int | None = None
) -> Codebook:
    """Lloyd's iterations in each part. The first K sampled vectors seed the
    centroids, or with ``spread``, a seed, those that k-means++ draws; an empty
    cluster takes the sample farthest from its centroid."""
    if not 1 <= bits <= 8 or parts < 1 or samples < 1:
        raise ValueError("a codebook needs 1 to 8 bits, parts and samples")
    x = sample(vectors, samples, seed)
    if not len(x) or x.shape[1] % parts:
        raise ValueError("the parts must divide the dimension of a non-empty sample")
    k, d = min(2**bits, len(x)), x.shape[1] // parts
    book = np.empty((parts, k, d), np.float32)
    for part in range(parts):
        own = x[:, part * d : (part + 1) * d].astype(np.float64)
        centre = (own[:k] if spread is None else spread_seeds(own, k, spread + part)).astype(np.float32)
        for _ in range(iterations):
            distance = squared(own, centre)
            near = distance.argmin(axis=1)
            gap = distance[np.arange(len(own)), near]
            size = np.bincount(near, minlength=k)
            total = np.stack([np.bincount(near, weights=own[:, j], minlength=k) for j in range(d)], axis=1)
            centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 0).astype(np.float32)
            for empty in np.flatnonzero(size == 0):
                far = int(gap.argmax())
                centre[empty], gap[far] = own[far], 0
        book[part] = centre
    found = Codebook(book, bits)
    found.validate()
    return found


def encode(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``id, codes`` (``array<short>``), one row per vector; no row moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.concatenate([book.encode(matrix(batch.slice(i, 2048).column(1))) for i in range(0, batch.num_rows, 2048)])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, book.parts), pa.int32()), pa.array(codes.ravel().astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["id", "codes"])

    return vectors.select(F.col("id").cast("long"), "v").filter("v is not null").mapInArrow(run, "id long, codes array<smallint>")


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes as rows of bytes, a little-endian bit string each."""
    on = (codes[:, :, None] >> np.arange(bits)) & 1
    return np.packbits(on.reshape(len(codes), -1).astype(np.uint8), axis=1, bitorder="little")


def unpack(data: np.ndarray, parts: int, bits: int) -> np.ndarray:
    on = np.unpackbits(data, axis=1, bitorder="little")[:, : parts * bits].reshape(len(data), parts, bits)
    return (on.astype(np.int64) << np.arange(bits)).sum(axis=2)


def packed(codes: DataFrame, bits: int) -> DataFrame:
    """``id, code`` (binary) of ``id, codes``: as they are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pack(matrix(batch.column(1)).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "code"])

    return codes.select("id", "codes").mapInArrow(run, "id long, code binary")


def unpacked(codes: DataFrame, parts: int, bits: int) -> DataFrame:
    """``id, codes`` of ``id, code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            rows = unpack(raw, parts, bits) if batch.num_rows else np.zeros((0, parts), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, parts), pa.int32()), pa.array(rows.ravel().astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "codes"])

    return codes.select("id", "code").mapInArrow(run, "id long, codes array<smallint>")
