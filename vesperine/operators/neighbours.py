"""Exact nearest neighbours of a stated query set, in blocks.

A block of queries, of bounded size, is sent to the executors; each scan
partition multiplies it with its vectors and keeps a top k per query, and the
partial lists are ranked once more. A larger query set takes several blocks,
never one large broadcast and never a row per pair.

:func:`exact_top_k` is for many queries of many unit vectors: an FP32 product
with a bound on its error picks the pairs that may matter, and only theirs are
summed in FP64, in the order of coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesperine.sources.storage import write_shared

BLOCK_QUERIES = 4096
WIDE_BLOCK = 16_384  # queries of exact_top_k() in one pass: 16 MB at 256 dimensions


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long float lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row by (distance, id), in order."""
    order = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
    return np.take_along_axis(distance, order, 1), ids[order] if ids.ndim == 1 else np.take_along_axis(ids, order, 1)


def cosine(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (1.0 - queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.float32)


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    distances: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosine,
    exclude_self: bool = False,
    block: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest of ``corpus (id, v)`` to
    each of ``queries (query_id, v)``, by FP32 distance, then id.

    ``distances`` maps blocks of queries and vectors to a matrix. Null vectors
    are no neighbours; a query with a null vector has no result."""
    corpus = corpus.select(F.col("id").cast("long"), "v").filter("v is not null")
    asked = queries.select(F.col("query_id").cast("long"), "v").filter("v is not null")
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows and b:
            continue
        ids, q = rows["query_id"].to_numpy(), matrix(rows["v"].combine_chunks()) if rows.num_rows else np.zeros((0, 0))
        part = corpus.mapInArrow(_partial(ids, q, k, distances, exclude_self), "query_id long, id long, distance float")
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _partial(ids: np.ndarray, q: np.ndarray, k: int, distances: Callable, exclude_self: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.zeros((len(ids), 0), np.float32)
        best_i = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                if not len(ids):
                    continue
                found = part.column(0).to_numpy()
                d = distances(q, matrix(part.column(1)))
                if exclude_self:
                    d = np.where(ids[:, None] == found[None, :], np.float32(np.inf), d)
                every = np.concatenate([best_d, d], axis=1)
                names = np.concatenate([best_i, np.broadcast_to(found, d.shape)], axis=1)
                best_d, best_i = nearest(every, names, k)
        keep = np.isfinite(best_d)
        row = np.nonzero(keep)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row], pa.int64()), pa.array(best_i[keep], pa.int64()), pa.array(best_d[keep], pa.float32())],
            names=["query_id", "id", "distance"],
        )

    return run


def exact_top_k(corpus: DataFrame, queries: DataFrame, k: int, block: int = WIDE_BLOCK) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest of ``corpus (id, v)`` to
    each of ``queries (query_id, v)`` by ``vector.cosine_distance``, then id.

    A distance is the same wherever a vector stands, so equal vectors tie and
    the least ids stay. Null vectors are left out, as by :func:`top_k`."""
    corpus = corpus.select(F.col("id").cast("long"), "v").filter("v is not null")
    asked = queries.select(F.col("query_id").cast("long"), "v").filter("v is not null")
    blocks = max(1, -(-asked.count() // block))
    corpus = write_shared(corpus, "scanned")  # each block reads it, and what made it has no Python worker beside the scan's
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows and b:
            continue
        ids, q = rows["query_id"].to_numpy(), matrix(rows["v"].combine_chunks()) if rows.num_rows else np.zeros((0, 0), np.float32)
        part = corpus.mapInArrow(_bounded(ids, q, k), "query_id long, id long, distance float")
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def in_order(q: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """FP32 cosine distances of pairs, summed as ``vector.cosine_distance`` does."""
    out = np.empty(len(row), np.float32)
    for lo in range(0, len(row), 4096):
        products = q[row[lo : lo + 4096]].astype(np.float64) * v[col[lo : lo + 4096]].astype(np.float64)
        out[lo : lo + 4096] = 1.0 - np.add.accumulate(products, axis=1)[:, -1]
    return out


def least_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Which rows to keep: of equal vectors, those of the k least ids. The
    others are as far from every query, so they are in no top k."""
    raw = np.ascontiguousarray(vectors)
    _, group = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], group[order])
    return np.sort(order[np.arange(len(order)) - first < k])


def _bounded(ids: np.ndarray, q: np.ndarray, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.full((len(ids), k), np.inf, np.float32)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        longest = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        for batch in batches:
            for lo in range(0, batch.num_rows if len(ids) else 0, 2048):
                part = batch.slice(lo, 2048)
                found, v = part.column(0).to_numpy(), matrix(part.column(1))
                keep = least_copies(found, v, k)
                found, v = found[keep], v[keep]
                # an FP32 sum of d products is off by d roundings at most; the rest covers the distance's own
                slack = (v.shape[1] + 64) * 2.0**-24 * (1 + longest * np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max()))
                for at in range(0, len(ids), 1024):
                    _merge(best_d[at : at + 1024], best_i[at : at + 1024], q[at : at + 1024], found, v, k, slack)
        keep = np.isfinite(best_d)
        row = np.nonzero(keep)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row], pa.int64()), pa.array(best_i[keep], pa.int64()), pa.array(best_d[keep], pa.float32())],
            names=["query_id", "id", "distance"],
        )

    return run


def _merge(best_d: np.ndarray, best_i: np.ndarray, q: np.ndarray, found: np.ndarray, v: np.ndarray, k: int, slack: float) -> None:
    """Put vectors that belong there into the best k of each query, in place."""
    near = q @ v.T
    least = 1.0 - best_d[:, -1].astype(np.float64) - slack  # -inf, while a query has fewer than k
    if len(found) > k and not np.isfinite(least).all():
        least = np.maximum(least, np.partition(near, len(found) - k, axis=1)[:, len(found) - k] - 2 * slack)
    row, col = np.nonzero(near >= least[:, None].astype(np.float32))
    if not len(row):
        return
    some = np.unique(row)
    who = np.concatenate([row, np.repeat(some, k)])
    d = np.concatenate([in_order(q, v, row, col), best_d[some].ravel()])
    i = np.concatenate([found[col], best_i[some].ravel()])
    order = np.lexsort((i, d, who))
    first = order[np.searchsorted(who[order], some)[:, None] + np.arange(k)]
    best_d[some], best_i[some] = d[first], i[first]
