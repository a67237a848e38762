"""Proximity graphs: neighbour edges, hub-preserving pruning, layers, hops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperine.functions.text import rank_hash
from vesperine.operators import neighbours, quantize
from vesperine.sources.storage import write_shared


#: Up to here each vector is compared with all; beyond it, cells are asked.
EXACT_LIMIT = 100_000


def edges_of(vectors: DataFrame, degree: int, limit: int = EXACT_LIMIT) -> DataFrame:
    """Neighbour edges by the plan that the corpus' size allows."""
    small = vectors.limit(limit + 1).count() <= limit
    return knn_edges(vectors, degree) if small else knn_edges_in_cells(vectors, degree)


def knn_edges(vectors: DataFrame, degree: int) -> DataFrame:
    """``src, dst, distance``: each vector's ``degree`` nearest others."""
    found = neighbours.top_k(vectors, vectors.withColumnRenamed("id", "query_id"), degree, exclude_self=True)
    return found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance")


def knn_edges_in_cells(vectors: DataFrame, degree: int, bits: int = 8, nprobe: int = 128, chunk: int = 4096) -> DataFrame:
    """As :func:`knn_edges`, approximately, for corpora too large to compare
    each with all: ``src, dst, distance``.

    Every vector lies in one cell of a coarse codebook and asks its ``nprobe``
    nearest cells; fewer than half of them lose more than a tenth of the edges. A cell is cut into chunks of about ``chunk`` members, and so
    are the askers of a chunk, so no task holds more than two chunks, however
    large a cell is; each pair of chunks is one matrix product."""
    book = quantize.train(vectors, 1, bits)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                order = np.argsort(quantize.squared(neighbours.matrix(part.column(1)), book.centroids[0]), axis=1, kind="stable")[:, :nprobe]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], names=["id", "v", "cells"])

    placed = vectors.select(F.col("id").cast("long"), F.col("v").cast("array<float>")).filter("v is not null")
    placed = write_shared(placed.mapInArrow(near, "id long, v array<float>, cells array<int>"), "cells")
    members = placed.select("id", "v", F.element_at("cells", 1).alias("cell"))
    askers = placed.select("id", "v", F.explode("cells").alias("cell"))
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("parts"))
    asked = askers.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("slices"))
    plan = F.broadcast(sizes.join(asked, "cell"))  # at most 256 cells
    # ints on both sides: keys of another type would hash elsewhere
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cut = F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int")
    left = members.join(plan, "cell").select("cell", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("cut"), "id", "v")
    right = askers.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), cut.alias("cut"), "id", "v")

    def pairs(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "distance": pa.array([], pa.float32())})
        ids, src = own["id"].to_numpy(), asking["id"].to_numpy()
        vs, qs = (neighbours.matrix(t["v"].combine_chunks()) for t in (own, asking))
        out = []
        for lo in range(0, len(src), 512):
            d = neighbours.cosine(qs[lo : lo + 512], vs)
            d[src[lo : lo + 512, None] == ids[None, :]] = np.inf
            d, dst = neighbours.nearest(d, ids, degree)
            fine = np.isfinite(d)
            out.append((np.broadcast_to(src[lo : lo + 512, None], d.shape)[fine], dst[fine], d[fine]))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("src", "dst", "distance"), zip(*out))})

    keys = ["cell", "part", "cut"]
    found = left.groupBy(*keys).cogroup(right.toDF(*keys, "id", "v").groupBy(*keys)).applyInArrow(pairs, "src long, dst long, distance float")
    w = Window.partitionBy("src").orderBy("distance", "dst")
    return found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= degree).select("src", "dst", "distance")


def hubs(edges: DataFrame, nodes: DataFrame, ratio: float, slice_rows: int = 1 << 16) -> DataFrame:
    """``id, degree, is_hub``: of the nodes by (in and out) degree, then id, the
    first ceil(ratio * N), at least one, are hubs; none if the ratio is 0.

    The rank is found without a global sort: degrees are few, so the degree at
    which the hubs run out is found on their histogram, and only nodes of that
    one degree are ordered, within ranges of ids that are counted first."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    degree = nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    if ratio == 0:
        return degree.withColumn("is_hub", F.lit(False))
    size = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("degree").desc())
    size = size.withColumn("above", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    want = F.greatest(F.lit(1), F.ceil(F.lit(ratio) * F.col("total")).cast("long"))
    size = size.withColumn("left", want - F.col("above")).select("degree", "n", "left")
    ranked = degree.join(F.broadcast(size), "degree")  # one row per distinct degree
    tied = ranked.filter("left > 0 and left < n").withColumn("r", F.floor(F.col("id") / F.lit(slice_rows)))
    sums = tied.groupBy("r", "left").agg(F.count(F.lit(1)).alias("c"))
    sums = sums.withColumn("base", F.sum("c").over(Window.orderBy("r")) - F.col("c")).filter("base < left").select("r", "base")
    place = F.col("base") + F.row_number().over(Window.partitionBy("r").orderBy("id"))
    edge = tied.join(sums, "r").withColumn("k", place).filter("k <= left").select("id", F.lit(True).alias("tie"))
    return ranked.join(edge, "id", "left").select("id", "degree", ((F.col("left") >= F.col("n")) | F.coalesce("tie", F.lit(False))).alias("is_hub"))


def prune(edges: DataFrame, marked: DataFrame, degree: int, low_degree: int) -> DataFrame:
    """The compact graph ``src, ord, dst, distance``.

    Each source keeps its nearest edges (2 * degree for hubs, ``low_degree``
    for others), then edges are reversed, deduplicated, and each node keeps its
    nearest 2 * degree. A self-edge takes a place before it is dropped."""
    by = Window.partitionBy("src").orderBy("distance", "dst")
    cap = F.when(F.col("is_hub"), F.lit(2 * degree)).otherwise(F.lit(low_degree))
    kept = (
        edges.select("src", "dst", "distance").distinct()
        .join(marked.select(F.col("id").alias("src"), "is_hub"), "src")
        .withColumn("k", F.row_number().over(by)).filter((F.col("k") <= cap) & (F.col("src") != F.col("dst")))
        .select("src", "dst", "distance")
    )
    both = kept.union(kept.select("dst", "src", "distance")).distinct()
    return both.withColumn("ord", F.row_number().over(by)).filter(F.col("ord") <= 2 * degree).select("src", "ord", "dst", "distance")


def offsets(graph: DataFrame, nodes: DataFrame, slice_rows: int = 1 << 16) -> DataFrame:
    """``id, begin, end``: each node's place in the concatenated edge list. A
    running total over ranges of ids: ranges are summed first, so no task
    orders all nodes."""
    degree = graph.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    degree = nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    degree = degree.withColumn("r", F.floor(F.col("id") / F.lit(slice_rows)))
    sums = degree.groupBy("r").agg(F.sum("n").alias("s"))
    sums = sums.withColumn("base", F.sum("s").over(Window.orderBy("r")) - F.col("s")).select("r", "base")
    end = F.col("base") + F.sum("n").over(Window.partitionBy("r").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return degree.join(sums, "r").withColumn("end", end).select("id", (F.col("end") - F.col("n")).alias("begin"), "end")


def level(node: Column, fanout: int, seed: str = "level-42:", most: int = 16) -> Column:
    """A node's top layer: geometric, from the hash of its id."""
    u = F.conv(F.substring(rank_hash(seed, node), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    raw = -F.log(F.greatest(u, F.lit(2.0**-48))) / F.log(F.lit(float(fanout)))
    return F.least(F.floor(raw), F.lit(most)).cast("int")


def layers(vectors: DataFrame, degree: int, fanout: int = 16) -> DataFrame:
    """Upper layers ``level, src, ord, dst``: neighbour edges among the nodes of
    each level above 0; a level has one node in ``fanout`` of that below."""
    levelled = vectors.withColumn("top", level(F.col("id"), fanout))
    out, at = None, 1
    while True:
        members = levelled.filter(F.col("top") >= at).select("id", "v")
        if members.limit(1).count() == 0:
            break
        edges = edges_of(members, degree).select(
            F.lit(at).alias("level"), "src", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst")).alias("ord"), "dst", "distance"
        )
        out = edges if out is None else out.union(edges)
        at += 1
    return out if out is not None else vectors.sparkSession.createDataFrame([], "level int, src long, ord int, dst long, distance float")


def entry_point(nodes: DataFrame, fanout: int = 16, seed: str = "level-42:") -> DataFrame:
    """One row: the node of the top level with the least hash, and its level."""
    ranked = nodes.select("id", level(F.col("id"), fanout, seed).alias("level"), rank_hash(seed, F.col("id")).alias("h"))
    return ranked.agg(F.min_by(F.struct("id", "level"), F.struct(-F.col("level"), F.col("h"), F.col("id"))).alias("e")).select("e.id", "e.level")


SEEDS = 64


def seeds(nodes: DataFrame, seed: str = "seeds-42:") -> DataFrame:
    """``id``: a fixed number of nodes of least hash. A neighbour graph may fall
    into parts; walks also start from the nearest of these."""
    return nodes.select("id", rank_hash(seed, F.col("id")).alias("h")).orderBy("h", "id").limit(SEEDS).select("id")


def hops(graph: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """``query_id, id, hop``: nodes within ``depth`` edges of each source.
    Levels are joined one after another, and a node met before is dropped, so
    paths do not multiply."""
    seen = sources.select("query_id", "id", F.lit(0).alias("hop"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(graph.select(F.col("src").alias("id"), "dst"), "id").select("query_id", F.col("dst").alias("id")).distinct()
        front = step.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("hop", F.lit(k))
        seen = seen.union(front)
    return seen
