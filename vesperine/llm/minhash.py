"""Near-duplicate components by min-max hashing.

Each permutation of the shingles gives two signature values, its minimum and
its maximum, so ``bands * rows`` values need half as many hash evaluations.
Bands of equal values propose candidates; proposals are joined into candidate
groups, and links are confirmed on full shingle sets inside each group.

Texts with one shingle set form a class, of which only the smallest id goes on.
A candidate group is confirmed without listing its pairs: a text is compared
with all others of its group at once, through an inverted index, until every
text outside the group's largest component has been compared. A group that is
too large for one task is cut into chunks; first each chunk is solved, then
each chunk's hub is shown to all chunks, then whatever still stands outside the
largest component is shown to all chunks, so that no link is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.llm import textbytes as tb
from vesperine.llm.common import by_row, drop_shared, joined_to_groups, long_id, parts_for, write_shared

GROUP_SHINGLES = 3_000_000  # of one confirming task


def _constants(count: int, seed: int) -> np.ndarray:
    return tb.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed))


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band keys, one row per non-empty set. Half the bands hash the minima of
    ``rows`` permutations, half the maxima of the same ones."""
    perms = bands // 2 * rows
    mult = _constants(perms, seed) | np.uint64(1)
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    keys = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands // 2):
        low = np.full(len(sets), 2 * band, dtype=np.uint64)
        high = low + np.uint64(1)
        for r in range(rows):
            x = flat * mult[band * rows + r]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            low = tb.mix(low + np.minimum.reduceat(x, at))
            high = tb.mix(high + np.maximum.reduceat(x, at))
        keys[:, 2 * band], keys[:, 2 * band + 1] = low, high
    return keys.view(np.int64)


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, set_id binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tb.column(batch.column(1))
            ids = batch.column(0)
            for i, j in tb.slices(off):
                part, o = tb.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                starts, ends, first = tb.words(part, o)
                sets = tb.shingle_sets(tb.word_hashes(part, starts, ends), first, shingle)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, signatures([sets[k] for k in full], bands, rows)):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "bands"],
                )

    return docs.mapInArrow(run, schema)


def _shingled(docs: DataFrame, shingle: int) -> DataFrame:
    """``key, root, doc_id, blob``: the shingle sets of grouped documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tb.column(batch.column(3))
            for i, j in tb.slices(off):
                part, o = tb.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                starts, ends, first = tb.words(part, o)
                sets = tb.shingle_sets(tb.word_hashes(part, starts, ends), first, shingle)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["key", "root", "doc_id", "blob"],
                )

    return docs.mapInArrow(run, "key string, root long, doc_id long, blob binary")


class Index:
    """An inverted index of shingle sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.terms, self.begin = np.unique(flat[order], return_index=True)
        self.end = np.append(self.begin[1:], len(flat))

    def common(self, shingles: np.ndarray) -> np.ndarray:
        """How many of the given distinct shingles each set holds."""
        if not len(self.terms) or not len(shingles):
            return np.zeros(len(self.sizes), np.int64)
        at = np.searchsorted(self.terms, shingles)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == shingles)]
        begin, count = self.begin[at], self.end[at] - self.begin[at]
        if not count.sum():
            return np.zeros(len(self.sizes), np.int64)
        skip = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        return np.bincount(self.owner[skip + np.arange(count.sum())], minlength=len(self.sizes))

    def linked(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """Sets whose intersection is at least ``percent`` of the union."""
        both = self.common(shingles)
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(shingles) - both)))


def components(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """(component of each set, as its least member's position; a central set
    of the largest component). Every set outside the largest component is
    compared with all, so two sets in different components are not linked."""
    n = len(sets)
    comp = np.arange(n)
    if n == 1:
        return comp, 0
    index = Index(sets)
    df = index.end - index.begin
    spread = np.bincount(index.owner, weights=np.repeat(df, df), minlength=n) / np.maximum(index.sizes, 1)
    todo = np.ones(n, dtype=bool)
    hub = pivot = int(np.argmax(spread))
    while True:
        todo[pivot] = False
        near = index.linked(sets[pivot], percent)
        met = np.unique(np.append(comp[near], comp[pivot]))
        if len(met) > 1:
            comp[np.isin(comp, met)] = met[0]
        names, counts = np.unique(comp, return_counts=True)
        largest = names[np.argmax(counts)]
        left = np.flatnonzero(todo & (comp != largest))
        if not len(left):
            break
        pivot = int(left[np.argmax(spread[left])])
    inside = np.flatnonzero(comp == largest)
    hub = int(inside[np.argmax(spread[inside])])
    return comp, hub


def _solved(sets: DataFrame, percent: int) -> DataFrame:
    """``root, doc_id, comp, blob``: components of each root within each key;
    the blob is given for the key's hub of each root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("root", "ascending"), ("doc_id", "ascending")])
        root, doc = table["root"].to_numpy(), table["doc_id"].to_numpy()
        comp = np.empty(len(doc), np.int64)
        blobs: list = [None] * len(doc)
        cuts = np.append(np.flatnonzero(np.append(True, root[1:] != root[:-1])), len(root))
        raw = table["blob"]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw[a:b]]
            own, hub = components(sets, percent)
            comp[a:b] = doc[a + own]
            blobs[a + hub] = raw[a + hub].as_py()
        return pa.table([pa.array(root), pa.array(doc), pa.array(comp), pa.array(blobs, pa.binary())], names=["root", "doc_id", "comp", "blob"])

    return sets.groupBy("key").applyInArrow(run, "root long, doc_id long, comp long, blob binary")


def _met(sets: DataFrame, shown: DataFrame, percent: int) -> DataFrame:
    """Links between the sets of each key and those shown to that key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, found = left["doc_id"].to_numpy(), []
        if left.num_rows and right.num_rows:
            index = Index([np.frombuffer(x.as_buffer(), np.uint64) for x in left["blob"]])
            for one, blob in zip(right["doc_id"].to_pylist(), right["blob"]):
                near = index.linked(np.frombuffer(blob.as_buffer(), np.uint64), percent)
                found.append((np.full(len(near), one, np.int64), doc[near]))
        u = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        v = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
        return pa.table([pa.array(u), pa.array(v)], names=["u", "v"])

    shown = shown.toDF("key", "doc_id", "blob")  # it may stem from ``sets``: new names tell them apart
    return sets.groupBy("key").cogroup(shown.groupBy("key")).applyInArrow(run, "u long, v long").filter("u <> v")


def connected(edges: DataFrame) -> DataFrame:
    """``node, root``: connected components of edges (u, v); the root is a
    component's least node. Each round hooks every node to its least
    neighbour, follows that twice, and contracts the edges."""
    live = write_shared(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    labels = write_shared(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")), "cc-labels")
    while not live.isEmpty():
        up = live.select("u", "v").union(live.select("v", "u")).groupBy("u").agg(F.min("v").alias("p"))
        up = write_shared(up.select("u", F.least("u", "p").alias("p")), "cc-up")
        nxt = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        for _ in range(2):
            up = up.join(nxt, "p").select("u", F.col("q").alias("p"))
        up = write_shared(up, "cc-hook")
        kept = live
        live = (
            live.join(up.withColumnRenamed("p", "a"), "u")
            .join(up.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
            .filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        )
        live = write_shared(live, "cc-edges")
        old = labels
        labels = old.join(up.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = write_shared(labels, "cc-labels")
        for done in (kept, old, up):
            drop_shared(done)
    return labels


def _confirmed(docs: DataFrame, groups: DataFrame, shingle: int, percent: int, group_shingles: int) -> DataFrame:
    """``doc_id, comp`` for the documents of candidate groups
    (``doc_id, root, n_shingles``)."""
    whole = groups.groupBy("root").agg(F.sum("n_shingles").alias("mass"))
    total = whole.agg(F.sum("mass")).first()[0] or 0
    bins = parts_for(total, group_shingles)
    big = F.col("mass") > group_shingles
    chunks = F.ceil(F.col("mass") / F.lit(group_shingles)).cast("long")
    whole = write_shared(whole.withColumn("chunks", F.when(big, chunks)), "near-groups")
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    key = F.when(F.col("chunks").isNotNull(), F.concat_ws(":", F.lit("g"), "root", chunk)).otherwise(
        F.concat_ws(":", F.lit("b"), F.pmod(F.xxhash64("root"), F.lit(bins)))
    )
    keyed = groups.join(whole, "root").select("doc_id", "root", key.alias("key"))
    texts = docs.join(keyed, "doc_id").select("key", "root", "doc_id", "text")
    sets = _shingled(texts, shingle)
    if whole.filter("chunks is not null").isEmpty():
        return write_shared(_solved(sets, percent).select("doc_id", "comp"), "near-solved")
    sets = write_shared(sets, "near-sets")
    first = write_shared(_solved(sets, percent), "near-solved")
    cut = whole.filter("chunks is not null").select("root", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
    keys = write_shared(cut.select("root", F.concat_ws(":", F.lit("g"), "root", "c").alias("key")), "near-keys")
    chunked = sets.filter(F.col("key").startswith("g:"))
    hubs = first.filter("blob is not null").join(keys, "root").select("key", "doc_id", "blob")
    links = _met(chunked, hubs, percent).union(first.filter("doc_id <> comp").select("doc_id", "comp"))
    labels = connected(links)
    by_doc = labels.select(F.col("node").alias("doc_id"), F.col("root").alias("label"))
    named = first.select(F.col("root").alias("g"), "doc_id").join(by_doc, "doc_id", "left")
    named = named.select("g", "doc_id", F.coalesce("label", "doc_id").alias("comp"))
    named = write_shared(named.join(keys.select(F.col("root").alias("g")).distinct(), "g", "left_semi"), "near-named")
    largest = named.groupBy("g", "comp").count().groupBy("g").agg(F.max_by("comp", F.struct("count", "comp")).alias("top"))
    outside = named.join(largest, "g").filter("comp <> top").select("g", "doc_id")
    shown = chunked.join(outside, "doc_id").select(F.col("g").alias("root"), "doc_id", "blob").join(keys, "root").select("key", "doc_id", "blob")
    links = _met(chunked, shown, percent).union(first.filter("doc_id <> comp").select("doc_id", "comp")).union(
        labels.filter("node <> root").select("node", "root")
    )
    final = connected(links)
    return first.select("doc_id").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("comp")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    Words are runs of non-blanks with A-Z in lower case; documents are linked
    when their shingle sets' intersection is at least ``percent`` of the union.
    ``component_id`` is the smallest id that links reach. A null or wordless
    text has no shingles and no links. Ids must be distinct and not null to be
    linked: rows with a null id stand alone (their component is null and they
    are kept), rows that repeat an id and text are one document. With 32 bands
    of 5 rows a pair at 0.85 is missed once in 10^8, one at 0.8 once in 10^5.
    """
    rows_in = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = write_shared(_signed(rows_in, shingle, bands, rows), "near-signed")
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = write_shared(
        linked.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "near-classes"
    )
    reps = linked.join(classes.select("set_id", F.col("rep").alias("doc_id")), ["set_id", "doc_id"], "left_semi").select("doc_id", "n_shingles", "bands")
    keyed = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = write_shared(keyed.groupBy("band").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("w")).filter("v < w").select("band", "v"), "near-bands")
    edges = keyed.join(shared, "band").filter("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    candidates = connected(edges)
    groups = candidates.withColumnRenamed("node", "doc_id").join(reps.select("doc_id", "n_shingles").distinct(), "doc_id")
    comps = _confirmed(rows_in, groups, shingle, percent, group_shingles)
    least = comps.groupBy("comp").agg(F.min("doc_id").alias("least"))
    comps = comps.join(least, "comp").groupBy(F.col("doc_id").alias("rep")).agg(F.min("least").alias("least"))
    named = classes.join(comps, "rep", "left").select("set_id", F.coalesce("least", "rep").alias("component"), "n")
    named = write_shared(named, "near-named-classes")
    out = joined_to_groups(signed.drop("bands"), named, "set_id", "n", "doc_id")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        F.col("doc_id").alias(id_col), "n_shingles", comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with its columns; also where ids repeat, are
    null or are no integers."""
    return by_row(docs, id_col, lambda rows, row: near_duplicates(rows, row, text_col, **options).filter("not kept").select(row))
