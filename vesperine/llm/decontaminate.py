"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

Every n-gram of a test item is a seed, however common: those that survive an
edit may be the item's commonest. Seed hits on neighbouring diagonals make a
passage; one that holds too few of the item's words to reach the threshold is
left, and a local alignment of the others with the item scores them, so that
paraphrased or edited copies are found too. A copy needs one n-gram unedited.

The benchmark is sent to the executors in shards of a bounded size; a larger
benchmark is searched for shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.llm import textbytes as tb
from vesperine.llm.common import by_row, long_id, parts_for, text_bytes

SHARD_BYTES = 8 << 20  # of test items sent to the executors at once
LEAST_WORDS = 5  # of an item that is looked for
MATCH, MISMATCH, GAP = 2, -1, -1
PAIRS = 2_000_000  # of seed hits and items looked at together
_BITS = 22


def _items(rows: list) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(ids, word hashes, first) of a shard."""
    buf, off = tb.column(pa.array([r["text"] or "" for r in rows], pa.large_string()))
    part = tb.LOWER[buf]
    starts, ends, first = tb.words(part, off, tb.ALNUM)
    return [r["id"] for r in rows], tb.word_hashes(part, starts, ends), first


class Seeds:
    """Distinct seeds with the (item, offset) pairs that hold them."""

    def __init__(self, words: np.ndarray, first: np.ndarray, size: int, least: int = 1):
        keys, item, at = [], [], []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            n = min(size, b - a)  # an item of fewer words is one seed
            if n and b - a >= least:
                g = tb.grams(words[a:b], n)
                keys.append(g)
                item.append(np.full(len(g), i))
                at.append(np.arange(len(g)))
        empty = np.zeros(0, np.int64)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.item = np.concatenate(item) if item else empty
        self.at = np.concatenate(at) if at else empty
        self.lengths = sorted({min(size, int(b - a)) for a, b in zip(first[:-1], first[1:]) if b > a})
        self.set(flat)

    def set(self, flat: np.ndarray) -> None:
        order = np.argsort(flat, kind="stable")
        self.flat, self.item, self.at = flat[order], self.item[order], self.at[order]
        self.keys, self.begin = np.unique(self.flat, return_index=True)
        self.end = np.append(self.begin[1:], len(self.flat))
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.keys & np.uint64((1 << _BITS) - 1)] = True

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word position, text, seed) of every seed in the texts."""
        pos, doc, seed = [], [], []
        owner = None
        for n in self.lengths:
            g = tb.grams(h, n)
            at = np.flatnonzero(self.bits[g & np.uint64((1 << _BITS) - 1)])
            k = np.searchsorted(self.keys, g[at])
            ok = (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == g[at])
            at, k = at[ok], k[ok]
            owner = np.searchsorted(first, at, side="right") - 1
            inside = at + n <= first[owner + 1]
            pos.append(at[inside]), doc.append(owner[inside]), seed.append(k[inside])
        if not pos:
            return (np.zeros(0, np.int64),) * 3
        pos, doc, seed = np.concatenate(pos), np.concatenate(doc), np.concatenate(seed)
        order = np.argsort(doc, kind="stable")
        return pos[order], doc[order], seed[order]

    def pairs(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(word position, text, item, offset in the item) of every hit, in
        parts that hold whole texts."""
        pos, doc, seed = self.hits(h, first)
        n = self.end[seed] - self.begin[seed]
        total = np.concatenate(([0], np.cumsum(n)))
        lo = 0
        while lo < len(doc):
            hi = max(int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1, lo + 1)
            if hi < len(doc):  # not within a text, unless it alone is larger
                back = int(np.searchsorted(doc, doc[hi]))
                hi = back if back > lo else int(np.searchsorted(doc, doc[hi], side="right"))
            m = n[lo:hi]
            which = np.repeat(self.begin[seed[lo:hi]] - (total[lo:hi] - total[lo]), m) + np.arange(total[hi] - total[lo])
            yield np.repeat(pos[lo:hi], m), np.repeat(doc[lo:hi], m), self.item[which], self.at[which]
            lo = hi


def smith_waterman(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local alignment of one item with equally long passages (one per row).

    Returns each passage's best score and the column where it ends. Gaps cost
    the same for each word, so a row's horizontal moves are a running maximum."""
    rows, width = passages.shape
    score = np.zeros((rows, width + 1), dtype=np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    for word in item:
        now = np.zeros_like(score)
        step = np.where(passages == word, MATCH, MISMATCH).astype(np.int32)
        now[:, 1:] = np.maximum(np.maximum(score[:, :-1] + step, score[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        at = now.argmax(axis=1)
        top = now[np.arange(rows), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
        score = now
    return best, end


def _windows(pos: np.ndarray, doc: np.ndarray, item: np.ndarray, at: np.ndarray, length: np.ndarray, threshold: float) -> list[tuple[int, int, int, int]]:
    """Passages (text, item, first word, last word): hits of one item in one
    text whose diagonals are neighbours share one. An alignment that reaches
    the threshold leaves a seed's diagonal by the gaps it can afford at most."""
    diag = pos - at
    order = np.lexsort((diag, item, doc))
    doc, item, diag = doc[order], item[order], diag[order]
    slack = np.maximum(8, np.ceil(MATCH * (1 - threshold) * length[item] / -GAP).astype(np.int64))
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diag[1:] - diag[:-1] > slack[1:])
    cuts = np.append(np.flatnonzero(fresh), len(doc))
    last = cuts[1:] - 1
    a = cuts[:-1]
    return list(zip(doc[a].tolist(), item[a].tolist(), (diag[a] - slack[a]).tolist(), (diag[last] + length[item[a]] + slack[a]).tolist()))


def _spread(texts: DataFrame, seeds: Seeds, ids: list[int], words: np.ndarray, first: np.ndarray, threshold: float) -> DataFrame:
    """One pass over the documents, aligning passages."""
    length = np.diff(first)

    def tokens(batch: pa.RecordBatch):
        buf, off = tb.column(batch.column(1))
        for i, j in tb.slices(off):
            part, o = tb.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
            starts, ends, f = tb.words(part, o, tb.ALNUM)
            yield i, part, o, starts, ends, f, tb.word_hashes(part, starts, ends)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, part, o, starts, ends, f, h in tokens(batch):
                by_item: dict[int, list] = {}
                for pos, doc, item, at in seeds.pairs(h, f):
                    for d, it, a, b in _windows(pos, doc, item, at, length, threshold):
                        by_item.setdefault(it, []).append((d, max(a, int(f[d])), min(b, int(f[d + 1]))))
                for it, spans in by_item.items():
                    out += [(ids[it], i + d, s, *where(part, o, starts, ends, d, a, b)) for d, s, a, b in scored(it, spans, h)]
            best: dict[tuple, tuple] = {}
            for it, row, s, a, b in out:
                if (it, row) not in best or s > best[it, row][0]:
                    best[it, row] = (s, a, b)
            rows = list(best)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r for _, r in rows], pa.int64())),
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([best[r][0] for r in rows], pa.float64()),
                    pa.array([best[r][1] for r in rows], pa.int64()),
                    pa.array([best[r][2] for r in rows], pa.int64()),
                ],
                names=["doc_id", "item_id", "score", "start", "end"],
            )

    def scored(it: int, spans: list, h: np.ndarray):
        item = words[first[it] : first[it + 1]]
        need = threshold * MATCH * len(item)
        spans.sort(key=lambda x: x[2] - x[1])
        for k in range(0, len(spans), 256):
            group = spans[k : k + 256]
            step = max(1, 2_000_000 // max(1, group[-1][2] - group[-1][1]))
            for m in range(0, len(group), step):
                some = group[m : m + step]
                wide = max(b - a for _, a, b in some)
                block = np.zeros((len(some), wide), np.uint64)  # 0 pads: it is no item's word
                for r, (_, a, b) in enumerate(some):
                    block[r, : b - a] = h[a:b]
                # every match needs one of the item's words in the passage
                likely = np.flatnonzero(MATCH * np.isin(block, item).sum(axis=1) >= need)
                best, end = smith_waterman(item, block[likely])
                for hit in np.flatnonzero(best >= need):
                    r = likely[hit]
                    d, a, b = some[r]
                    stop = min(a + int(end[hit]), b)
                    # the same alignment from its end gives where it begins
                    _, back = smith_waterman(item[::-1], np.ascontiguousarray(block[r : r + 1, : stop - a][:, ::-1]))
                    yield d, float(best[hit]) / (MATCH * len(item)), stop - int(back[0]), stop

    def where(part, o, starts, ends, d: int, a: int, b: int) -> tuple[int, int]:
        """Code point offsets of words a to b of text d."""
        begin = o[d]
        lead = (part[begin : ends[b - 1]] & 0xC0) != 0x80
        return int(lead[: starts[a] - begin].sum()), int(lead.sum())

    return texts.mapInArrow(aligned, "doc_id long, item_id long, score double, start long, end long")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 3,
    threshold: float = 0.5,
    shard_bytes: int = SHARD_BYTES,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row per document and test item that it contains:
    ``doc_id, item_id, score, start, end``.

    Words are runs of ASCII letters, digits and other bytes from 0x80, A-Z in
    lower case. ``score`` is the alignment's part of a full match (1.0: every
    word in order); rows below ``threshold`` are left out. ``start`` and ``end``
    are code point offsets of the best passage. Null or wordless texts and
    items match nothing, nor do items of fewer than ``least_words`` words, which
    stand in many texts by chance; a null id is reported as null; rows that repeat are
    reported each. An empty benchmark or table gives no rows; ids that are no
    integers are an error.
    """
    texts = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(long_id(benchmark, item_col).alias("id"), F.col(item_text_col).alias("text"))
    shards = parts_for(text_bytes(items, "text"), shard_bytes)
    out = None
    for k in range(shards):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).filter("text is not null").orderBy("id", "text").collect()
        ids, words, first = _items(rows)
        seeds = Seeds(words, first, size, least_words)
        if not len(seeds.keys):
            continue
        found = _spread(texts, seeds, ids, words, first, threshold)
        out = found if out is None else out.union(found)
    if out is None:
        spark = docs.sparkSession
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start long, end long")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no test item, with their columns; also where
    ids repeat, are null or are no integers."""
    return by_row(docs, id_col, lambda rows, row: contaminated(rows, benchmark, row, **options).select("doc_id"))
