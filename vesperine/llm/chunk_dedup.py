"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over the bytes of a text; a chunk ends where its high
bits are zero, so a cut depends on the 32 bytes before it alone and an
insertion moves no cut further on. Chunks are named by digest. Of equal chunks
in the corpus those of the least document stay; those of later documents are
runs of removed chunks, each extended byte by byte at both ends as far as the
document that its end chunk stems from goes on alike, and removed if then long
enough to be a copied passage rather than a common phrase.

Blocks of documents send their distinct digests to hash buckets, which answer
where an earlier document, in another block, has a digest. Blocks then ask one
another for the bytes beside the chunks that end their runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.llm import blocks as bl
from vesperine.llm import textbytes as tb
from vesperine.llm.common import write_shared

MASK_BITS = 5  # chunks of 32 bytes on average beyond the least size
LEAST, MOST = 16, 256  # bytes of a chunk
PASSAGE = 101  # bytes alike that make a copied passage: over 50 words have no less
REACH = MOST  # bytes by which a run is extended: the chunk beside it is no longer
_DIGEST = 16
_GEAR = tb.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + gear[byte i] modulo 2^32, for all i at once: a hash
    sees 32 bytes, so five doublings of the span give it."""
    h, span = _GEAR[buf], 1
    while span < 32:
        out = h.copy()
        out[span:] += h[:-span] << np.uint32(span)
        h, span = out, 2 * span
    return h


def cuts(buf: np.ndarray) -> np.ndarray:
    """Where the chunks of a text end."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    low = np.flatnonzero((gear(buf) >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, last = [], 0
    for c in low.tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return np.array(out, dtype=np.int64)


class _Block:
    def __init__(self, table: pa.Table):
        table = bl.ordered(table)
        self.ids = table["doc_id"].to_numpy()
        self.buf, self.off = tb.column(table["text"])
        row, start, end, digest = [], [], [], []
        view = memoryview(np.ascontiguousarray(self.buf))
        for k, (a, b) in enumerate(zip(self.off[:-1].tolist(), self.off[1:].tolist())):
            c = cuts(self.buf[a:b]) + a
            s = np.concatenate(([a], c[:-1])) if len(c) else c
            row.append(np.full(len(c), k))
            start.append(s)
            end.append(c)
            digest += [hashlib.blake2b(view[x:y], digest_size=_DIGEST).digest() for x, y in zip(s.tolist(), c.tolist())]
        empty = np.zeros(0, np.int64)
        self.row, self.start, self.end = (np.concatenate(x) if x else empty for x in (row, start, end))
        flat = np.frombuffer(b"".join(digest), dtype=np.dtype((np.void, _DIGEST)))
        pairs = flat.view(np.uint64).reshape(-1, 2)
        order = np.lexsort((np.arange(len(pairs)), pairs[:, 1], pairs[:, 0]))
        fresh = np.ones(len(order), dtype=bool)
        sorted_pairs = pairs[order]
        fresh[1:] = (sorted_pairs[1:] != sorted_pairs[:-1]).any(axis=1)
        self.keys = sorted_pairs[fresh]  # distinct digests, in order
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(fresh) - 1
        self.first = order[fresh]  # the block's first chunk of each digest: rows are in id order


def _ask(docs: DataFrame, via: bl.Exchange) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        b = _Block(table)
        doc, place = b.ids[b.row[b.first]], b.start[b.first]
        out = [(h, np.concatenate([b.keys[p].ravel(), doc[p].view(np.uint64), place[p].view(np.uint64)]).tobytes()) for h, p in bl.buckets(b.keys[:, 0], via.n)]
        return via.dispatched(bl.message([h for h, _ in out], [block] * len(out), [d for _, d in out]), "bucket")

    return docs.groupBy("block").applyInArrow(run, bl.MESSAGE)


def _answer(asked: DataFrame, via: bl.Exchange) -> DataFrame:
    """A bit per digest: an earlier document elsewhere has it; then the block
    and the place of those. Of blocks with one least document (rows that repeat
    an id), the least block is first."""

    def run(table: pa.Table) -> pa.Table:
        table = via.opened(table)
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["data"]]
        size = [len(x) // 4 for x in raw]
        pairs = np.concatenate([x[: 2 * k].reshape(-1, 2) for x, k in zip(raw, size)])
        doc = np.concatenate([x[2 * k : 3 * k].view(np.int64) for x, k in zip(raw, size)])
        place = np.concatenate([x[3 * k :].view(np.int64) for x, k in zip(raw, size)])
        block = np.repeat(table["block"].to_numpy(), size)
        order = np.lexsort((block, doc, pairs[:, 1], pairs[:, 0]))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (pairs[order][1:] == pairs[order][:-1]).all(axis=1)
        later = np.empty(len(order), dtype=bool)
        later[order] = same
        least = np.empty(len(order), np.int64)
        least[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        source = np.stack([block[least], place[least]], axis=1)
        ends = np.cumsum(size)[:-1]
        data = [np.packbits(x).tobytes() + y[x].tobytes() for x, y in zip(np.split(later, ends), np.split(source, ends))]
        return via.dispatched(bl.message(table["bucket"].to_pylist(), table["block"].to_pylist(), data), "block")

    return via.delivered(asked, "bucket").groupBy("bucket").applyInArrow(run, bl.MESSAGE)


_RUN = 7  # row, start, end, then block and place of the first and of the last chunk's source


def _find(docs: DataFrame, answers: DataFrame, via: bl.Exchange, within: bool) -> DataFrame:
    """Each block's chunks per document and runs of repeated chunks, to itself
    (bucket -1); and to each source block, which places it is asked for."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return bl.message([], [], [])
        me = table["block"][0].as_py()
        b = _Block(table)
        elsewhere = np.zeros(len(b.keys), dtype=bool)
        source = np.stack([np.full(len(b.keys), me), b.start[b.first]], axis=1)
        told = via.opened(told)
        answer = dict(zip(told["bucket"].to_pylist(), told["data"]))
        for home, p in bl.buckets(b.keys[:, 0], via.n):
            if home in answer:
                raw = answer[home].as_buffer()
                size = -(-len(p) // 8)
                bit = np.unpackbits(np.frombuffer(raw, np.uint8, size), count=len(p)).astype(bool)
                elsewhere[p] = bit
                source[p[bit]] = np.frombuffer(raw, np.uint8, offset=size).copy().view(np.int64).reshape(-1, 2)
        first = b.first[b.inverse]
        later = elsewhere[b.inverse] | ((first != np.arange(len(first))) if within else b.ids[b.row[first]] != b.ids[b.row])
        joined = later[1:] & later[:-1] & (b.row[1:] == b.row[:-1])
        x = np.flatnonzero(later & ~np.append([False] * min(1, len(later)), joined))
        y = np.flatnonzero(later & ~np.append(joined, [False] * min(1, len(later))))
        runs = np.column_stack([b.row[x], b.start[x], b.end[y], source[b.inverse[x]], source[b.inverse[y]]]).astype(np.int64)
        runs[:, 6] += b.end[y] - b.start[y]  # a right side begins where the chunk ends
        chunks = np.bincount(b.row, minlength=len(b.ids)).astype(np.int64)
        asks, _ = _asks(runs, me)
        to = np.unique(asks[:, 0]).tolist()
        asked = bl.message(to, [me] * len(to), [np.ascontiguousarray(asks[asks[:, 0] == k, 1:]).tobytes() for k in to])
        return pa.concat_tables([bl.message([-1], [me], [chunks.tobytes() + runs.tobytes()]), via.dispatched(asked, "bucket")])

    return docs.groupBy("block").cogroup(via.delivered(answers, "block").groupBy("block")).applyInArrow(run, bl.MESSAGE)


def _asks(runs: np.ndarray, me: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, place, is right) asked of other blocks, each once and in order,
    and for the left and then the right sides of the runs, which of them (-1
    where the block itself is the source)."""
    sides = np.concatenate([np.insert(runs[:, 3:5], 2, 0, axis=1), np.insert(runs[:, 5:7], 2, 1, axis=1)])
    far = sides[:, 0] != me
    asks, inverse = np.unique(sides[far], axis=0, return_inverse=True)
    which = np.full(len(sides), -1)
    which[far] = inverse.ravel()
    return asks, which


def _beside(buf: np.ndarray, off: np.ndarray, at: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the same text on one side of each place, from the place
    outwards, and how many there are."""
    owner = np.searchsorted(off, np.where(right, at - 1, at), side="right") - 1  # a chunk is not empty
    size = np.minimum(np.where(right, off[owner + 1] - at, at - off[owner]), REACH)
    step = np.arange(REACH)
    where = np.where(right[:, None], at[:, None] + step, at[:, None] - 1 - step)
    return np.where(step < size[:, None], buf[where.clip(0, len(buf) - 1)], 0).astype(np.uint8), size


def _reply(docs: DataFrame, asked: DataFrame, via: bl.Exchange) -> DataFrame:
    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not table.num_rows or not asked.num_rows:
            return bl.message([], [], [])
        me = table["block"][0].as_py()
        buf, off = tb.column(bl.ordered(table)["text"])
        asked, data = via.opened(asked), []
        for x in asked["data"]:
            place = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2)
            parts = [_beside(buf, off, place[k : k + 4096, 0], place[k : k + 4096, 1] > 0) for k in range(0, len(place), 4096)]
            data.append(np.concatenate([z for _, z in parts]).astype(np.uint16).tobytes() + b"".join(z.tobytes() for z, _ in parts))
        return via.dispatched(bl.message([me] * len(data), asked["block"].to_pylist(), data), "block")

    return docs.groupBy("block").cogroup(via.delivered(asked, "bucket").groupBy("bucket")).applyInArrow(run, bl.MESSAGE)


def _extended(runs: np.ndarray, me: int, buf: np.ndarray, off: np.ndarray, replies: dict[int, pa.Scalar]) -> np.ndarray:
    """(row, start, end) of the runs, each with the bytes alike at its ends."""
    asks, which = _asks(runs, me)
    bytes_, sizes = [np.zeros((0, REACH), np.uint8)], [np.zeros(0, np.int64)]
    for k, count in zip(*np.unique(asks[:, 0], return_counts=True)):
        raw = replies[int(k)].as_buffer()
        sizes.append(np.frombuffer(raw, np.uint16, count).astype(np.int64))
        bytes_.append(np.frombuffer(raw, np.uint8, offset=2 * count).reshape(count, REACH))
    theirs, their_size = np.concatenate(bytes_), np.concatenate(sizes)
    at = np.concatenate([runs[:, 1], runs[:, 2]])
    place = np.concatenate([runs[:, 4], runs[:, 6]])
    right = np.arange(len(at)) >= len(runs)
    more = np.zeros(len(at), np.int64)
    for k in range(0, len(at), 4096):
        s = slice(k, k + 4096)
        mine, size = _beside(buf, off, at[s], right[s])
        near = which[s] < 0
        other, other_size = np.empty_like(mine), np.empty_like(size)
        other[near], other_size[near] = _beside(buf, off, place[s][near], right[s][near])
        other[~near], other_size[~near] = theirs[which[s][~near]], their_size[which[s][~near]]
        differ = (mine != other) | (np.arange(REACH) >= np.minimum(size, other_size)[:, None])
        more[s] = np.where(differ.any(axis=1), differ.argmax(axis=1), REACH)
    return np.column_stack([runs[:, 0], runs[:, 1] - more[: len(runs)], runs[:, 2] + more[len(runs) :]])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = "doc_id long, n_bytes long, n_chunks long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def _cut(docs: DataFrame, told: DataFrame, via: bl.Exchange, passage: int) -> DataFrame:
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows:
            me = table["block"][0].as_py()
            table = bl.ordered(table)
            ids = table["doc_id"].to_numpy()
            buf, off = tb.column(table["text"])
            told = via.opened(told)
            data = dict(zip(told["bucket"].to_pylist(), told["data"]))
            own = np.frombuffer(data.pop(-1).as_buffer(), np.int64)
            chunks, runs = own[: len(ids)], own[len(ids) :].reshape(-1, _RUN)
            long = _extended(runs, me, buf, off, data)
            long = long[long[:, 2] - long[:, 1] >= passage]
            part = np.searchsorted(long[:, 0], np.arange(len(ids) + 1))
            for k, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                spans: list[tuple[int, int]] = []
                for s, e in (long[part[k] : part[k + 1], 1:] - a).tolist():
                    if spans and s <= spans[-1][1]:
                        s, e = min(s, spans[-1][0]), max(e, spans.pop()[1])
                        while spans and s <= spans[-1][1]:
                            s = min(s, spans.pop()[0])
                    spans.append((s, e))
                spans = [_whole(buf[a:z], s, e) for s, e in spans]
                text, at = [], 0
                for s, e in spans:
                    text.append(buf[a + at : a + s].tobytes())
                    at = e
                text.append(buf[a + at : z].tobytes())
                out.append((int(ids[k]), z - a, int(chunks[k]), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], b"".join(text).decode("utf-8", "replace")))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 4 + [_SPANS, pa.string()]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_chunks", "n_removed", "spans", "kept_text"])

    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, _OUT)


def _whole(buf: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """The span without the part characters at its ends."""
    while start < end and buf[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(buf) and buf[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def chunk_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    passage: int = PASSAGE,
    within: bool = True,
    block_bytes: int = bl.BLOCK_BYTES,
    fan: int = bl.FAN,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_chunks, n_removed, spans,
    kept_text``. ``spans`` are removed byte ranges, on character bounds.

    ``passage`` is the least length of what counts as copied, in bytes: 1 removes
    every chunk whose digest stood before, also a common phrase's. ``within``
    removes a document's own repeats, too; without it, only what an earlier
    document has.

    A copied passage is lost whole where its end chunks stem from the document
    it was copied from (the least one that has them). A passage of one word repeated
    has no cut of its own and may stay. Null texts are empty and keep all; a
    null id is less than all others; rows that repeat an id count as one
    document and remove nothing from each other. An empty table gives no rows.
    """
    rows, via = bl.blocked(docs, id_col, text_col, block_bytes, fan)
    found = write_shared(_find(rows, _answer(_ask(rows, via), via), via, within), "chunk-runs")
    replies = _reply(rows, found.filter("bucket >= 0"), via)
    told = found.filter("bucket < 0").unionByName(via.delivered(replies, "block"))
    out = _cut(rows, told, via, passage)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(bl.NO_ID))).withColumnRenamed("doc_id", id_col)
