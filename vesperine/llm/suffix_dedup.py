"""Substring deduplication by longest-previous-factor arrays.

A byte is removed where a string of ``length`` bytes that covers it also starts
in a document with a smaller id. Three steps find such strings exactly:

1. Every window of ``length`` bytes is named by the least hash of the short
   substrings in it, so equal windows have equal names, and neighbouring windows
   mostly share one: a text becomes runs of windows, two for every 13 bytes.
   Blocks of documents send the names to hash buckets, which answer which names
   stand in more than one document, and which are hot: have more different runs
   than one bucket is to hold, as at the edges of a very common passage.
2. Runs of such names travel, with their text, to the name's bucket. Equal runs
   are combined inside the block, then in the bucket, to the least document. A
   hot name's windows are named anew, each by all its bytes, and so are spread
   over all buckets.
3. In the bucket, the different runs of one name are put in suffix order. The
   previous and next suffixes of a smaller document, and the least common
   prefixes on the way to them, give each suffix its longest previous factor:
   a window is removed if that is at least ``length``.

Each block then gets back the windows of its documents that are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.llm import blocks as bl
from vesperine.llm import textbytes as tb

ANCHOR = 25  # bytes of the substrings that name a window
BLOCK_BYTES = 8 << 20  # a block's runs and segments take about 20 times its bytes
RUN = 64  # windows of a run; a longer one (of a periodic text) is cut
HOT = 4096  # different runs of one name that a bucket puts in one suffix order
BATCH = 100_000  # windows put in suffix order at once (a name of more stands alone)
_TOP = np.uint64(2**64 - 1)


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = op(out[: len(values) - width + 1], out[width - span : width - span + len(values) - width + 1])
    return out


def window_names(buf: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The name of each window of ``length`` bytes."""
    if len(buf) < length:
        return np.zeros(0, np.uint64)
    # hashes of all substrings of ``anchor`` bytes, by binary splitting
    one = tb.mix(np.arange(256, dtype=np.uint64) + np.uint64(77))[buf]
    acc, done, power, span, bit = None, 0, one, 1, anchor
    while bit:
        if bit & 1:
            if acc is None:
                acc = power.copy()
            else:
                m = min(len(acc), len(power) - done)
                acc = acc[:m] * np.uint64(0x9FB21C651E98DF25) + (power[done : done + m] ^ (power[done : done + m] >> np.uint64(28)))
            done += span
        bit >>= 1
        if bit:
            power = power[:-span] * np.uint64(0xD1342543DE82EF95) + (power[span:] ^ (power[span:] >> np.uint64(31)))
            span *= 2
    acc = tb.mix(acc[: len(buf) - anchor + 1])
    return _sliding(acc, length - anchor + 1, np.minimum)


def runs(buf: np.ndarray, off: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, text, first window, windows) of each run of windows of one name."""
    name = window_names(buf, length, anchor)
    if not len(name):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    fresh = np.ones(len(name), dtype=bool)
    fresh[1:] = name[1:] != name[:-1]
    fresh[off[off < len(name)]] = True
    # windows that reach into the next text belong to no run
    bad = np.zeros(len(name) + 1, np.int32)
    ends = off[1:]
    np.add.at(bad, np.clip(ends - length + 1, np.append(0, ends[:-1]), None).clip(max=len(name)), 1)
    np.add.at(bad, ends.clip(max=len(name)), -1)
    good = np.cumsum(bad[:-1]) == 0
    fresh[1:] |= good[1:] != good[:-1]
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(name)))
    ok = good[first]
    first, count = first[ok], count[ok]
    parts = -(-count // RUN)
    if len(parts) and parts.max() > 1:
        which, k = _expanded(parts)
        first, count = first[which] + k * RUN, np.minimum(count[which] - k * RUN, RUN)
    return name[first], np.searchsorted(off, first, side="right") - 1, first, count


def _expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k) of every k below n[i], in order."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def smaller_neighbours(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order.

    ``doc`` is each suffix's document, ``lcp[i]`` the common prefix of suffixes
    i - 1 and i. The previous (next) smaller position is where, going back
    (on), the document first is smaller; the common prefix with it is the least
    on the way. Blocks of 2^k suffixes that hold no smaller document are
    skipped, largest first."""
    n = len(doc)
    best = np.zeros(n, lcp.dtype)
    for side in (0, 1):
        d = doc if side == 0 else doc[::-1]
        common = lcp if side == 0 else np.append(0, lcp[1:][::-1]).astype(lcp.dtype)
        low, step = [d], [common]
        while 2 << (len(low) - 1) <= n:
            s = 1 << (len(low) - 1)
            low.append(np.minimum(low[-1][:-s], low[-1][s:]))
            step.append(np.minimum(step[-1][:-s], step[-1][s:]))
        at = np.arange(n)  # all of [at, i) is known to be no smaller
        way = np.full(n, np.iinfo(lcp.dtype).max, lcp.dtype)
        for k in range(len(low) - 1, -1, -1):
            s = 1 << k
            can = np.flatnonzero(at >= s)
            can = can[low[k][at[can] - s] >= d[can]]
            # the common prefixes crossed are those of at - s + 1 to at
            way[can] = np.minimum(way[can], step[k][at[can] - s + 1])
            at[can] -= s
        has = np.flatnonzero(at > 0)
        found = np.zeros(n, lcp.dtype)
        found[has] = np.minimum(way[has], common[at[has]])
        best = np.maximum(best, found if side == 0 else found[::-1])
    return best


def longest_previous(buf: np.ndarray, start: np.ndarray, need: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each text, which begins at ``start[i]`` of the buffer, the longest
    previous factor, up to ``length``, of its first ``need[i]`` suffixes: the
    longest prefix that also starts one of the given suffixes of a smaller
    document."""
    owner, k = _expanded(need)
    n = len(owner)
    windows = np.lib.stride_tricks.sliding_window_view(buf, length)[start[owner] + k]
    order = np.argsort(windows.view(f"S{length}").ravel(), kind="stable")  # all of one length, so padding changes no order
    windows = windows[order]
    differ = windows[1:] != windows[:-1]
    lcp = np.zeros(n, np.int32)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    rank = np.unique(docs, return_inverse=True)[1].astype(np.int32)
    found = np.empty(n, np.int32)
    found[order] = smaller_neighbours(rank[owner[order]], lcp)
    return found


def merged(name: np.ndarray, buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each named piece of the buffer (in order of place) the first piece of
    the same name and bytes. Pieces are told apart by hashes and then compared;
    one whose bytes differ from its hash's first piece stands for itself."""
    ident = tb.mix(tb.word_hashes(buf, first, first + size) ^ name)
    _, at, inverse = np.unique(ident, return_index=True, return_inverse=True)
    least = at[inverse]
    later = np.flatnonzero(least != np.arange(len(least)))
    for i in range(0, len(later), 1 << 14):
        mine = later[i : i + (1 << 14)]
        rep = least[mine]
        bad = size[mine] != size[rep]
        which, k = _expanded(np.where(bad, 0, size[mine]))
        bad |= np.bincount(which[buf[first[mine][which] + k] != buf[first[rep][which] + k]], minlength=len(mine)) > 0
        least[mine[bad]] = mine[bad]
    return least


class _Block:
    """A block's documents in id order, and their runs."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        table = bl.ordered(table)
        self.ids = table["doc_id"].to_numpy()
        self.buf, self.off = tb.column(table["text"])
        parts = [[], [], [], []]
        for i, j in tb.slices(self.off, 1 << 19):
            a = self.off[i]
            found = runs(self.buf[a : self.off[j]], self.off[i : j + 1] - a, length, anchor)
            for part, x, plus in zip(parts, found, (0, i, a, 0)):
                part.append(x + x.dtype.type(plus))
        self.name, self.doc, self.first, self.count = (np.concatenate(p) for p in parts)
        # names in order, with the first and last document of each
        self.keys, self.inverse = np.unique(self.name, return_inverse=True)
        self.low = np.full(len(self.keys), len(self.ids))
        self.high = np.full(len(self.keys), -1)
        np.minimum.at(self.low, self.inverse, self.doc)
        np.maximum.at(self.high, self.inverse, self.doc)

    def weights(self, length: int) -> np.ndarray:
        """How many different runs each name has."""
        ident = tb.word_hashes(self.buf, self.first, self.first + self.count + length - 1) ^ self.name
        one = np.unique(ident, return_index=True)[1]
        return np.bincount(self.inverse[one], minlength=len(self.keys))


def _ask(docs: DataFrame, via: bl.Exchange, length: int, anchor: int) -> DataFrame:
    """Each block's names, 32 bits each within a bucket (a chance agreement
    only costs a look at text), and how many different runs each has."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        b = _Block(table, length, anchor)
        weight = b.weights(length).clip(max=65535).astype(np.uint16)
        out = [(home, _short(b.keys[p]).tobytes() + weight[p].tobytes()) for home, p in bl.buckets(b.keys, via.n)]
        return via.dispatched(bl.message([home for home, _ in out], [block] * len(out), [data for _, data in out]), "bucket")

    return docs.groupBy("block").applyInArrow(run, bl.MESSAGE)


def _short(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(13)).astype(np.uint32)


def _answer(asked: DataFrame, via: bl.Exchange, hot: int) -> DataFrame:
    """Which of each block's names another block also has, and which of those
    are hot: two bits each."""

    def run(table: pa.Table) -> pa.Table:
        table = via.opened(table)
        raw = [x.as_buffer() for x in table["data"]]
        size = [x.size // 6 for x in raw]
        keys = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(raw, size)])
        weight = np.concatenate([np.frombuffer(x, np.uint16, offset=4 * k) for x, k in zip(raw, size)])
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = (count > 1)[inverse]
        heavy = (np.bincount(inverse, weights=weight) > hot)[inverse]
        ends = np.cumsum(size)[:-1]
        bits = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(shared, ends), np.split(heavy, ends))]
        return via.dispatched(bl.message(table["bucket"].to_numpy(), table["block"].to_numpy(), bits), "block")

    return via.delivered(asked, "bucket").groupBy("bucket").applyInArrow(run, bl.MESSAGE)


# A message: counts of texts and rows, the texts' names, documents and windows,
# the rows, the texts' bytes, all compressed. All of a text's rows are of its
# document.
_TEXT = np.dtype([("name", "<u8"), ("doc", "<i8"), ("count", "u1")])
_ROW = np.dtype([("text", "<u4"), ("row", "<u4"), ("first", "<u4")])


def _send(docs: DataFrame, answers: DataFrame, via: bl.Exchange, length: int, anchor: int) -> DataFrame:
    """Runs of shared names, to their buckets; what the block itself can
    decide goes straight on, in a bucket of its own (-1 - block)."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return bl.message([], [], [])
        block = table["block"][0].as_py()
        b = _Block(table, length, anchor)
        shared, hot = b.high > b.low, np.zeros(len(b.keys), dtype=bool)
        told = via.opened(told)
        bits = dict(zip(told["bucket"].to_pylist(), told["data"]))
        for home, p in bl.buckets(b.keys, via.n):
            if home in bits:
                two = np.frombuffer(bits[home].as_buffer(), np.uint8).reshape(2, -1)
                shared[p] |= np.unpackbits(two[0], count=len(p)).astype(bool)
                hot[p] = np.unpackbits(two[1], count=len(p))
        some, heavy = shared[b.inverse], hot[b.inverse]
        name, doc, first, count = (x[some & ~heavy] for x in (b.name, b.doc, b.first, b.count))
        pieces = [(name, doc, first, count)]
        if (some & heavy).any():  # each window by itself
            doc, first, count = (x[some & heavy] for x in (b.doc, b.first, b.count))
            which, k = _expanded(count)
            doc, first = doc[which], first[which] + k
            pieces.append((tb.mix(tb.word_hashes(b.buf, first, first + length)), doc, first, np.ones(len(first), count.dtype)))
        out_b, out_d, local = [], [], [np.zeros((3, 0), np.int64)]
        for name, doc, first, count in pieces:
            if not len(name):
                continue
            # of equal runs only the least document's go on
            rep = merged(name, b.buf, first, count + length - 1)
            gone = b.ids[doc[rep]] < b.ids[doc]
            local.append(np.stack([doc[gone], first[gone] - b.off[doc[gone]], count[gone]]))
            stay = np.flatnonzero(~gone)
            for home, p in bl.buckets(name[stay], via.n):
                rows = stay[p]
                text, index = np.unique(rep[rows], return_inverse=True)
                head, row = np.zeros(len(text), _TEXT), np.zeros(len(rows), _ROW)
                head["name"], head["doc"], head["count"] = name[text], b.ids[doc[text]], count[text]
                row["text"], row["row"], row["first"] = index, doc[rows], first[rows] - b.off[doc[rows]]
                which, k = _expanded(count[text] + length - 1)
                out_b.append(home)
                out_d.append(bl.packed(np.array([len(text), len(rows)]), head, row, b.buf[first[text][which] + k]))
        removed = np.concatenate(local, axis=1)
        if removed.size:
            out_b.append(-1 - block)
            out_d.append(_spans(*removed))
        return via.dispatched(bl.message(out_b, [block] * len(out_b), out_d), "bucket")

    return docs.groupBy("block").cogroup(via.delivered(answers, "block").groupBy("block")).applyInArrow(run, bl.MESSAGE)


def _spans(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """Windows in order, those that follow one another as one."""
    row, first, count = (np.asarray(x, np.int64) for x in (row, first, count))
    order = np.lexsort((first, row))
    row, first, stop = row[order], first[order], (first + count)[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (first[1:] != stop[:-1])
    last = np.append(np.flatnonzero(fresh)[1:], len(row)) - 1
    return np.stack([row[fresh], first[fresh], stop[last] - first[fresh]], axis=1).tobytes()


def _received(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, the block of each, rows, bytes, where each text's begin)."""
    texts, origin, rows, bodies, seen = [], [], [], [], 0
    for block, data in zip(table["block"].to_pylist(), table["data"]):
        raw = bl.unpacked(data)
        n, m = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        at = 16 + n * _TEXT.itemsize
        texts.append(np.frombuffer(raw, _TEXT, n, 16))
        row = np.frombuffer(raw, _ROW, m, at).copy()
        row["text"] += seen
        rows.append(row)
        bodies.append(np.frombuffer(raw, np.uint8, offset=at + m * _ROW.itemsize))
        origin.append(np.full(n, block))
        seen += n
    text, body = np.concatenate(texts), np.concatenate(bodies)
    start = np.concatenate(([0], np.cumsum(text["count"].astype(np.int64) + length - 1)[:-1]))
    return text, np.concatenate(origin), np.concatenate(rows), body, start


def _hits(text: np.ndarray, rep: np.ndarray, body: np.ndarray, start: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first, windows) that the suffix orders of the names remove; given
    are the least documents' texts, one for each kind of equal ones."""
    rep = rep[np.argsort(text["name"][rep], kind="stable")]
    _, at, kinds = np.unique(text["name"][rep], return_index=True, return_counts=True)
    at, kinds = at[kinds > 1], kinds[kinds > 1]  # a name of one text has no other to be found in
    count, out = text["count"].astype(np.int64), []
    rep = rep[np.repeat(at, kinds) + _expanded(kinds)[1]]
    edge = np.concatenate(([0], np.cumsum(kinds)))
    held = np.concatenate(([0], np.cumsum(count[rep])))[edge]
    i = 0
    while i < len(kinds):
        # several names in one suffix order: a window has one name, so suffixes
        # of different names have no common window
        j = max(int(np.searchsorted(held, held[i] + BATCH, side="right")) - 1, i + 1)
        some = rep[edge[i] : edge[j]]
        need = count[some]
        hit = longest_previous(body, start[some], need, text["doc"][some], length) >= length
        owner, k = _expanded(need)
        begin = np.flatnonzero(hit & ((k == 0) | ~np.append(False, hit[:-1])))
        end = np.flatnonzero(hit & ((k == need[owner] - 1) | ~np.append(hit[1:], False)))
        out.append((some[owner[begin]], k[begin], end - begin + 1))
        i = j
    return out


def _decide(sent: DataFrame, via: bl.Exchange, length: int) -> DataFrame:
    """The removed windows of each block: (row in the block, first, count)."""

    def run(table: pa.Table) -> pa.Table:
        table = via.opened(table)
        bucket = table["bucket"][0].as_py()
        if bucket < 0:
            return via.dispatched(table, "block")
        text, origin, row, body, start = _received(table, length)
        del table
        count = text["count"].astype(np.int64)
        rep = merged(text["name"], body, start, count + length - 1)
        least = np.full(len(text), np.iinfo(np.int64).max)
        np.minimum.at(least, rep, text["doc"])
        whole = text["doc"] > least[rep]
        # of the texts that stay, one of each kind: those of one document are one
        # text unless their bytes were never compared
        found = [(np.flatnonzero(whole), np.zeros(whole.sum(), np.int64), count[whole])]
        found += _hits(text, np.flatnonzero(~whole), body, start, length)
        which, first, n = (np.concatenate(x) for x in zip(*found))
        # what is removed of a text goes at each of its rows
        order = np.argsort(row["text"], kind="stable")
        edge = np.searchsorted(row["text"][order], np.arange(len(text) + 1))
        each, k = _expanded((edge[1:] - edge[:-1])[which])
        at = order[edge[which[each]] + k]
        if not len(at):
            return bl.message([], [], [])
        home, first, n = origin[which[each]], row["first"][at] + first[each], n[each]
        by_block = np.argsort(home, kind="stable")
        parts = np.split(by_block, np.flatnonzero(np.diff(home[by_block])) + 1)
        data = [_spans(row["row"][at[p]], first[p], n[p]) for p in parts]
        return via.dispatched(bl.message([bucket] * len(parts), [int(home[p[0]]) for p in parts], data), "block")

    return via.delivered(sent, "bucket").groupBy("bucket").applyInArrow(run, bl.MESSAGE)


def _cut(docs: DataFrame, removed: DataFrame, via: bl.Exchange, length: int) -> DataFrame:
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_text binary, kept_sha256 string"

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _empty()
        table = bl.ordered(table)
        ids = table["doc_id"].to_numpy()
        buf, off = tb.column(table["text"])
        spans = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in via.opened(told)["data"]]
        edge = np.zeros(len(buf) + 1, np.int32)
        if spans:
            rows = np.concatenate(spans)
            begin = off[rows[:, 0]] + rows[:, 1]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + rows[:, 2] + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_bytes, out_spans, kept, digest = np.diff(off), [], [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            g = gone[a:b]
            if g.any():
                cuts = np.flatnonzero(np.diff(np.concatenate(([0], g, [0])).astype(np.int8)))
                out_spans.append([{"start": int(x), "end": int(y)} for x, y in zip(cuts[::2], cuts[1::2])])
                text = buf[a:b][~g].tobytes()
            else:
                out_spans.append([])
                text = buf[a:b].tobytes()
            kept.append(text)
            digest.append(hashlib.sha256(text).hexdigest())
        return pa.table(
            [pa.array(ids), pa.array(n_bytes), pa.array(out_spans, _SPANS), pa.array(kept, pa.binary()), pa.array(digest)],
            names=["doc_id", "n_bytes", "spans", "kept_text", "kept_sha256"],
        )

    return docs.groupBy("block").cogroup(via.delivered(removed, "block").groupBy("block")).applyInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _empty() -> pa.Table:
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept_text", pa.binary()), ("kept_sha256", pa.string())]
    return pa.table([pa.array([], k) for _, k in kinds], names=[n for n, _ in kinds])


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = BLOCK_BYTES, hot: int = HOT,
    fan: int = bl.FAN,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans, kept_text, kept_sha256``.

    Texts are bytes of UTF-8; a null is empty. ``spans`` are the maximal
    removed byte ranges of the input, ``kept_text`` the remaining bytes (which
    need not be UTF-8). A string that repeats only inside its own document
    stays. Rows that repeat an id count as one document, so they remove nothing
    from each other; a null id is less than all others. Texts shorter than
    ``length`` keep all. An empty table gives no rows.
    """
    rows, via = bl.blocked(docs, id_col, text_col, block_bytes, fan)
    anchor = max(1, min(ANCHOR, length // 2))
    answers = _answer(_ask(rows, via, length, anchor), via, hot)
    removed = _decide(_send(rows, answers, via, length, anchor), via, length)
    out = _cut(rows, removed, via, length)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(bl.NO_ID))).withColumnRenamed("doc_id", id_col)
