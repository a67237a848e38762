"""Blocks of documents that talk to hash buckets and back.

Some questions need a look at the whole corpus for each of many small keys
(chunk digests, window keys, words). A row per key would drown in overhead, so
documents are grouped in blocks of bounded size and each block sends one packed
array per bucket; a bucket sees one key from all blocks and answers each block
with one packed array in the order in which the block had sent its keys. A
block keeps each key once, so a key that every document holds reaches its
bucket once per block.

There are as many buckets as blocks, n of each. Up to ``FAN`` a message is a row
of its own, n^2 in all. Beyond, messages go in two steps, packed by the square
root of n: a sender's messages to neighbouring receivers are one row, which a
step between sorts into one row for each receiver and group of senders, so there
are n^1.5 rows in either step and none is of a few bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.llm import textbytes as tb
from vesperine.llm.common import long_id, parts_for, text_bytes

BLOCK_BYTES = 12 << 20
NO_ID = -(2**63)
FAN = 2048  # receivers up to which each message is a row
MESSAGE = "bucket long, block long, packed boolean, data binary"


def blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> tuple[DataFrame, Exchange]:
    """(``block, doc_id, text``, the exchange between blocks). A text longer than a
    block makes its block that much larger. A null id is the least long; an id that is no integer is an error."""
    rows = docs.select(
        F.coalesce(long_id(docs, id_col), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    n = parts_for(text_bytes(rows, "text"), block_bytes)
    return rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("block"), "doc_id", "text"), Exchange(n, math.isqrt(n - 1) + 1 if n > fan else 0)


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in the one order that every step agrees on."""
    pa.default_memory_pool().release_unused()  # what the worker's last block left
    return table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def message(bucket: list, block: list, data: list) -> pa.Table:
    columns = [pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array([False] * len(data), pa.bool_()), pa.array(data, pa.binary())]
    return pa.table(columns, names=["bucket", "block", "packed", "data"])


_HEAD = np.dtype([("bucket", "<i8"), ("block", "<i8"), ("size", "<i8")])


def _packet(table: pa.Table) -> bytes:
    head = np.zeros(table.num_rows, _HEAD)
    head["bucket"], head["block"] = table["bucket"].to_numpy(), table["block"].to_numpy()
    raw = [x.as_buffer() for x in table["data"]]
    head["size"] = [x.size for x in raw]
    return b"".join([np.int64(len(head)).tobytes(), head.tobytes(), *raw])


def _opened(data: pa.Scalar) -> pa.Table:
    raw = data.as_buffer()
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, _HEAD, n, 8)
    at = 8 + n * _HEAD.itemsize
    ends = np.concatenate(([0], np.cumsum(head["size"])))
    body = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), raw.slice(at)])
    return message(head["bucket"], head["block"], body.cast(pa.binary()))


class Exchange(NamedTuple):
    """How messages reach ``n`` receivers; ``width`` is 0 where each is a row."""

    n: int
    width: int

    def dispatched(self, table: pa.Table, key: str) -> pa.Table:
        """A sender's messages to the receivers that ``key`` names, as rows."""
        if not self.width or not table.num_rows:
            return table
        other = "block" if key == "bucket" else "bucket"
        coarse = table[key].to_numpy() // self.width
        group = int(table[other][0].as_py()) // self.width
        order = np.argsort(coarse, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(coarse[order])) + 1)
        data = [_packet(table.take(pa.array(p))) for p in parts]
        keys, groups = [int(coarse[p[0]]) for p in parts], [group] * len(parts)
        out = message(keys, groups, data) if key == "bucket" else message(groups, keys, data)
        return out.set_column(2, "packed", pa.array([True] * len(parts)))

    def delivered(self, messages: DataFrame, key: str) -> DataFrame:
        """The messages, with the receivers themselves under ``key``."""
        if not self.width:
            return messages

        def run(table: pa.Table) -> pa.Table:
            other = "block" if key == "bucket" else "bucket"
            group = table[other][0].as_py()
            every = self.opened(table).sort_by([(key, "ascending"), (other, "ascending")])
            keys, first = np.unique(every[key].to_numpy(), return_index=True)
            ends = np.append(first[1:], every.num_rows)
            data = [_packet(every.slice(a, b - a)) for a, b in zip(first.tolist(), ends.tolist())]
            out = message(keys, [group] * len(keys), data) if key == "bucket" else message([group] * len(keys), keys, data)
            return out.set_column(2, "packed", pa.array([True] * len(keys)))

        return messages.groupBy("bucket", "block").applyInArrow(run, MESSAGE)

    def opened(self, table: pa.Table) -> pa.Table:
        """A receiver's messages, one a row."""
        if not self.width or not table.num_rows:
            return table
        parts = [_opened(x) if p else message([u], [v], [x.as_py()]) for u, v, p, x in zip(*(table[c].to_pylist() for c in ("bucket", "block", "packed")), table["data"])]
        return pa.concat_tables(parts).combine_chunks()


def packed(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes one after another, compressed, after their size."""
    raw = b"".join(x.tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked(data: pa.Scalar) -> pa.Buffer:
    raw = data.as_buffer()
    return pa.Codec("zstd").decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"))


def buckets(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of 64-bit keys, positions in the keys' order."""
    home = (tb.mix(keys) % np.uint64(n)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(home[part[0]]), part
