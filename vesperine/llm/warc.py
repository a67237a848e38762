"""Web archives with a dictionary: ``.warc.zst`` streams.

An archive begins with a skippable frame that holds a Zstandard dictionary
built from the archive's own records; every record follows as a frame of its
own, so that one can be read without the others. Archives are rows of a
table in the shared folder (name, bytes), each of bounded size; a row is a
complete file, and :func:`export` writes it as one.

Records with equal payloads of at least ``least`` bytes are stored once: the
one with the smallest id is the response, the others revisit it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperine.llm.common import joined_to_groups, long_id, write_shared

# Formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
BROADCAST_GROUPS = 200_000  # payloads that repeat, about 30 MB; more are joined by a shuffle
DATE = "1970-01-01T00:00:00Z"  # of records whose pages have no date: reruns agree
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def _lines(head: list[str], body: bytes) -> bytes:
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, name: str, first: int | None, first_name: str | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A response's block is an HTTP message with the
    payload as its body; a revisit (``first`` is not null) has an empty block.
    Record ids are made of names, which are the rows' own."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(name)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first is not None:
        return _lines([*head, f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first_name)}", f"X-Refers-To-Page-ID: {first}"], b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _lines([*head, "Content-Type: application/http; msgtype=response"], http + payload)


def warcinfo(records: list[bytes]) -> bytes:
    """The record that an archive begins with; its id is made of what follows."""
    name = hashlib.sha256(b"".join(hashlib.sha256(r).digest() for r in records)).hexdigest()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_urn('info:' + name)}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields"]
    return _lines(head, b"software: vesperine\r\nformat: WARC File Format 1.1\r\n")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    return headers, rest[:n]


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of a bounded, evenly spread sample of the records; where
    there are too few to train on, their beginnings are the dictionary."""
    each = max(1, SAMPLE_BYTES // max(1, len(records)))
    step = max(1, len(records) // 2000)
    sample = [r[: max(each, 2048)] for r in records[::step]]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, sample)) // 8))
    try:
        return zs.train_dictionary(size, sample).as_bytes()
    except zs.ZstdError:
        return b"".join(x[:2048] for x in sample)[:size]


def _shared(raw: bytes) -> zs.ZstdCompressionDict:
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    return zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_FULLDICT if trained else zs.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    raw = dictionary(records)
    packer = zs.ZstdCompressor(level=level, dict_data=_shared(raw), write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *(packer.compress(r) for r in records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    unpacker = zs.ZstdDecompressor(dict_data=_shared(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        one = unpacker.decompressobj()
        parts, part = [], 1 << 16
        while not one.eof:
            if at >= len(data):
                raise ValueError("a cut archive")
            fed = view[at : at + part]
            parts.append(one.decompress(fed))
            at += len(fed) - (len(one.unused_data) if one.eof else 0)
        yield b"".join(parts)


def plan(pages: DataFrame, id_col: str, url_col: str, text_col: str, least: int, date_col: str | None = None) -> DataFrame:
    """``page_id, url, payload, digest, row, refers_to, refers_row, date`` of
    every page."""
    rows = pages.select(
        long_id(pages, id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"),
        (F.date_format(date_col, "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(DATE)).alias("date"),
    ).withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.struct(F.col("page_id").isNull().alias("z"), "page_id", "row"))
    groups = (
        rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    groups = write_shared(groups, "warc-payloads")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        out = rows.join(F.broadcast(groups), "digest", "left")  # no payload moves
    else:
        out = joined_to_groups(rows, groups, "digest", "n", "page_id")
    revisit = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return out.select(
        "page_id", "url", "payload", "digest", "row", F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.row")).alias("refers_row"), F.coalesce("date", F.lit(DATE)).alias("date"),
    )


def write(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 100, archive_bytes: int = ARCHIVE_BYTES,
    date_col: str | None = None,
) -> DataFrame:
    """Archives of all pages, stored in the shared folder: ``name, archive``.

    A null payload is empty, a null url too; a null id loses to every other
    when a response is chosen. Rows that repeat an id and a payload are all
    responses if that id is the smallest; each has a record id of its own.
    Other columns are ignored; an id that is no integer is an error. ``date_col``
    is a timestamp column; without one all records have one fixed date. An
    empty table gives no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = write_archive([warcinfo(held), *held])
            held.clear()
            name = hashlib.sha256(data).hexdigest()[:24] + ".warc.zst"  # a retried task names alike
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["name", "archive"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page, url, payload, digest, row, first, first_row, date in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    held.append(record(page, url, payload, digest, f"{digest}:{row}", first, f"{digest}:{first_row}", date))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    planned = plan(pages, id_col, url_col, text_col, least, date_col)
    return write_shared(planned.mapInArrow(run, "name string, archive binary"), "warc-archives")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, archive`` of the ``.warc.zst`` files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("archive"))


def read(archives: DataFrame) -> DataFrame:
    """Every record of the archives: ``page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, payload`` (null in a revisit).

    A response's length and digest are taken from its payload and must agree
    with its headers. The records that describe archives are passed over."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for raw in read_archive(data.as_py()):
                    h, body = parse(raw)
                    kind = h["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    body = body.partition(b"\r\n\r\n")[2]
                    if kind == "response":
                        if hashlib.sha256(body).hexdigest() != digest or len(body) != int(h["x-payload-length"]):
                            raise ValueError("a payload that is not what its headers say")
                    page, first = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    rows.append((
                        None if page is None else int(page), h["warc-target-uri"], kind, int(h["x-payload-length"]), digest,
                        None if first is None else int(first), None if kind == "revisit" else body,
                    ))
                    size += len(body)
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    return archives.select("archive").mapInArrow(run, schema)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file under ``folder`` (a URI that every executor
    can open); returns ``name, n_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names, sizes = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_buffer()
                part = f"{base}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, f"{base}/{name}")
                names.append(name)
                sizes.append(raw.size)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "n_bytes"])

    return archives.select("name", "archive").mapInArrow(run, "name string, n_bytes long")
