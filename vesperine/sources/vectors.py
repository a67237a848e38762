"""Embedding caches: Parquet tables bound to their source, and a binary form.

A cache is a folder with ``vectors`` (``row_id, embedding``) and ``identity``
(one row: fingerprint, dimension, rows, source size and SHA-256). It is written
beside its target and renamed, so a reader sees all of it or none.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperine.functions import vector as vf
from vesperine.sources import storage

IDENTITY = "fingerprint string, dimension int, rows long, source_size long, source_sha256 string"


def write_cache(vectors: DataFrame, path: str, fingerprint: str, dimension: int, source_size: int = 0, source_sha256: str = "") -> None:
    """Vectors must be of the dimension, finite and of unit length."""
    if not fingerprint:
        raise ValueError("a cache needs a fingerprint")
    spark = vectors.sparkSession
    part = f"{path}.part-{uuid.uuid4().hex}"
    vectors.select("row_id", "embedding").write.parquet(f"{part}/vectors")
    rows = spark.read.parquet(f"{part}/vectors")
    check_vectors(rows.select(F.col("embedding").alias("v")), dimension)
    one = spark.createDataFrame([(fingerprint, dimension, rows.count(), source_size, source_sha256)], IDENTITY)
    one.coalesce(1).write.parquet(f"{part}/identity")
    if not storage.rename(spark, part, path):
        storage.delete(spark, part)
        raise FileExistsError(path)


def check_vectors(vectors: DataFrame, dimension: int) -> None:
    """Fails on another dimension, non-finite coordinates or a norm off 1."""
    bad = ~vf.is_valid(F.col("v"), dimension) | ~F.coalesce(vf.is_unit(F.col("v")), F.lit(False))
    if not vectors.filter(bad).isEmpty():
        raise ValueError("a vector is of another dimension, not finite or not of unit length")


def read_cache(
    spark: SparkSession, path: str, fingerprint: str | None = None, rows: int | None = None, dimension: int | None = None, source: tuple[int, str] | None = None
) -> DataFrame:
    """``row_id, embedding``, renormalised, after its identity was checked."""
    one = spark.read.schema(IDENTITY).parquet(f"{path}/identity").first()
    vectors = spark.read.parquet(f"{path}/vectors")
    wanted = {"fingerprint": fingerprint, "rows": rows, "dimension": dimension}
    for name, value in wanted.items():
        if value is not None and one[name] != value:
            raise ValueError(f"the cache's {name} is {one[name]}, not {value}")
    if source is not None and (one["source_size"], one["source_sha256"]) != source:
        raise ValueError("the cache is of another source")
    if vectors.count() != one["rows"]:
        raise ValueError("the cache is not complete")
    check_vectors(vectors.select(F.col("embedding").alias("v")), one["dimension"])
    return vectors.select("row_id", vf.normalize(F.col("embedding")).alias("embedding"))


def bound_cache(spark: SparkSession, path: str, source_path: str, fingerprint: str | None = None) -> DataFrame:
    """:func:`read_cache` of a cache that was made of the file at
    ``source_path``: its size and digest are computed anew."""
    from vesperine.sources.text import source_identity

    found = source_identity(spark, source_path).filter("size > 0").collect()
    if len(found) != 1:
        raise ValueError("a cache is bound to one file")
    return read_cache(spark, path, fingerprint, source=(found[0]["size"], found[0]["sha256"]))


def cache_faults(spark: SparkSession, path: str, declared: dict) -> list[str]:
    """Which declared properties of a shared cache are not what it holds."""
    one = spark.read.schema(IDENTITY).parquet(f"{path}/identity").first().asDict()
    faults = sorted(name for name, value in declared.items() if one.get(name) != value)
    try:
        read_cache(spark, path)
    except ValueError:
        faults.append("vectors")
    return faults


def extend_cache(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that a resumed run still has to embed."""
    return wanted.join(done.select("row_id"), "row_id", "left_anti")


def encode_binary(vectors: np.ndarray, fingerprint: bytes, magic: bytes, source: tuple[int, bytes] | None = None) -> bytes:
    """A header (magic, dimension, rows, fingerprint length, and for a bound
    cache the source's size and digest), the fingerprint, then FP32 rows."""
    n, d = vectors.shape
    head = struct.pack("<8sIQI", magic, d, n, len(fingerprint))
    if source is not None:
        head += struct.pack("<Q32s", *source)
    return head + fingerprint + vectors.astype("<f4").tobytes()


def decode_binary(data: bytes, magic: bytes, bound: bool) -> tuple[np.ndarray, bytes, tuple[int, bytes] | None]:
    """The inverse; a wrong magic, length or empty fingerprint is an error."""
    size = 24 + 40 * bound
    if len(data) < size:
        raise ValueError("a cut header")
    name, d, n, length = struct.unpack_from("<8sIQI", data)
    source = struct.unpack_from("<Q32s", data, 24) if bound else None
    if name != magic or not length or not d or len(data) != size + length + 4 * d * n:
        raise ValueError("not a cache of this form, or of another length")
    rows = np.frombuffer(data, "<f4", d * n, size + length).reshape(n, d)
    if not np.isfinite(rows).all() or (n and np.abs(np.linalg.norm(rows.astype(np.float64), axis=1) - 1).max() > vf.UNIT_TOLERANCE):
        raise ValueError("a row is not finite or not of unit length")
    return rows, data[size : size + length], source


def read_binary(spark: SparkSession, path: str, magic: bytes, bound: bool) -> DataFrame:
    """``row_id, embedding`` of a binary cache file that fits in a task."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                rows, _, _ = decode_binary(content.as_py(), magic, bound)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), lists], names=["row_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_id long, embedding array<float>")


def by_text(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached vector of each text; a text with two vectors is an error."""
    if not cache.groupBy("text").agg(F.count_distinct("embedding").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a text has two vectors")
    return texts.join(cache.dropDuplicates(["text"]).select("text", "embedding"), "text", "left")


def corpus_identity(texts: list[bytes], domain: bytes) -> str:
    """A fold over documents in order (small corpora and tests)."""
    h = hashlib.sha256(domain + struct.pack("<Q", len(texts)))
    for text in texts:
        h.update(struct.pack("<Q", len(text)) + text)
    return h.hexdigest()
