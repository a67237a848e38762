"""A document store: texts with checksums, for lookups by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperine.functions.hashing import crc32c


def write(docs: DataFrame, path: str, parts: int = 32) -> None:
    """``doc_id, text, crc32c``, range-partitioned by id so that a lookup
    reads the row groups of its ids alone."""
    rows = docs.select("doc_id", "text", crc32c(F.col("text")).alias("crc32c"))
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; another layout is an error."""
    store = spark.read.parquet(path)
    if dict(store.dtypes) != {"doc_id": "bigint", "text": "string", "crc32c": "bigint"}:
        raise ValueError(f"{path} is no document store")
    return store


def _checked(rows: DataFrame) -> DataFrame:
    broken = crc32c(F.col("text")) != F.col("crc32c")
    return rows.withColumn("text", F.when(broken, F.raise_error(F.lit("a document's checksum is wrong")).cast("string")).otherwise(F.col("text")))


def read(store: DataFrame, doc_id: int) -> DataFrame:
    """One document; the filter reaches the scan, the checksum is checked."""
    return _checked(store.filter(F.col("doc_id") == doc_id))


def read_many(store: DataFrame, ids: DataFrame) -> DataFrame:
    """``ord, doc_id, text`` of the asked ids, as often as they are asked and
    in the order of ``ord``; an id that the store lacks is an error."""
    joined = ids.join(store.withColumn("__has", F.lit(True)), "doc_id", "left")
    missing = F.raise_error(F.concat(F.lit("no document "), F.col("doc_id").cast("string"))).cast("string")
    found = joined.withColumn("text", F.when(F.col("__has"), F.col("text")).otherwise(missing))
    return _checked(found).select("ord", "doc_id", "text").orderBy("ord")
