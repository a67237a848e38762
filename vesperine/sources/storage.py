"""Tables in the folder that driver and executors share.

A query's intermediate tables stand under one folder per application, which
:func:`forget` deletes once all its results are written."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where a local session leaves it unset (a
    test) a folder is made. Elsewhere executors would not see it: an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="vesperine-")
    return _OWN[app]


_SCOPES: list[str] = []  # of the calls of kept() that are under way, innermost last


def _folder(spark: SparkSession) -> str:
    return "/".join([f"{shared_dir(spark)}/vesperine/{spark.sparkContext.applicationId}", *_SCOPES])


def kept(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Write what ``make()`` returns to the shared folder and read it back;
    every intermediate table that it wrote on the way is deleted."""
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _SCOPES.append(f"scope-{uuid.uuid4().hex}")
    inner = _folder(spark)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _SCOPES.pop()
        delete(spark, inner)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    delete(spark, _folder(spark))


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a path in whatever store holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One new file, through the store's own client."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Rename within a store; false if the target exists or the store says no."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(old), hadoop.Path(new)
    store = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return False if store.exists(target) else store.rename(source, target)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_shared(df: DataFrame) -> None:
    """Delete a table made by :func:`write_shared`."""
    for name in df.inputFiles()[:1]:
        delete(df.sparkSession, name.rpartition("/")[0])
