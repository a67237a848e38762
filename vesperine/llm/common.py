"""Small helpers of the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperine.sources.storage import drop_shared, kept, shared_dir, write_shared

__all__ = [
    "BROADCAST_IDS", "by_row", "crc_mod", "drop_shared", "joined_to_groups", "kept", "long_id", "parts_for", "shared_dir", "text_bytes", "without",
    "write_shared",
]

_INTEGERS = ("byte", "short", "integer", "long")


def long_id(rows: DataFrame, id_col: str) -> Column:
    """The id as a long. Ids of another type are an error: number such rows
    first, or use an operator's ``drop_*`` or ``decontaminate``, which do."""
    kind = rows.schema[id_col].dataType.typeName()
    if kind not in _INTEGERS:
        raise TypeError(f"{id_col} must be an integer column, not {kind}")
    return F.col(id_col).cast("long")


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts (one narrow aggregate)."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(n_bytes: int, each: int) -> int:
    """How many parts of about ``each`` bytes hold ``n_bytes``."""
    return max(1, math.ceil(n_bytes / each))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of a value's decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


#: Ids of at most this many rows (32 MB of longs) are sent to every executor.
BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, id_col: str, dropped: Callable[[], DataFrame], most: int = BROADCAST_IDS) -> DataFrame:
    """The rows whose id is not among those that ``dropped()`` gives (one
    column). A null id is never among them. The ids are counted first: few are
    broadcast, so that no text moves; more are joined by a shuffle."""
    ids = kept(docs.sparkSession, lambda: dropped().toDF("__drop").filter("__drop is not null").distinct(), "dropped-ids")
    few = ids.count() <= most
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == ids["__drop"], "left_anti")


def by_row(docs: DataFrame, id_col: str, dropped: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that ``dropped(rows, id column)``, a column of ids, leaves.

    Ids that are integers, distinct and not null name the rows. Otherwise rows
    are numbered in the order of their ids (nulls last), so that each row is
    judged by itself, and stored once, so that its number holds."""
    kind = docs.schema[id_col].dataType.typeName()
    repeats = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if kind in _INTEGERS and repeats.isEmpty():
        return without(docs, id_col, lambda: dropped(docs, id_col))
    row = "__row"
    while row in docs.columns:
        row += "_"
    # rows of one id are spread over ranges, too
    order = [F.col(id_col).asc_nulls_last(), F.rand(7)]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.repartitionByRange(parts, *order).sortWithinPartitions(F.col(id_col).asc_nulls_last())
    rows = write_shared(rows.withColumn(row, F.monotonically_increasing_id()), "numbered")
    return without(rows, row, lambda: dropped(rows, row)).drop(row)


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, least_hot: int = 10_000) -> DataFrame:
    """``rows`` left-joined to their group (one row per ``key``, with its number
    of rows ``size``), whatever share of the rows a group has.

    Groups with more than 1 / 100,000 of all rows are at most 100,000 (about
    10 MB), so they are broadcast; their rows, and those without a key, take
    part in the shuffle join under keys of their own, spread by ``spread``."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    most = max(least_hot, total // 100_000)
    hot = groups.filter(F.col(size) > most)
    names = [c for c in groups.columns if c != key]
    if hot.isEmpty():
        cold, extra = groups, None
        joined = rows
        away = F.col(key).isNull()
    else:
        cold, extra = groups.filter(F.col(size) <= most), "__hot"
        hot = hot.select(F.col(key).alias("__key"), F.struct(*names).alias(extra))
        joined = rows.join(F.broadcast(hot), rows[key] == F.col("__key"), "left").drop("__key")
        away = F.col(key).isNull() | F.col(extra).isNotNull()
    own = F.concat(F.lit("-"), F.xxhash64(F.col(spread), F.lit(3)).cast("string"))
    name = F.col(key).cast("string") if dict(groups.dtypes)[key] != "binary" else F.hex(key)
    joined = joined.withColumn("__name", F.when(away, own).otherwise(name))
    other = cold.select((F.hex(key) if dict(groups.dtypes)[key] == "binary" else F.col(key).cast("string")).alias("__other"), F.struct(*names).alias("__cold"))
    out = joined.join(other, F.col("__name") == F.col("__other"), "left")
    found = F.coalesce(extra, "__cold") if extra else F.col("__cold")
    return out.select(*rows.columns, *[found[n].alias(n) for n in names])
