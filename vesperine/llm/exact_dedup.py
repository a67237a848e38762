"""Exact deduplication by skew-safe combining.

Three stages, each grouping by digest *and* full normalised content, so that
two texts with one digest never merge:

1. every scan partition combines its own copies (the map side of stage 2);
2. the partition number, modulo ``salts``, salts the digest groups, so that one
   content with a third of all rows is spread over ``salts`` tasks;
3. at most ``salts`` winners per content are combined into one.

Everything is a DataFrame aggregate; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperine.llm.common import by_row, joined_to_groups, long_id, write_shared

# The white space that normalisation deletes.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_HALF = 2**63
_BASE = 2**65


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _number(value: int, digits: int = 21) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def _preference(text: Column, doc_id: Column) -> Column:
    """One decimal that is largest for the longest text, then the smallest id;
    a null id loses to every other."""
    length = F.length(F.coalesce(text, F.lit(""))).cast("decimal(11,0)")
    by_id = F.coalesce(_number(_HALF) - doc_id.cast("decimal(19,0)"), _number(0))
    return (length * _number(_BASE) + by_id).cast("decimal(36,0)")


def _preferred_id(preference: Column) -> Column:
    rest = preference % _number(_BASE)
    return F.when(rest == 0, F.lit(None)).otherwise((_number(_HALF) - rest).cast("long")).cast("long")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``.

    Texts are equal when identical after deleting white space. The row with
    the most code points in the original text stays, then the smallest id.
    A null text is empty, and all empty texts form one group. A null id loses
    to every other. Rows that repeat an id and a text count each in
    ``group_size`` and share their ``kept`` flag. Other columns are ignored;
    an empty table gives no rows; an id that is no integer is an error. ``digest`` may be weak: contents are compared
    in full, and colliding digests only cost a wider join.
    """
    rows = docs.select(
        long_id(docs, id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        normalised(F.col(text_col)).alias("__content"),
    ).withColumn("__digest", digest(F.col("__content")))
    merged = (
        rows.select("__digest", "__content", _preference(F.col("__text"), F.col("__id")).alias("__best"))
        .withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("__digest", "__content", "__salt")
        .agg(F.max("__best").alias("__best"), F.count(F.lit(1)).alias("__n"))
    )
    winners = merged.groupBy("__digest", "__content").agg(F.max("__best").alias("__best"), F.sum("__n").alias("__n"))
    found = winners.select("__digest", _preferred_id(F.col("__best")).alias("__keep"), "__n")
    groups = write_shared(found, "exact-groups")
    collides = not groups.groupBy("__digest").count().filter("count > 1").isEmpty()
    if collides:
        groups = write_shared(
            winners.select("__digest", "__content", _preferred_id(F.col("__best")).alias("__keep"), "__n"), "exact-contents"
        )
    on = ["__digest", "__content"] if collides else ["__digest"]
    # A content of one row is its own winner, so only real groups are joined.
    rows = rows.select("__id", *on)
    copied = groups.filter("__n > 1")
    joined = rows.join(copied, on, "left") if collides else joined_to_groups(rows, copied, "__digest", "__n", "__id")
    keep = F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("__id")).alias("kept"),
        F.col("__digest").alias("digest"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with their columns: one row of each content, also
    where ids repeat, are null or are no integers."""
    return by_row(docs, id_col, lambda rows, row: exact_dedup(rows, row, text_col, **options).filter("not kept").select(row))
