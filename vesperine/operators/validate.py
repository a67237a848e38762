"""Recorded figures against recomputed ones, and facts bound to their runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.operators.evaluate import close


def disagreements(declared: DataFrame, found: DataFrame, keys: list[str], relative: float = 1e-8, absolute: float = 1e-6) -> DataFrame:
    """``keys, figure, declared, found``: each figure (a column besides the
    keys, in both tables) that differs by more than the tolerances, and the keys
    that only one table has (figure ``row``). Keys must be distinct."""
    names = [c for c in declared.columns if c not in keys]
    a = declared.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in names]).alias("a"))
    b = found.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*[F.col(c).cast("double").alias(c) for c in names]).alias("b"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = a.join(b, on, "full").select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], "a", "b")
    nothing = F.struct(F.lit(None).cast("string").alias("figure"), F.lit(None).cast("double").alias("declared"), F.lit(None).cast("double").alias("found"))
    one = [F.when(F.col("a").isNull() | F.col("b").isNull(), F.struct(F.lit("row").alias("figure"), F.lit(None).cast("double").alias("declared"), F.lit(None).cast("double").alias("found")))]
    for c in names:
        x, y = F.col("a")[c], F.col("b")[c]
        same = F.coalesce(close(x, y, relative, absolute), x.isNull() & y.isNull())
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        one.append(F.when(both & ~same, F.struct(F.lit(c).alias("figure"), x.alias("declared"), y.alias("found"))))
    rows = joined.select(*keys, F.explode(F.array(*[F.coalesce(x, nothing) for x in one])).alias("f")).select(*keys, "f.*")
    return rows.filter("figure is not null")


def aggregate_builds(builds: DataFrame, keys: list[str]) -> DataFrame:
    """Builds of one artifact: how many, mean and greatest time, greatest memory,
    the least and greatest size, and the size as a part of the raw text."""
    return builds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("builds"), F.avg("build_ms").alias("mean_ms"), F.max("build_ms").alias("most_ms"), F.max("memory").alias("most_memory"),
        F.min("bytes").alias("least_bytes"), F.max("bytes").alias("most_bytes"), (100 * F.sum("bytes") / F.sum("raw_bytes")).alias("raw_percent"),
    )


def stats_of_builds(stats: DataFrame, builds: DataFrame) -> DataFrame:
    """Stats records joined to the builds of the same tier, system and manifest,
    with their storage rolled up; a record without a build is marked."""
    keys = ["tier", "system", "manifest"]
    known = builds.select(*keys).distinct().withColumn("__known", F.lit(True))
    out = stats.join(known, keys, "left")
    total = F.col("index_bytes") + F.col("docs_bytes") + F.col("meta_bytes")
    return out.select(*stats.columns, total.alias("total_bytes"), F.coalesce("__known", F.lit(False)).alias("bound"))


def facts(runs: list[tuple[dict, DataFrame]]) -> DataFrame:
    """One table of the rows of several runs, each with its run's settings as
    columns."""
    frames = [rows.select("*", *[F.lit(v).alias(k) for k, v in settings.items()]) for settings, rows in runs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without_runs(samples: DataFrame, excluded: DataFrame, key: str = "manifest") -> DataFrame:
    """Samples of runs that are not excluded, by their manifest's hash."""
    return samples.join(excluded.select(key).distinct(), key, "left_anti").select(*samples.columns)
