"""Evaluation: recall, percentiles, pooled points, matching, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``query_id, found, recall``: the part of each query's true first k among
    its first k results (1 where the truth is empty)."""
    true = truth.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("t"))
    got = results.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("g"))
    joined = true.join(got, ["query_id", "id"], "full")
    counted = joined.groupBy("query_id").agg(F.count_if((F.col("t") == 1) & (F.col("g") == 1)).alias("found"), F.count("t").alias("n"))
    return counted.select("query_id", "found", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("found") / F.col("n")).alias("recall"))


def result_faults(results: DataFrame, k: int, corpus: int) -> DataFrame:
    """Queries whose results are not k distinct ids in range."""
    checked = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("u"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )
    return checked.filter((F.col("n") != k) | (F.col("u") != k) | (F.col("lo") < 0) | (F.col("hi") >= corpus)).select("query_id")


def linear(value: str, part: float) -> Column:
    return F.expr(f"percentile({value}, {part}D)")


def disc(value: str, part: float) -> Column:
    """``sorted[ceil(part * n) - 1]``, the nearest-rank percentile."""
    return F.expr(f"percentile_disc({part}D) within group (order by {value})")


def pooled(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled points: latency mean, linear percentiles, extremes, and recall
    averaged over all observations of a key."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.avg("latency").alias("mean"), linear("latency", 0.5).alias("p50"),
        linear("latency", 0.95).alias("p95"), F.min("latency").alias("least"), F.max("latency").alias("most"),
        (F.sum("hits") / F.sum("asked")).alias("recall"), F.avg("candidates").alias("candidates"),
    )


def conflicts(samples: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Keys that do not have one identity."""
    return samples.groupBy(*keys).agg(F.count_distinct(identity).alias("n")).filter("n > 1")


def matched(native: DataFrame, other: DataFrame, floor: float, tolerance: float) -> DataFrame:
    """Per tier, the pair of points that both reach ``floor`` with recalls at
    most ``tolerance`` apart, first by (gap, candidates, -least recall, search
    values, batch). Pairs are joined by tier, of which points are few."""
    a = native.select(*[F.col(c).alias(f"native_{c}" if c != "tier" else c) for c in native.columns])
    b = other.select(*[F.col(c).alias(f"other_{c}" if c != "tier" else c) for c in other.columns])
    gap = F.abs(F.col("native_recall") - F.col("other_recall"))
    pairs = a.join(b, "tier").filter((F.col("native_recall") >= floor) & (F.col("other_recall") >= floor) & (gap <= tolerance))
    w = Window.partitionBy("tier").orderBy(
        F.round(gap, 12), F.round(F.col("native_candidates") + F.col("other_candidates"), 9),
        F.round(-F.least("native_recall", "other_recall"), 12), "native_search_value", "other_search_value", "other_batch_size",
    )
    return pairs.withColumn("gap", gap).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def missing(grid: DataFrame, observed: DataFrame) -> DataFrame:
    """Required combinations that were not observed."""
    return grid.join(observed, grid.columns, "left_anti")


def bound(searches: DataFrame, builds: DataFrame) -> DataFrame:
    """Each search with the build of its (tier, system, artifact): one of the
    same run if there is, else an inherited one, else unbound."""
    b = builds.select("tier", "system", "artifact", F.col("run").alias("build_run"))
    joined = searches.join(b, ["tier", "system", "artifact"], "left")
    same = F.col("run") == F.col("build_run")
    out = joined.groupBy(*searches.columns).agg(F.min_by("build_run", F.struct(~same, F.col("build_run"))).alias("build_run"))
    status = F.when(F.col("build_run").isNull(), "unbound").when(F.col("build_run") == F.col("run"), "same-run").otherwise("inherited")
    return out.withColumn("status", status)


def set_hash(files: DataFrame, keys: list[str]) -> DataFrame:
    """An order-independent hash of each key's (name, digest) pairs. Pairs are
    digested and summed, so no set is gathered."""
    one = F.sha2(F.concat_ws(":", "name", "digest").cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(one, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    out = files.distinct().groupBy(*keys).agg(*parts, F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "n", F.sha2(F.concat_ws(":", *[F.col(f"p{i}").cast("string") for i in range(5)], F.col("n").cast("string")).cast("binary"), 256).alias("set_hash"))


def close(a: Column, b: Column, relative: float = 1e-8, absolute: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
