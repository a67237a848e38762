"""Corpus preparation: positives, deduplicated tiers, samples, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperine.functions import text as tx


def prepared(docs: DataFrame, id_col: str, title: Column, text: Column, most: int, seed: str) -> DataFrame:
    """``id, prepared, raw_bytes, original_bytes, truncated, text_hash, rank_hash``;
    documents without usable text are left out."""
    prefix = len(tx.DOCUMENT_PREFIX.encode())
    content = F.concat_ws(". ", F.nullif(tx.clean_line(title), F.lit("")), F.nullif(tx.clean_line(text), F.lit("")))
    out = docs.select(F.col(id_col).alias("id"), _once(content).alias("content")).filter("content <> ''")
    # what lies beyond the greatest length decides nothing but that it is beyond
    start = F.concat(F.lit(tx.DOCUMENT_PREFIX).cast("binary"), F.substring(F.col("content").cast("binary"), 1, most + 4)).cast("string")
    out = out.select("id", F.octet_length("content").cast("long").alias("raw_bytes"), _once(start).alias("start"))
    out = out.select("id", "raw_bytes", _once(tx.truncate_utf8(F.col("start"), most)).alias("prepared")).filter(F.col("prepared").startswith(tx.DOCUMENT_PREFIX))
    original = F.col("raw_bytes") + prefix
    return out.select(
        "id", "prepared", "raw_bytes", original.alias("original_bytes"), (original > most).alias("truncated"),
        F.sha2(F.col("prepared").cast("binary"), 256).alias("text_hash"), tx.rank_hash(seed, F.col("id")).alias("rank_hash"),
    )


def _once(value: Column) -> Column:
    """The value, as a generated column: filters on it are not pushed beneath it
    and later expressions do not repeat it."""
    return F.explode(F.array(value))


def first_ranked(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an order that begins with a hash (a top-n, taken
    per partition first)."""
    return df.orderBy(*order).limit(n)


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id")).filter("n > 1")


def duplicate_stats(rows: DataFrame, key: str) -> DataFrame:
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("unique_texts"))
    return out.withColumn("duplicate_rows", F.col("rows") - F.col("unique_texts")).withColumn(
        "duplicate_rate", F.when(F.col("rows") > 0, F.col("duplicate_rows") / F.col("rows")).otherwise(F.lit(0.0))
    )


def tiers(rows: DataFrame, small: int, large: int) -> DataFrame:
    """``id, tier, forced``: nested tiers (0: small, 1: the rest of large).

    ``rows`` has ``id, text_hash, rank_hash, positive``. Positives come first;
    fillers follow by rank, the first of each text, none whose text a positive
    has. Places are counted in ranges of the order (positive or not, then the
    first digits of the rank), whose sizes are summed first, so no task orders
    more than a 65,536th of the rows."""
    forced = F.col("positive").cast("int").alias("forced")
    best = rows.select("id", "text_hash", "rank_hash", forced).groupBy("text_hash").agg(
        F.min_by(F.struct("id", "rank_hash", "forced"), F.struct(-F.col("forced"), F.col("rank_hash"), F.col("id"))).alias("b")
    )
    first = best.select("b.*").withColumn("__r", F.concat((1 - F.col("forced")).cast("string"), F.substring("rank_hash", 1, 4)))
    sizes = first.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))  # at most 131,072 rows
    before = F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")
    wanted = sizes.withColumn("__before", before).filter(F.col("__before") < large).select("__r", "__before")
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("rank_hash", "id"))
    placed = first.join(F.broadcast(wanted), "__r").withColumn("place", F.col("__before") + inside).filter(F.col("place") <= large)
    return placed.select("id", F.when(F.col("place") <= small, 0).otherwise(1).alias("tier"), "forced", "rank_hash")


def tier_stats(selected: DataFrame, rows: DataFrame) -> DataFrame:
    """Sizes and truncation of each tier's texts (the large one holds both)."""
    joined = selected.select("id", "tier").join(rows, "id")
    both = joined.withColumn("in_tier", F.explode(F.when(F.col("tier") == 0, F.array(F.lit("small"), F.lit("large"))).otherwise(F.array(F.lit("large")))))
    return both.groupBy(F.col("in_tier").alias("name")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("prepared").cast("long")).alias("bytes"),
        F.max(F.octet_length("prepared")).cast("long").alias("largest"), F.count_if("truncated").alias("n_truncated"),
        F.count_distinct("text_hash").alias("unique_texts"),
    )


def not_nested(small: DataFrame, large: DataFrame) -> DataFrame:
    """Ids of the small tier that the large one lacks (must be none)."""
    return small.select("id").join(large.select("id"), "id", "left_anti")


def evenly_spaced(spark, count: int, n: int) -> DataFrame:  # noqa: ANN001
    """``idx``: n indices of 0..count-1, both ends among them."""
    if count < 0 or n < 0:
        raise ValueError("counts must not be negative")
    if n >= count:
        return spark.range(count).select(F.col("id").alias("idx"))
    if n <= 1:
        return spark.range(n).select(F.col("id").alias("idx"))
    return spark.range(n).select(F.expr(f"id * {count - 1} div {n - 1}").alias("idx"))


def sample_categories(rows: DataFrame, spaced: int, longest: int, explicit: list[int]) -> DataFrame:
    """``idx, categories``: evenly spaced rows, the longest (ties to the lower
    index) and explicit ones; ``rows`` has ``idx`` and ``n_bytes``."""
    spark = rows.sparkSession
    one = evenly_spaced(spark, rows.count(), spaced).withColumn("c", F.lit("evenly_spaced"))
    two = rows.orderBy(F.col("n_bytes").desc(), "idx").limit(longest).select("idx", F.lit("longest").alias("c"))
    named = spark.createDataFrame([(i,) for i in explicit], "idx long").join(rows.select("idx"), "idx", "left_semi").withColumn("c", F.lit("explicit"))
    return one.union(two).union(named).groupBy("idx").agg(F.array_sort(F.collect_set("c")).alias("categories"))


def positives(qrels: DataFrame, score: str = "score") -> DataFrame:
    return qrels.filter(F.col(score) > 0)


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """``id, kind, cosine, max_abs``: row-wise agreement of two embeddings."""
    pairs = left.select("id", "kind", F.col("v").alias("a")).join(right.select("id", F.col("v").alias("b")), "id")
    from vesperine.functions.vector import dot

    worst = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return pairs.select("id", "kind", (dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))).alias("cosine"), worst.alias("max_abs"))


def parity_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"), F.avg("cosine").alias("mean"), F.max("max_abs").alias("max_abs"),
        F.min_by("id", F.struct(F.round("cosine", 9), F.col("id"))).alias("worst_id"),
    )


def origin_faults(sample: DataFrame, origin: DataFrame) -> DataFrame:
    """``id, fault`` of sampled rows (``id, text_hash``) whose text is not what
    the corpus makes of that id, or that the corpus lacks."""
    joined = sample.join(origin.select("id", F.col("text_hash").alias("want")), "id", "left")
    fault = F.when(F.col("want").isNull(), "no origin").when(~F.col("want").eqNullSafe(F.col("text_hash")), "differs")
    return joined.select("id", fault.alias("fault")).filter("fault is not null")


def prefix_faults(small: DataFrame, large: DataFrame) -> DataFrame:
    """Ids of a smaller tier whose row the larger one does not have alike."""
    return small.select("id", "text_hash").join(large.select("id", "text_hash"), ["id", "text_hash"], "left_anti").select("id")


def parity_fixture(queries: DataFrame, docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``kind, source_index, text, utf8_bytes, categories``: all queries, and
    the documents of a sample (``source_index, categories``)."""
    one = queries.select(F.lit("query").alias("kind"), "source_index", "text", F.array(F.lit("query")).alias("categories"))
    two = docs.join(sample, "source_index").select(F.lit("document").alias("kind"), "source_index", "text", "categories")
    return one.unionByName(two).withColumn("utf8_bytes", F.octet_length("text").cast("long"))
