"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a fixed shuffled order, repeated for as many
passes as a source may be used. A document's virtual finish time is the words
of its source up to and including it, divided by the source's target; all
sources are then served in the order of finish time until the total budget is
spent, so that each gets its target to within a document.

No source is gathered in one task: running totals are taken over hash slices
of a bounded number of rows, and slices are summed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperine.llm.common import write_shared

# Fixed value: a word is a maximal run of anything but this white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, source_size, source_docs, target``, one row per source.

    Sources by code point (null last) take the weights in turn and share
    ``budget`` times all words; what exceeds ``most`` times a source's own
    words is shared among the others by weight until none is above.

    With sources ordered by size over weight, those whose cap lies below the
    water level come first, so one running total gives the level. The table
    holds one row per source, not per document.
    """
    per = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    order = Window.orderBy(F.col(source_col).cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__k") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("__k", F.row_number().over(order)).withColumn("__w", weight)
    by_cap = Window.orderBy(F.col("source_size") / F.col("__w"), "__k")
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(budget) * F.col("__all") - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.col("__ws") - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    )
    per = (
        per.withColumn("__all", F.sum("source_size").over(everything))
        .withColumn("__ws", F.sum("__w").over(everything))
        .withColumn("__level", level)
        .withColumn("__free", F.col("__level") * F.col("__w") < F.lit(most) * F.col("source_size"))
        # the level of the first source below its cap holds for all after it
        .withColumn("__level", F.min_by(F.when(F.col("__free"), F.col("__level")), F.when(F.col("__free"), F.struct(F.col("source_size") / F.col("__w"), F.col("__k")))).over(everything))
    )
    cap = F.lit(most) * F.col("source_size")
    return per.select(
        source_col, "source_size", "source_docs",
        F.least(cap, F.coalesce(F.col("__level") * F.col("__w"), cap)).cast("double").alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    passes: int = 2,
    seed: str = "mix-1",
    slice_rows: int = 4096,
) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, taken``.

    ``taken`` counts words, a document taken twice counting double; none is
    taken more than ``passes`` times. Null texts have size 0 and are never
    taken; a null source is a source of its own. The order within a source is
    the SHA-256 of seed and id, so reruns agree; rows that repeat an id stand
    side by side and are taken alike. An empty table gives no rows.
    """
    sized = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size")
    ).withColumn("__h", F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("__id").cast("string"), F.lit("null"))).cast("binary"), 256))
    sized = write_shared(sized, "mix-sizes")
    targets = write_shared(source_targets(sized, "__source", weights, budget, float(passes)), "mix-targets")
    # Slices of a source: a prefix of the hash, as many as the source needs.
    count = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / F.lit(slice_rows))).cast("long")
    sliced = sized.join(targets, sized["__source"].eqNullSafe(targets["__source"])).drop(targets["__source"])
    prefix = F.conv(F.substring("__h", 1, 12), 16, 10).cast("long")
    sliced = sliced.withColumn("__slice", F.floor(prefix.cast("double") * count / F.lit(float(2**48))).cast("long"))
    by_source = Window.partitionBy("__source").orderBy("__slice")
    slices = (
        sliced.groupBy("__source", "__slice").agg(F.sum("size").alias("__sum"))
        .withColumn("__before", F.sum("__sum").over(by_source) - F.col("__sum"))
        .select(F.col("__source").alias("__s"), F.col("__slice").alias("__l"), "__before")
    )
    rows = sliced.join(slices, sliced["__source"].eqNullSafe(slices["__s"]) & (sliced["__slice"] == slices["__l"])).drop("__s", "__l")
    inside = Window.partitionBy("__source", "__slice").orderBy("__h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = write_shared(
        rows.withColumn("__cum", F.col("__before") + F.sum("size").over(inside))
        .select("__id", "__source", "size", "source_size", "target", "__h", "__cum"),
        "mix-queue",
    )

    def finish(k: int) -> Column:
        return (F.col("__cum") + F.lit(k) * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))

    # Order of service: finish time, then the shuffled order.
    total = targets.agg(F.sum("source_size").alias("__all"), F.sum("source_docs").alias("__docs"))
    queue = (
        rows.filter("size > 0")
        .select("size", F.explode(F.array(*[F.struct(finish(k).alias("f"), F.lit(k).alias("k"), F.col("__h").alias("h")) for k in range(passes)])).alias("__at"))
        .crossJoin(F.broadcast(total))
        .withColumn("__range", F.floor(F.col("__at.f") * F.greatest(F.lit(1.0), F.col("__docs") / F.lit(slice_rows))).cast("long"))
    )
    ranges = (
        queue.groupBy("__range").agg(F.sum("size").alias("__sum"), F.max("__all").alias("__all"))
        .withColumn("__before", F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum"))
        .filter(F.col("__before") <= F.lit(budget) * F.col("__all"))
        .orderBy(F.col("__range").desc()).limit(1).select("__range", "__before")
    )
    # Only the range where the budget runs out is sorted; all before it is taken whole.
    last = queue.join(F.broadcast(ranges), "__range")
    spent = F.col("__before") + F.sum("size").over(Window.partitionBy("__range").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = (
        last.withColumn("__spent", spent)
        .agg(F.max(F.when(F.col("__spent") <= F.lit(budget) * F.col("__all"), F.col("__at"))).alias("__cut"), F.max("__range").alias("__last"), F.max("__docs").alias("__d"))
    )
    scale = F.greatest(F.lit(1.0), F.col("__d") / F.lit(slice_rows))
    taken = F.lit(0)
    for k in range(passes):
        at = F.struct(finish(k).alias("f"), F.lit(k).alias("k"), F.col("__h").alias("h"))
        whole = F.floor(finish(k) * scale).cast("long") < F.col("__last")
        taken = taken + F.when(whole | F.coalesce(at <= F.col("__cut"), F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return rows.crossJoin(F.broadcast(cut)).select(
        F.col("__id").alias(id_col),
        F.col("__source").alias(source_col),
        "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("size") * taken).otherwise(F.lit(0)).cast("long").alias("taken"),
    )
