"""Text scans and sinks: lines, identities, ground truth, ids, metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vesperine.functions import text as tx


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text``: non-empty LF lines, one trailing CR stripped, numbered
    from 0 in the order of file names and lines.

    A dense number needs the count of all lines before: lines are numbered
    within the splits that the scan deals out, splits are counted, and a running
    total over splits (one row each) is added."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace("value", "\r$", "").alias("text"), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s")
    )
    lines = lines.filter("text <> ''").withColumn("__n", F.monotonically_increasing_id())
    splits = lines.groupBy("__f", "__s").agg(F.count(F.lit(1)).alias("__c"), F.min("__n").alias("__low"))
    before = F.sum("__c").over(Window.orderBy("__f", "__s")) - F.col("__c")
    splits = splits.select("__f", "__s", (before - F.col("__low")).alias("__plus"))
    moved = F.raise_error(F.lit("the scan dealt its splits out anew")).cast("long")
    return lines.join(splits, ["__f", "__s"], "left").select(F.coalesce(F.col("__n") + F.col("__plus"), moved).alias("doc_id"), "text")


def source_identity(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256`` of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


GROUND_TRUTH = "GT1"  # the first word of a ground-truth file, if not told another


def ground_truth_rows(truth: DataFrame) -> DataFrame:
    """``query_id, ids``: one blank-joined row per query, ranks in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    return truth.groupBy("query_id").agg(F.array_join(ids, " ").alias("ids"))


def write_ground_truth(truth: DataFrame, path: str, k: int, corpus: int, magic: str) -> None:
    """A header ``magic queries k corpus`` and a row per query, as one file."""
    rows = ground_truth_rows(truth)
    n = rows.count()
    head = rows.sparkSession.createDataFrame([(-1, f"{magic} {n} {k} {corpus}")], "query_id long, ids string")
    head.union(rows).coalesce(1).sortWithinPartitions("query_id").select("ids").write.text(path, lineSep="\n")


def parse_ground_truth(lines: DataFrame, queries: int, k: int, corpus: int, magic: str) -> DataFrame:
    """``query_id, rank, id`` of ``(doc_id, text)`` lines, the first k ranks.

    Rejects another header, fewer than k ids a row, another number of rows, ids
    out of range or repeated in a row."""
    head = lines.filter("doc_id = 0").first()
    if head is None or not (m := re.fullmatch(re.escape(magic) + r" (\d+) (\d+) (\d+)", head["text"])):
        raise ValueError("no ground-truth header")
    n, wide, size = map(int, m.groups())
    if (n, size) != (queries, corpus) or wide < k:
        raise ValueError("the ground truth is of other queries, another corpus or too few ranks")
    rows = lines.filter("doc_id > 0").select((F.col("doc_id") - 1).alias("query_id"), "text")
    fine = tx.is_id_list(F.col("text"))
    ids = F.when(fine, tx.id_list(F.col("text")))
    whole = fine & (F.size(ids) == wide) & (F.size(F.array_distinct(ids)) == wide) & F.forall(ids, lambda x: x < corpus)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(whole, F.lit(False))).alias("good")).first()
    if seen["n"] != queries or seen["good"] != queries:
        raise ValueError("a ground-truth row is missing or not k distinct ids of the corpus")
    return rows.select("query_id", F.posexplode(F.slice(ids, 1, k)).alias("pos", "id")).select("query_id", (F.col("pos") + 1).alias("rank"), "id")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``id, text`` of a JSON-lines query file; malformed lines, missing or
    repeated ids are errors."""
    rows = spark.read.schema("_id string, text string").json(path, mode="FAILFAST").select(F.col("_id").alias("id"), "text")
    _distinct(rows, "id")
    if not rows.filter(tx.identifier(F.col("id")).isNull() | (tx.clean_line(F.col("text")) == "")).isEmpty():
        raise ValueError("a query without a usable id or text")
    return rows


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``id, title, text`` of a JSON-lines corpus; repeated ids are errors."""
    rows = spark.read.schema("_id string, title string, text string").json(path, mode="FAILFAST")
    rows = rows.select(F.col("_id").alias("id"), "title", "text")
    _distinct(rows, "id")
    if not rows.filter(F.coalesce(tx.identifier(F.col("id")), F.lit("")) == "").isEmpty():
        raise ValueError("a document without a usable id")
    return rows


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, corpus_id, score`` of a TSV with a header: three columns,
    finite scores, no pair twice."""
    raw = spark.read.schema("query_id string, corpus_id string, score_text string").csv(path, sep="\t", header=True, mode="FAILFAST", quote="")
    rows = raw.withColumn("score", tx.parse_decimal(F.col("score_text")))
    bad = F.col("query_id").isNull() | F.col("corpus_id").isNull() | F.col("score").isNull()
    if not rows.filter(bad).isEmpty():
        raise ValueError("a relevance row without ids or a finite score")
    if not rows.groupBy("query_id", "corpus_id").count().filter("count > 1").isEmpty():
        raise ValueError("a relevance pair stands twice")
    return rows


def _distinct(rows: DataFrame, column: str) -> None:
    if not rows.groupBy(column).count().filter("count > 1").isEmpty():
        raise ValueError(f"{column} is not unique")


def key_values(lines: DataFrame) -> DataFrame:
    """``key, value`` of ``key=value`` lines; others are left out."""
    parts = F.split("text", "=", 2)
    return lines.filter(F.col("text").contains("=")).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def observations_csv(rows: DataFrame, path: str) -> None:
    """Per-query observations, ids blank-joined, with a header."""
    rows.write.csv(path, header=True)


def read_observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def revalidated(rows: DataFrame, k: int, corpus: int) -> DataFrame:
    """``query_index, fault`` of observations (``query_index, recall,
    latency_ms, exact_recomputations, result_ids``) that cannot be: ids that are
    no canonical list, not k distinct ones of the corpus, a recall that is not a
    multiple of 1/k from 0 to 1, a latency that is not finite and positive."""
    ids = F.when(tx.is_id_list(F.col("result_ids")), tx.id_list(F.col("result_ids")))
    hits = F.col("recall") * k
    fault = (
        F.when(ids.isNull(), "ids")
        .when((F.size(ids) != k) | (F.size(F.array_distinct(ids)) != k) | F.exists(ids, lambda x: x >= corpus), "results")
        .when(~F.coalesce((F.abs(hits - F.round(hits)) < 1e-9) & F.col("recall").between(0, 1), F.lit(False)), "recall")
        .when(~F.coalesce((F.col("latency_ms") > 0) & (F.col("latency_ms") < float("inf")), F.lit(False)), "latency")
        .when(F.col("exact_recomputations") < k, "recomputations")
    )
    return rows.select("query_index", fault.alias("fault")).filter("fault is not null")


def parse_bool(text: Column) -> Column:
    """true or false, 1 or 0; null for anything else."""
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def parse_time(text: Column) -> Column:
    """A timestamp of a strict ISO-8601 text with a zone; null for others."""
    whole = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$")
    return F.when(whole, F.try_to_timestamp(text))


def out_of_order(rows: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows whose times do not parse or do not follow one another."""
    a, b = parse_time(F.col(earlier)), parse_time(F.col(later))
    return rows.filter(~F.coalesce(a <= b, F.lit(False)))


def staged(rows: DataFrame, name: str) -> DataFrame:
    """A corpus view under constraints: distinct ids, no empty text, lengths
    that agree; a row that breaks one is an error when the view is read."""
    _distinct(rows, "id")
    broken = F.raise_error(F.concat(F.lit("a row breaks a constraint: "), F.coalesce(F.col("id").cast("string"), F.lit("no id")))).cast("string")
    fine = F.col("id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0) & (F.octet_length("text") == F.col("n_bytes"))
    out = rows.withColumn("text", F.when(F.coalesce(fine, F.lit(False)), F.col("text")).otherwise(broken))
    out.createOrReplaceTempView(name)
    return out


def write_tier(rows: DataFrame, path: str, parts: int = 32) -> DataFrame:
    """Write a tier's texts (``id, text``), one line each in the order of ids,
    and return its manifest: ``lines, bytes, digest``, computed from what
    stands on disk, the digest of the lines' own digests whatever their order."""
    texts = rows.select("id", F.regexp_replace("text", "[\r\n]+", " ").alias("text"))
    texts.repartitionByRange(parts, "id").sortWithinPartitions("id").select("text").write.text(path)
    return tier_manifest(rows.sparkSession, path)


def tier_manifest(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n")
    one = F.conv(F.substring(F.sha2(F.col("value").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"), F.sum(one).cast("string").alias("digest")
    )


def report_markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``line`` of a Markdown table, the head first (``ord`` 0 and 1)."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    body = rows.select(F.lit(2).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))]
    return rows.sparkSession.createDataFrame(head, "ord int, line string").union(body)


def as_json(*columns: Column) -> Column:
    """One JSON object, null fields left out; text that is not valid UTF-8 is an
    error."""
    wrong = F.lit(False)
    for column in columns:
        wrong = wrong | ~F.coalesce(F.is_valid_utf8(column.cast("string")), F.lit(True))
    return F.when(wrong, F.raise_error(F.lit("a field is not valid UTF-8")).cast("string")).otherwise(F.to_json(F.struct(*columns)))


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of several sweeps, with the union of their columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def dense_ids(rows: DataFrame, order: str, slice_rows: int = 1 << 16) -> DataFrame:
    """Adds ``dense_id``: 0, 1, ... in the order of a unique long column,
    numbered inside ranges whose sizes are summed first."""
    ranged = rows.withColumn("__r", F.floor(F.col(order) / F.lit(slice_rows)))
    sizes = ranged.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).select("__r", "__before")
    inside = F.row_number().over(Window.partitionBy("__r").orderBy(order))
    return ranged.join(sizes, "__r").withColumn("dense_id", F.col("__before") + inside - 1).drop("__r", "__before")
