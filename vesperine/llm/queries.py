"""The registered queries of the training-data operators, and their oracles.

Each query reads a whole table, applies one operator with its production
parameters and derives its digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperine.llm import chunk_dedup, ctw, decontaminate, exact_dedup, langid, minhash, mixing, secrets, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _ = secrets.scan(_table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in secrets.BASE_RULES]

    def of(kind: str):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in kinds]
    base = secrets.joined(F.filter("findings", lambda s: s["rank"] < len(kinds)))
    return paths.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.chunk_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_chunks", "n_removed", "spans", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    every = (
        op1_decontaminate, op2_exact_dedup, op3_suffix_dedup, op4_mixing, op5_secrets,
        op6_langid, op7_ctw, op8_chunk_dedup, op9_minhash, op10_warc,
    )
    return {query.__name__: query for query in every}


_OP2 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c
  FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY c ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY c) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         sha256('mix-1:' || doc_id) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
v AS (SELECT *, CAST([3, 1, 2][(k - 1) % 3 + 1] AS DOUBLE) AS wt FROM w),
l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM v) AS BIGINT) AS total,
    (1.5::DOUBLE * CAST((SELECT sum(source_size) FROM v) AS DOUBLE)
      - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER o, 0) AS DOUBLE))
    / ((SELECT sum(wt) FROM v) - coalesce(sum(wt) OVER o, 0)) AS level
  FROM v WINDOW o AS (ORDER BY source_size / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, source_size / wt) AS lv FROM l WHERE level * wt < 2.0::DOUBLE * source_size),
t AS (SELECT source, source_size, total, least(2.0::DOUBLE * source_size, coalesce(lv * wt, 2.0::DOUBLE * source_size)) AS target FROM l, f),
c AS (
  SELECT d.*, source_size, target, total, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT doc_id, h, size, total, p, (cum + p * source_size) / nullif(target, 0) AS fin
  FROM c, (SELECT unnest([0, 1]) AS p) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY fin, p, h) AS spent FROM q),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE spent <= 1.5 * total GROUP BY doc_id)
SELECT c.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM c LEFT JOIN k USING (doc_id)
"""


def _op5() -> str:
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pat = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, '{pat}') AS gaps, "
            f"regexp_extract_all(t, '{pat}', 0) AS hits, regexp_extract_all(t, '{pat}', {rule.group}) AS parts FROM d WHERE regexp_matches(t, '{pat}')"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (
  SELECT doc_id, rank, kind, least, i, length(gaps[i]) AS gap, length(hits[i]) AS hit, length(parts[i]) AS part
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
s AS (
  SELECT *, CAST(sum(gap + hit) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM u),
k AS (SELECT doc_id, rank, kind, stop - hit AS start, stop FROM s WHERE part >= least),
a AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


_OP10 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op4_mixing": _OP4, "op5_secrets": _op5(), "op10_warc": _OP10}
