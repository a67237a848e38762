"""Registered queries over measurements: ``events`` stand for observations
(latency, system, recall), as no benchmark output is among the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.operators import evaluate as ev
from vesperine.operators import validate
from vesperine.plans import resume
from vesperine.sources import storage

KEYS = ["tier", "system", "search_value", "batch_size"]
FLOOR, TOLERANCE = 0.45, 0.05


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def samples(spark, sf_dir) -> DataFrame:
    """One observation per event."""
    e = _events(spark, sf_dir)
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "100K").otherwise("1M").alias("tier"), F.col("event_type").alias("system"),
        F.element_at(F.array(*[F.lit(x) for x in (16, 32, 64, 128)]), (F.col("user_id") / 2 % 4).cast("int") + 1).alias("search_value"),
        (F.col("user_id") % 3 * 8 + 8).cast("int").alias("batch_size"), F.col("value").alias("latency"),
        (F.col("event_id") % 11).alias("hits"), F.lit(10).cast("long").alias("asked"), (F.col("event_id") % 97).alias("candidates"),
    )


def latency_percentiles(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), ev.disc("value", 0.5).alias("p50"), ev.disc("value", 0.95).alias("p95"),
        F.round(ev.linear("value", 0.5), 6).alias("linear_p50"), F.round(ev.linear("value", 0.95), 6).alias("linear_p95"),
    )


def warm_latency(spark, sf_dir):
    """Means without each type's warm-up (its first hundred observations)."""
    return _events(spark, sf_dir).filter("event_id >= 100").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def aggregate_points(spark, sf_dir):
    out = ev.pooled(samples(spark, sf_dir), KEYS)
    return out.select(*KEYS, "observations", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "least", "most", "recall", "candidates")])


def matched_pairs(spark, sf_dir):
    points = ev.pooled(samples(spark, sf_dir), KEYS).select("tier", "system", "search_value", "batch_size", "recall", "candidates")
    out = ev.matched(points.filter("system = 'view'").drop("system"), points.filter("system = 'click'").drop("system"), FLOOR, TOLERANCE)
    return out.select(
        "tier", "native_search_value", "native_batch_size", "other_search_value", "other_batch_size", F.round("gap", 6).alias("gap"),
        F.round("native_recall", 6).alias("native_recall"), F.round("other_recall", 6).alias("other_recall"),
    )


def completeness_grid(spark, sf_dir):
    """Required (tier, system, value) combinations that no observation has;
    values of 256 are required and never measured."""
    s = samples(spark, sf_dir)
    tiers, systems = s.select("tier").distinct(), s.select("system").distinct()
    values = spark.createDataFrame([(v,) for v in (16, 32, 64, 128, 256)], "search_value int")
    grid = tiers.crossJoin(F.broadcast(systems)).crossJoin(F.broadcast(values))  # a grid of parameters, not of rows
    return ev.missing(grid, s.select("tier", "system", "search_value").distinct())


def parameter_sweep(spark, sf_dir):
    one = spark.createDataFrame([(i,) for i in ("pq", "simhash")], "index_kind string")
    two = spark.createDataFrame([(i,) for i in (16, 32, 64)], "ef_search int")
    three = spark.createDataFrame([(i,) for i in (0.25, 0.5, 1.0)], "rerank_ratio double")
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))


def point_conflicts(spark, sf_dir):
    """Points whose observations have more than one identity (batch size)."""
    return ev.conflicts(samples(spark, sf_dir), ["tier", "system", "search_value"], "batch_size")


def _runs(e, part):
    """Distinct (tier, system, artifact, run) of events."""
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 2).cast("string")).alias("tier"), F.col("event_type").alias("system"),
        (F.col("user_id") % 5).alias("artifact"), (part % 7).alias("run"),
    ).distinct()


def search_build_binding(spark, sf_dir):
    e = _events(spark, sf_dir)
    return ev.bound(_runs(e, F.col("event_id")), _runs(e, F.expr("event_id div 1000 * 3")))


def artifact_set_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("source", F.col("doc_id").cast("string").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return ev.set_hash(files, ["source"])


def storage_breakdown(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".index").when(F.col("doc_id") % 3 == 1, ".docs").otherwise(".meta.json"))
    size = F.octet_length("text").cast("long")
    kind = lambda pattern: F.coalesce(F.sum(F.when(name.rlike(pattern), size)), F.lit(0)).alias(
        {r"\.index$": "index_bytes", r"\.docs$": "docs_bytes", r"\.json$": "meta_bytes"}[pattern]
    )
    return docs.groupBy("lang").agg(kind(r"\.index$"), kind(r"\.docs$"), kind(r"\.json$"), F.sum(size).alias("total_bytes"))


def issue_list(spark, sf_dir):
    """Distinct issues in order: events without a plausible duration."""
    e = _events(spark, sf_dir).filter("value < 0.1")
    return e.select(F.lit("implausible-duration").alias("code"), F.col("event_type").alias("system"), (F.col("user_id") % 10).alias("tier")).distinct().orderBy("code", "system", "tier")


def recomputed_recall(spark, sf_dir):
    """Recorded recall of each query against what its ranked ids and the truth
    give; every third query's record is off."""
    from vesperine.plans import vectors

    found = storage.write_shared(vectors._hamming(spark, sf_dir, 10), "sketch-ranks")
    truth = vectors._truth(spark, sf_dir)
    own = ev.recall(found, truth, 10)
    recorded = own.select("query_id", (F.col("recall") + F.when(F.col("query_id") % 300 == 0, 0.1).otherwise(1e-12)).alias("recall"))
    return validate.disagreements(recorded, own.select("query_id", "recall"), ["query_id"]).select("query_id", "figure", F.round(F.col("declared") - F.col("found"), 6).alias("off"))


def _builds(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "100K").otherwise("1M").alias("tier"), F.col("event_type").alias("system"), (F.col("user_id") % 5).cast("string").alias("storage_hash"),
        (F.col("event_id") % 9).cast("string").alias("manifest"), F.col("value").alias("build_ms"), (F.col("event_id") % 31).alias("memory"),
        (F.col("event_id") % 97 + 1).alias("bytes"), (F.col("event_id") % 97 + 300).alias("raw_bytes"),
    )


def build_aggregates(spark, sf_dir):
    out = validate.aggregate_builds(_builds(spark, sf_dir), ["tier", "system", "storage_hash"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ms", "most_ms", "raw_percent")})


def stats_binding(spark, sf_dir):
    """Stats bound to builds; those of one manifest have none."""
    e = _events(spark, sf_dir)
    stats = e.select(
        F.when(F.col("user_id") % 2 == 0, "100K").otherwise("1M").alias("tier"), F.col("event_type").alias("system"), (F.col("event_id") % 10).cast("string").alias("manifest"),
        (F.col("event_id") % 11).alias("index_bytes"), (F.col("event_id") % 13).alias("docs_bytes"), F.lit(5).cast("long").alias("meta_bytes"),
    )
    out = validate.stats_of_builds(stats, _builds(spark, sf_dir))
    return out.groupBy("tier", "system", "bound").agg(F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("total_bytes"))


def search_facts(spark, sf_dir):
    """One table of per-run observations, with each run's settings."""
    e = _events(spark, sf_dir)
    runs = [({"ef_search": ef, "repetition": r}, e.filter(F.col("event_id") % 6 == i).select("event_type", "value")) for i, (ef, r) in enumerate((ef, r) for ef in (16, 32, 64) for r in (1, 2))]
    return validate.facts(runs).groupBy("ef_search", "repetition", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("most"))


def gate_exclusion(spark, sf_dir):
    """Observations without those of diagnostic runs."""
    rows = _events(spark, sf_dir).select((F.col("user_id") % 20).cast("string").alias("manifest"), "event_type", "value")
    gates = spark.createDataFrame([("3",), ("7",), ("7",)], "manifest string")
    return validate.without_runs(rows, gates).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("manifest").alias("runs"))


def point_validation(spark, sf_dir):
    """Recorded points against recomputed ones: recalls of one search value are
    off, and one system's points are missing."""
    found = storage.write_shared(ev.pooled(samples(spark, sf_dir), KEYS), "points")
    off = F.when(F.col("search_value") == 64, F.col("recall") + 0.01).otherwise(F.col("recall") * (1 + 1e-12))
    recorded = found.withColumn("recall", off).filter("system <> 'click' or search_value <> 16")
    return validate.disagreements(recorded, found, KEYS).select(*KEYS, "figure")


def parity_validation(spark, sf_dir):
    """A recorded parity report against a recomputed one."""
    from vesperine.operators import corpus
    from vesperine.plans import vectors

    rows = vectors.vectors(spark, sf_dir).select("id", F.when(F.col("label") < 5, "low").otherwise("high").alias("kind"), "v")
    report = storage.write_shared(corpus.parity_report(corpus.parity(rows, rows.withColumn("v", F.transform("v", lambda x: F.round(x, 2))))).select("kind", "n", "least", "mean"), "parity")
    recorded = report.withColumn("mean", F.when(F.col("kind") == "low", F.col("mean") - 0.001).otherwise(F.col("mean")))
    return validate.disagreements(recorded, report, ["kind"], 0.0, 1e-12).select("kind", "figure")


def derivation_validation(spark, sf_dir):
    """A declared account of the tiers against the recomputed one."""
    from vesperine.plans import texts

    found = storage.write_shared(texts.tier_stats(spark, sf_dir).select("name", "documents", "bytes", "unique_texts"), "tier-account")
    declared = found.withColumn("documents", F.when(F.col("name") == "small", F.col("documents") + 1).otherwise(F.col("documents")))
    return validate.disagreements(declared, found, ["name"])


def shared_cache_validation(spark, sf_dir):
    """Declared properties of a cache that are not what it holds; and whether
    a cache is still bound to a file after that has changed."""
    from vesperine.plans import roundtrips
    from vesperine.sources import text as ts
    from vesperine.sources import vectors as caches

    source, path = roundtrips._place(spark, "source"), roundtrips._place(spark, "bound")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding")
    storage.write_bytes(spark, source, b"one\ntwo\n")
    one = ts.source_identity(spark, source).first()
    caches.write_cache(rows, path, "driver:64", 64, one["size"], one["sha256"])
    out = [(f, "declared") for f in caches.cache_faults(spark, path, {"fingerprint": "other", "dimension": 64, "rows": -1, "source_size": 8})]
    caches.bound_cache(spark, path, source, "driver:64")
    storage.delete(spark, source)
    storage.write_bytes(spark, source, b"one\nTWO\n")
    try:
        caches.bound_cache(spark, path, source, "driver:64")
    except ValueError:
        out.append(("source", "changed"))
    return spark.createDataFrame(out, "what string, why string")


def resumed_ground_truth(spark, sf_dir):
    """Ground truth made in two calls, the first of which ends early."""
    from vesperine.plans import roundtrips, vectors

    path = roundtrips._place(spark, "resumed-truth")
    rows, queries = vectors.vectors(spark, sf_dir).select("id", "v"), vectors.asked(spark, sf_dir).select("query_id", "v")
    resume.ground_truth(rows, queries, path, 10, block=2, most=1)
    return resume.ground_truth(rows, queries, path, 10, block=2).select("query_id", "rank", F.col("id").alias("vec_id"))


def resumed_cache(spark, sf_dir):
    """A cache made in two calls: rows that stand are not embedded again."""
    from vesperine import api
    from vesperine.plans import roundtrips

    path = roundtrips._place(spark, "resumed-cache")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select("doc_id", "text", "lang")
    half = resume.cache(docs.filter("lang = 'de'").drop("lang"), api.hash_embedder(64), path).count()
    rows = resume.cache(docs.drop("lang"), api.hash_embedder(64), path)
    return rows.agg(F.lit(half).cast("long").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def repeated_stage(spark, sf_dir):
    """Measurements taken up again: three of five were kept, so two and one
    warm-up are run; another identity is refused."""
    from vesperine.plans import roundtrips

    path, ran = roundtrips._place(spark, "stage"), []

    def run(k: int) -> dict:
        ran.append(k)
        return {"run": k, "n": spark.read.parquet(f"{sf_dir}/region.parquet").count()}

    resume.repeated(spark, path, {"stage": "a"}, run, 1, 3)
    before = len(ran)
    records = resume.repeated(spark, path, {"stage": "a"}, run, 1, 5)
    try:
        resume.repeated(spark, path, {"stage": "b"}, run, 1, 5)
        refused = False
    except resume.StaleWork:
        refused = True
    return spark.createDataFrame([(r["run"], r["n"], before, len(ran), refused) for r in records], "run long, n long, first long, ran long, refused boolean")


QUERIES = (
    latency_percentiles, warm_latency, aggregate_points, matched_pairs, completeness_grid, parameter_sweep, point_conflicts,
    search_build_binding, artifact_set_hash, storage_breakdown, issue_list, recomputed_recall, build_aggregates, stats_binding, search_facts,
    gate_exclusion, point_validation, parity_validation, derivation_validation, shared_cache_validation, resumed_ground_truth, resumed_cache,
    repeated_stage,
)

_SAMPLES = """
s AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN '100K' ELSE '1M' END AS tier, event_type AS system, [16, 32, 64, 128][(user_id // 2) % 4 + 1] AS search_value,
    CAST(user_id % 3 * 8 + 8 AS INT) AS batch_size, value AS latency, event_id % 11 AS hits, 10 AS asked, event_id % 97 AS candidates FROM events)"""
_POINTS = f"""{_SAMPLES},
p AS (
  SELECT tier, system, search_value, batch_size, count(*) AS observations, avg(latency) AS mean, quantile_cont(latency, 0.5) AS p50,
    quantile_cont(latency, 0.95) AS p95, min(latency) AS least, max(latency) AS most, sum(hits) / sum(asked) AS recall, avg(candidates) AS candidates
  FROM s GROUP BY ALL)"""
_BIND = "SELECT DISTINCT 't' || (user_id % 2) AS tier, event_type AS system, user_id % 5 AS artifact, {} % 7 AS run FROM events"


def oracles() -> dict[str, str]:
    from vesperine.plans.vectors import _TRUTH

    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "p50", "p95", "least", "most", "recall", "candidates"))
    parts = ", ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT) AS p{i}" for i in range(5))
    return {
        "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(quantile_cont(value, 0.5), 6) AS linear_p50, round(quantile_cont(value, 0.95), 6) AS linear_p95 FROM events GROUP BY event_type",
        "warm_latency": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_id >= 100 GROUP BY event_type",
        "aggregate_points": f"WITH {_POINTS} SELECT tier, system, search_value, batch_size, observations, {rounded} FROM p",
        "matched_pairs": f"""WITH {_POINTS},
j AS (
  SELECT a.tier, a.search_value AS native_search_value, a.batch_size AS native_batch_size, b.search_value AS other_search_value, b.batch_size AS other_batch_size,
    abs(a.recall - b.recall) AS gap, a.recall AS native_recall, b.recall AS other_recall,
    row_number() OVER (PARTITION BY a.tier ORDER BY round(abs(a.recall - b.recall), 12), round(a.candidates + b.candidates, 9), round(-least(a.recall, b.recall), 12), a.search_value, b.search_value, b.batch_size) AS k
  FROM p a JOIN p b USING (tier)
  WHERE a.system = 'view' AND b.system = 'click' AND a.recall >= {FLOOR} AND b.recall >= {FLOOR} AND abs(a.recall - b.recall) <= {TOLERANCE})
SELECT tier, native_search_value, native_batch_size, other_search_value, other_batch_size, round(gap, 6) AS gap, round(native_recall, 6) AS native_recall, round(other_recall, 6) AS other_recall FROM j WHERE k = 1""",
        "completeness_grid": f"WITH {_SAMPLES} SELECT * FROM (SELECT DISTINCT tier FROM s), (SELECT DISTINCT system FROM s), (SELECT unnest([16, 32, 64, 128, 256]) AS search_value) EXCEPT SELECT tier, system, search_value FROM s",
        "parameter_sweep": "SELECT * FROM (VALUES ('pq'), ('simhash')) a(index_kind), (VALUES (16), (32), (64)) b(ef_search), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) c(rerank_ratio)",
        "point_conflicts": f"WITH {_SAMPLES} SELECT tier, system, search_value, count(DISTINCT batch_size) AS n FROM s GROUP BY ALL HAVING count(DISTINCT batch_size) > 1",
        "search_build_binding": f"""WITH s AS ({_BIND.format('event_id')}), b AS ({_BIND.format('(event_id // 1000 * 3)')}),
j AS (SELECT s.*, arg_min(b.run, (b.run <> s.run, b.run)) AS build_run FROM s LEFT JOIN b USING (tier, system, artifact) GROUP BY ALL)
SELECT *, CASE WHEN build_run IS NULL THEN 'unbound' WHEN build_run = run THEN 'same-run' ELSE 'inherited' END AS status FROM j""",
        "artifact_set_hash": f"WITH f AS (SELECT source, sha256(doc_id || ':' || sha256(text)) AS h FROM documents), g AS (SELECT source, count(*) AS n, {parts} FROM f GROUP BY source) SELECT source, n, sha256(concat_ws(':', p0, p1, p2, p3, p4, n)) AS set_hash FROM g",
        "storage_breakdown": "SELECT lang, CAST(coalesce(sum(octet_length(encode(text))) FILTER (doc_id % 3 = 0), 0) AS BIGINT) AS index_bytes, CAST(coalesce(sum(octet_length(encode(text))) FILTER (doc_id % 3 = 1), 0) AS BIGINT) AS docs_bytes, CAST(coalesce(sum(octet_length(encode(text))) FILTER (doc_id % 3 = 2), 0) AS BIGINT) AS meta_bytes, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM documents GROUP BY lang",
        "issue_list": "SELECT DISTINCT 'implausible-duration' AS code, event_type AS system, user_id % 10 AS tier FROM events WHERE value < 0.1",
        "recomputed_recall": "SELECT vec_id AS query_id, 'recall' AS figure, 0.1::DOUBLE AS off FROM embeddings WHERE vec_id % 300 = 0",
        "build_aggregates": """SELECT CASE WHEN user_id % 2 = 0 THEN '100K' ELSE '1M' END AS tier, event_type AS system, CAST(user_id % 5 AS VARCHAR) AS storage_hash, count(*) AS builds,
round(avg(value), 6) AS mean_ms, round(max(value), 6) AS most_ms, max(event_id % 31) AS most_memory, min(event_id % 97 + 1) AS least_bytes, max(event_id % 97 + 1) AS most_bytes,
round(100 * sum(event_id % 97 + 1) / sum(event_id % 97 + 300), 6) AS raw_percent FROM events GROUP BY ALL""",
        "stats_binding": """SELECT CASE WHEN user_id % 2 = 0 THEN '100K' ELSE '1M' END AS tier, event_type AS system, event_id % 10 <> 9 AS bound, count(*) AS n,
CAST(sum(event_id % 11 + event_id % 13 + 5) AS BIGINT) AS total_bytes FROM events GROUP BY ALL""",
        "search_facts": "SELECT CAST([16, 16, 32, 32, 64, 64][event_id % 6 + 1] AS INT) AS ef_search, CAST(event_id % 2 + 1 AS INT) AS repetition, event_type, count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY ALL",
        "gate_exclusion": "SELECT event_type, count(*) AS n, count(DISTINCT user_id % 20) AS runs FROM events WHERE user_id % 20 NOT IN (3, 7) GROUP BY 1",
        "point_validation": f"WITH {_POINTS} SELECT tier, system, search_value, batch_size, CASE WHEN search_value = 64 THEN 'recall' ELSE 'row' END AS figure FROM p WHERE search_value = 64 OR system = 'click' AND search_value = 16",
        "parity_validation": "SELECT 'low' AS kind, 'mean' AS figure",
        "derivation_validation": "SELECT 'small' AS name, 'documents' AS figure, CAST(count(*) // 10 + 1 AS DOUBLE) AS declared, CAST(count(*) // 10 AS DOUBLE) AS found FROM documents",
        "shared_cache_validation": "SELECT * FROM (VALUES ('fingerprint', 'declared'), ('rows', 'declared'), ('source', 'changed')) t(what, why)",
        "resumed_ground_truth": f"WITH {_TRUTH} SELECT query_id, CAST(rank AS INT) AS rank, id AS vec_id FROM truth",
        "resumed_cache": "SELECT count(*) FILTER (lang = 'de') AS first, count(*) AS n, count(*) AS ids FROM documents WHERE text IS NOT NULL",
        "repeated_stage": "SELECT i AS run, (SELECT count(*) FROM region) AS n, 4::BIGINT AS first, 7::BIGINT AS ran, true AS refused FROM range(5) r(i)",
    }
