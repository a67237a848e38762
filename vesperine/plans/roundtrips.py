"""Registered queries that write driver tables through a sink of the engine and
read them back through the matching source: caches, stores, ground truth,
retrieval files, reports and published indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vesperine import api
from vesperine.functions import hashing
from vesperine.functions import text as tx
from vesperine.operators import corpus, neighbours, quantize, search
from vesperine.plans import publish, texts, vectors
from vesperine.sources import documents, storage
from vesperine.sources import text as ts
from vesperine.sources import vectors as caches


def _place(spark, name: str) -> str:
    return f"{storage.shared_dir(spark)}/vesperine/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents")


def line_scan(spark, sf_dir):
    """The lines of all documents, written as one file in the order of ids."""
    path = _place(spark, "lines")
    rows = _documents(spark, sf_dir).select("doc_id", "text")
    rows.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select("text").write.text(path)
    return ts.read_lines(spark, path).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("line_hash"))


def source_identity(spark, sf_dir):
    """Size and digest of a written file, as a bound cache records them."""
    path = _place(spark, "source")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    rows.repartitionByRange(1, "item_id").sortWithinPartitions("item_id").select("text").write.text(path)
    return ts.source_identity(spark, path).filter("size > 0").select("size", "sha256")


def _cached(spark, sf_dir) -> str:
    path = _place(spark, "cache")
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    caches.write_cache(rows, path, "driver:64", vectors.D, 7, "ab")
    return path


def embedding_cache(spark, sf_dir):
    """A cache's rows, read back after its identity was checked."""
    n = _table(spark, sf_dir, "embeddings").count()
    rows = caches.read_cache(spark, _cached(spark, sf_dir), "driver:64", n, vectors.D, (7, "ab"))
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(F.col("row_id").alias("vec_id"), F.size("embedding").alias("n"), F.round(weighed, 2).alias("weighed"))


def cache_to_embed(spark, sf_dir):
    """What a resumed run still has to embed: the rows a cache lacks."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")
    path = _place(spark, "part-cache")
    caches.write_cache(rows.filter("label < 5").select("row_id", "embedding"), path, "driver:64", vectors.D)
    return caches.extend_cache(caches.read_cache(spark, path, "driver:64"), rows.select("row_id")).withColumnRenamed("row_id", "vec_id")


def binary_cache(spark, sf_dir):
    """The single-file cache form, written and read back."""
    path = _place(spark, "binary")
    rows = _table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").toArrow()
    raw = caches.encode_binary(neighbours.matrix(rows["embedding"].combine_chunks()), b"driver:64", b"CACHE002", (7, b"s" * 32))
    storage.write_bytes(spark, path, raw)
    out = caches.read_binary(spark, path, b"CACHE002", True)
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return out.select("row_id", F.size("embedding").alias("n"), F.round(weighed, 2).alias("weighed"))


def embedding_lookup(spark, sf_dir):
    """Each document's vector, looked up by its text: one per distinct text."""
    rows = _documents(spark, sf_dir).filter("text is not null").select("doc_id", "text")
    one = rows.groupBy("text").agg(F.min("doc_id").alias("vec"))
    cache = one.select("text", F.array(F.col("vec").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    found = caches.by_text(rows, cache)
    return found.select("doc_id", F.col("embedding")[0].cast("long").alias("least_id"))


def ground_truth_file(spark, sf_dir):
    """Ground truth, written as a file of lines, parsed and checked."""
    truth = vectors._truth(spark, sf_dir)
    n = _table(spark, sf_dir, "embeddings").count()
    dense = truth.select(F.expr("query_id div 100").alias("query_id"), "rank", "id")
    path = _place(spark, "truth")
    ts.write_ground_truth(dense, path, 10, n, ts.GROUND_TRUTH)
    got = ts.parse_ground_truth(ts.read_lines(spark, path), -(-n // 100), 5, n, ts.GROUND_TRUTH)
    return got.select((F.col("query_id") * 100).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"))


def document_store(spark, sf_dir):
    """Lookups of a store: asked ids in order, some of them twice."""
    path = _place(spark, "store")
    documents.write(_documents(spark, sf_dir), path, 4)
    store = documents.open_store(spark, path)
    ids = store.select("doc_id").filter("doc_id % 10 = 3")
    asked = ids.select(F.col("doc_id").alias("ord"), "doc_id").union(ids.select(F.col("doc_id") + 1, "doc_id"))
    return documents.read_many(store, asked).select("ord", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def query_file(spark, sf_dir):
    path = _place(spark, "queries")
    _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text").write.json(path)
    rows = ts.read_queries(spark, path)
    return rows.select(F.col("id").alias("item_id"), F.sha2(tx.query_text(F.col("text")).cast("binary"), 256).alias("text_hash"))


def corpus_file(spark, sf_dir):
    path = _place(spark, "corpus")
    rows = _documents(spark, sf_dir)
    rows.select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).write.json(path)
    got = ts.read_corpus(spark, path)
    return got.select(F.col("id").alias("doc_id"), "title", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def qrel_file(spark, sf_dir):
    path = _place(spark, "qrels")
    rows = _table(spark, sf_dir, "labels")
    rows.select((F.col("doc_id") % 7).cast("string").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.col("quality").alias("score")).write.csv(path, sep="\t", header=True)
    return ts.read_qrels(spark, path).select("query_id", "corpus_id", "score")


def observation_file(spark, sf_dir):
    """Search observations, written as CSV, read back strictly and validated
    again; some rows are broken on purpose and must be found."""
    found = vectors._truth(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    n = _table(spark, sf_dir, "embeddings").count()
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    broken = F.col("query_id") % 500
    rows = found.select(
        F.col("query_id").alias("query_index"),
        F.when(broken == 100, 0.55).otherwise(F.lit(0.9)).alias("recall"),
        F.when(broken == 200, F.lit(-1.0)).otherwise(F.col("query_id") + 1.5).alias("latency_ms"),
        F.when(broken == 300, F.lit(3)).otherwise(F.lit(64)).cast("long").alias("exact_recomputations"),
        F.when(broken == 400, F.concat(ids, F.lit(" 07"))).otherwise(F.when(broken == 0, F.concat_ws(" ", F.lit(n), ids)).otherwise(ids)).alias("result_ids"),
    )
    path = _place(spark, "observations")
    ts.observations_csv(rows, path)
    kinds = "query_index long, recall double, latency_ms double, exact_recomputations long, result_ids string"
    return ts.revalidated(ts.read_observations(spark, path, kinds), 10, n)


def json_rows(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    return rows.select("doc_id", F.sha2(ts.as_json(F.col("doc_id"), F.col("lang"), F.col("n_chars")).cast("binary"), 256).alias("json_hash"))


def staged_corpus(spark, sf_dir):
    """Totals of the corpus view whose constraints are checked as it is read."""
    rows = _documents(spark, sf_dir).filter("text <> ''").select(F.col("doc_id").alias("id"), "text", F.octet_length("text").alias("n_bytes"))
    out = ts.staged(rows, "staged_corpus")
    return out.agg(F.count("text").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"), F.max("id").alias("last"))


def tier_files(spark, sf_dir):
    """Manifests of written tiers, taken from what stands on disk."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    out = None
    for lang in ("de", "en"):
        one = ts.write_tier(rows.filter(F.col("lang") == lang), _place(spark, "tier"), 3).select(F.lit(lang).alias("tier"), "lines", "bytes", "digest")
        out = one if out is None else out.union(one)
    return out


def key_value_scan(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    lines = events.select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 3 == 0, "no pair").otherwise(F.concat(F.lit(" k"), (F.col("event_id") % 10).cast("string"), F.lit(" = v="), F.col("event_type"))).alias("text"))
    return ts.key_values(lines).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def sweep_union(spark, sf_dir):
    """Rows of two sweeps with different columns."""
    e = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    a = e.select("event_type", F.lit(16).alias("ef_search"), "n")
    b = e.select("event_type", F.lit(0.5).cast("double").alias("rerank_ratio"), "n")
    return ts.union_of_keys([a, b])


def report_generations(spark, sf_dir):
    """A report written twice stands once: its content names its folder."""
    rows = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    path = _place(spark, "report")
    first, second = publish.report(rows, path, ["event_type", "n"]), publish.report(rows.repartition(3), path, ["event_type", "n"])
    if first != second:
        raise ValueError("equal rows made two generations")
    head = spark.read.text(f"{first}/md").withColumnRenamed("value", "line")
    return head.withColumn("generations", F.lit(len(publish.listed(spark, path))))


def identifiers(spark, sf_dir):
    """Which texts can be ids of a TSV row."""
    rows = _documents(spark, sf_dir)
    return rows.select("doc_id", tx.identifier(F.col("text")).isNotNull().alias("fits"), tx.identifier(F.concat(F.col("lang"), F.lit("-x"))).alias("made"))


def strict_values(spark, sf_dir):
    """Unsigned, boolean, time and id-list texts, well and badly formed."""
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    k = F.col("event_id") % 5
    number = F.when(k == 0, n).when(k == 1, F.concat(F.lit("-"), n)).when(k == 2, F.concat(n, F.lit(".0"))).when(k == 3, F.lit("99999999999999999999")).otherwise("")
    flag = F.when(k == 0, "true").when(k == 1, "0").when(k == 2, "TRUE").when(k == 3, "1").otherwise("yes")
    ids = F.when(k == 0, F.concat(n, F.lit(" 0 7"))).when(k == 1, F.concat(F.lit("0"), n)).when(k == 2, F.concat(n, F.lit("  1"))).when(k == 3, n).otherwise("")
    return e.select(
        "event_id", tx.parse_unsigned(number).alias("number"), ts.parse_bool(flag).alias("flag"), tx.is_id_list(ids).alias("is_list"),
        F.size(F.when(tx.is_id_list(ids), tx.id_list(ids)).otherwise(F.array())).cast("long").alias("n_ids"),
    )


def times_out_of_order(spark, sf_dir):
    """Pairs of ISO times, some reversed and some no times at all."""
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = F.when(k == 1, stamp(F.col("ts") - F.expr("interval 2 hours"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(stamp(F.col("ts") + F.expr("interval 1 hour")))
    rows = e.select("event_id", stamp(F.col("ts")).alias("a"), later.alias("b"))
    return ts.out_of_order(rows, "a", "b").select("event_id")


def matrix_faults(spark, sf_dir):
    """Vectors that are no rows of a valid matrix; some are broken on purpose."""
    from vesperine.functions import vector as vf

    rows = vectors.vectors(spark, sf_dir)
    k = F.col("id") % 50
    bad = F.when(k == 7, F.slice("v", 1, 63)).when(k == 8, F.transform("v", lambda x: (x * 3).cast("float"))).when(k == 9, F.transform("v", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("v"))
    rows = rows.select("id", bad.alias("v"))
    valid = vf.is_valid(F.col("v"), vectors.D)
    return rows.select(F.col("id").alias("vec_id"), valid.alias("is_valid"), (valid & F.coalesce(vf.is_unit(F.col("v")), F.lit(False))).alias("is_unit"))


def packed_codes(spark, sf_dir):
    """Codes as stored: their bytes, and what unpacking gives back."""
    codes = quantize.encode(vectors.vectors(spark, sf_dir), vectors._book(spark, sf_dir))
    stored = quantize.packed(codes, vectors.BITS)
    again = quantize.unpacked(stored, vectors.PARTS, vectors.BITS)
    both = codes.join(stored, "id").join(again.withColumnRenamed("codes", "again"), "id")
    return both.select(F.col("id").alias("vec_id"), F.octet_length("code").cast("long").alias("n_bytes"), (F.col("codes") == F.col("again")).alias("same"))


def _index(spark, sf_dir, **config):
    rows = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))  # as its SQL has it
    path = _place(spark, "index")
    build = search.BuildConfig(pq_parts=32, pq_samples=1024, **config)
    return api.VectorIndex.build(rows, path, api.hash_embedder(texts.DIMENSION), build, with_graph=False)


def _asked(spark, sf_dir):
    return _documents(spark, sf_dir).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def _all_searched(spark, sf_dir, **config):
    """Every document is on the shortlist, so the answer is exact."""
    index = _index(spark, sf_dir, **config)
    n = index.size()
    return index.search(_asked(spark, sf_dir), None, search.SearchConfig(top_k=5, ef_search=max(5, n), scan_limit=max(1, n), rerank_ratio=1.0))


def index_search(spark, sf_dir):
    """Build, publish, load, search by text, embed the shortlist again. Ranks
    of near copies may differ by the last digit of a distance: none is shown."""
    found, _ = _all_searched(spark, sf_dir)
    return found.select("query_id", "doc_id", (F.round(F.col("distance").cast("double"), 5) + 0.0).alias("distance"))


def simhash_index_search(spark, sf_dir):
    found, _ = _all_searched(spark, sf_dir, approx="simhash", sketch_bits=192)
    return found.select("query_id", "doc_id", (F.round(F.col("distance").cast("double"), 5) + 0.0).alias("distance"))


def index_metrics(spark, sf_dir):
    """Budgets that a search reports for each query."""
    index = _index(spark, sf_dir)
    _, metrics = index.search(_asked(spark, sf_dir), None, search.SearchConfig(top_k=3, ef_search=24, rerank_ratio=0.5))
    return metrics.select("query_id", "approximate_distances", "expanded_nodes", "exact_recomputations", "embedding_batches", "upper_layer_hops")


def index_stats(spark, sf_dir):
    """Counts of a published index; its bytes are those of files."""
    stats = _index(spark, sf_dir).stats()
    return stats.select("documents", "raw_bytes", "edges", "code_bytes", "dense_bytes_omitted", (F.col("index_bytes") > F.col("code_bytes")).alias("on_disk"))


def index_damage(spark, sf_dir):
    """Which kinds of damage loading finds: a changed value, a lost row, a
    repeated row, a wrong manifest; and none in what is whole."""
    rows = _documents(spark, sf_dir).select("doc_id", "text")
    path = _place(spark, "damaged")
    publish.publish(spark, path, {"t": rows}, {"n": 1})
    version = publish.manifest(spark, path)["version"]
    stored = storage.write_shared(rows, "whole")
    first = stored.agg(F.min("doc_id")).first()[0]
    kinds = {
        "whole": stored,
        "changed": stored.withColumn("text", F.when(F.col("doc_id") == first, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))),
        "lost": stored.filter(F.col("doc_id") != first),
        "repeated": stored.union(stored.filter(F.col("doc_id") == first)),
    }
    out = []
    for kind, table in kinds.items():
        table.write.mode("overwrite").parquet(f"{path}/versions/{version}/t")
        try:
            publish.load(spark, path)
            out.append((kind, False))
        except publish.InvalidIndex:
            out.append((kind, True))
    return spark.createDataFrame(out, "kind string, found boolean")


def publication_state(spark, sf_dir):
    """What a builder and the doctor see: a held lock, an unfinished version, a
    second publication, an output that stands in its input."""
    rows = _table(spark, sf_dir, "region")
    path = _place(spark, "state")
    publish.publish(spark, path, {"t": rows}, {"n": 1})
    out = []
    with publish.lock(spark, path):
        try:
            publish.publish(spark, path, {"t": rows}, {"n": 2})
        except publish.IndexBusy:
            out.append(("second builder", "busy"))
        out.append(("lock", publish.doctor(spark, path)["lock"]))
    rows.write.parquet(f"{path}/versions/stray/t")
    out.append(("orphans", str(len(publish.doctor(spark, path)["orphans"]))))
    publish.doctor(spark, path, repair=True)
    out.append(("orphans after repair", str(len(publish.doctor(spark, path)["orphans"]))))
    publish.publish(spark, path, {"t": rows.union(rows)}, {"n": 3})
    meta, tables = publish.load(spark, path)
    out += [("meta", str(meta["n"])), ("rows", str(tables["t"].count()))]
    out.append(("alias", str(publish.aliased(spark, [f"{path}/versions"], path) is not None)))
    out.append(("no alias", str(publish.aliased(spark, [f"{path}/versions"], path + "-other") is not None)))
    return spark.createDataFrame(out, "what string, state string")


def document_origins(spark, sf_dir):
    """A sample of prepared texts, checked against the raw corpus by id; some
    are altered, and one has no origin."""
    prepared = texts._prepared(spark, sf_dir).select("id", "text_hash")
    sample = prepared.withColumn("text_hash", F.when(F.col("id") % 40 == 1, F.lit("x")).otherwise(F.col("text_hash"))).union(spark.createDataFrame([(-1, "y")], "id long, text_hash string"))
    return corpus.origin_faults(sample, prepared).withColumnRenamed("id", "doc_id")


def prefix_identity(spark, sf_dir):
    """Rows of a smaller tier that the larger one does not begin with."""
    large = texts._prepared(spark, sf_dir).select("id", "text_hash")
    small = large.filter("id % 2 = 0").withColumn("text_hash", F.when(F.col("id") % 50 == 2, F.lit("x")).otherwise(F.col("text_hash")))
    return corpus.prefix_faults(small, large).withColumnRenamed("id", "doc_id")


def parity_fixture(spark, sf_dir):
    """All queries and a sample of documents, each with its source row."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("source_index"), "text")
    sample = corpus.sample_categories(docs.select(F.col("source_index").alias("idx"), F.octet_length("text").alias("n_bytes")), 20, 10, [3, 5])
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_index"), "text")
    out = corpus.parity_fixture(queries, docs, sample.withColumnRenamed("idx", "source_index"))
    return out.select("kind", "source_index", "utf8_bytes", F.array_join("categories", ",").alias("categories"))


def query_subset(spark, sf_dir):
    """Evenly spaced queries of a file, by row."""
    items = _table(spark, sf_dir, "benchmark")
    n = items.count()
    return corpus.evenly_spaced(spark, n, 15).select(F.col("idx").alias("row"))


QUERIES = (
    line_scan, source_identity, embedding_cache, cache_to_embed, binary_cache, embedding_lookup, ground_truth_file, document_store, query_file,
    corpus_file, qrel_file, observation_file, json_rows, staged_corpus, tier_files, key_value_scan, sweep_union, report_generations, identifiers,
    strict_values, times_out_of_order, matrix_faults, packed_codes, index_search, simhash_index_search, index_metrics, index_stats, index_damage,
    publication_state, document_origins, prefix_identity, parity_fixture, query_subset,
)

_WEIGHED = "round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * i)), 2)"


def oracles() -> dict[str, str]:
    search_sql = texts.oracles()["text_search_topk"]
    prepared = texts._PREPARED
    state = "SELECT * FROM (VALUES {}) t(what, state)"
    digest = "('0x' || substr(sha256(l), 1, 15))::BIGINT::HUGEINT"
    return {
        "line_scan": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents),
c AS (SELECT doc_id, k, regexp_replace(l, '\r$', '') AS l FROM l)
SELECT row_number() OVER (ORDER BY c.doc_id, k) - 1 AS doc_id, sha256(l) AS line_hash FROM c WHERE l <> ''""",
        "source_identity": "WITH f AS (SELECT string_agg(text || chr(10), '' ORDER BY item_id) AS t FROM benchmark) SELECT CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS sha256 FROM f",
        "embedding_cache": f"SELECT vec_id, CAST(len(embedding) AS INT) AS n, {_WEIGHED} AS weighed FROM embeddings",
        "cache_to_embed": "SELECT vec_id FROM embeddings WHERE label >= 5",
        "binary_cache": f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, CAST(len(embedding) AS INT) AS n, {_WEIGHED} AS weighed FROM embeddings",
        "embedding_lookup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS least_id FROM documents WHERE text IS NOT NULL",
        "ground_truth_file": f"WITH {vectors._TRUTH} SELECT query_id, CAST(rank AS INT) AS rank, id AS doc_id FROM truth WHERE rank <= 5",
        "document_store": "SELECT doc_id + k AS ord, doc_id, sha256(text) AS sha256 FROM documents, (VALUES (0), (1)) v(k) WHERE doc_id % 10 = 3",
        "query_file": f"SELECT CAST(item_id AS VARCHAR) AS item_id, sha256('{tx.QUERY_PREFIX}' || {texts._clean('text')}) AS text_hash FROM benchmark",
        "corpus_file": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS title, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "qrel_file": "SELECT CAST(doc_id % 7 AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS corpus_id, CAST(quality AS DOUBLE) AS score FROM labels",
        "observation_file": """SELECT vec_id AS query_index, CASE vec_id % 500 WHEN 0 THEN 'results' WHEN 100 THEN 'recall' WHEN 200 THEN 'latency' WHEN 300 THEN 'recomputations' ELSE 'ids' END AS fault
FROM embeddings WHERE vec_id % 100 = 0""",
        "json_rows": """SELECT doc_id, sha256('{"doc_id":' || doc_id || coalesce(',"lang":"' || lang || '"', '') || coalesce(',"n_chars":' || n_chars, '') || '}') AS json_hash FROM documents""",
        "staged_corpus": "SELECT count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, max(doc_id) AS last FROM documents WHERE text <> ''",
        "tier_files": f"""WITH l AS (SELECT lang AS tier, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') AS l FROM documents WHERE lang IN ('de', 'en'))
SELECT tier, count(*) AS lines, CAST(sum(octet_length(encode(l)) + 1) AS BIGINT) AS bytes, CAST(sum({digest}) AS VARCHAR) AS digest FROM l GROUP BY tier""",
        "key_value_scan": "SELECT 'k' || (event_id % 10) AS key, 'v=' || event_type AS value, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL",
        "sweep_union": "WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, 16 AS ef_search, n, NULL::DOUBLE AS rerank_ratio FROM e UNION ALL SELECT event_type, NULL, n, 0.5 FROM e",
        "report_generations": "SELECT '| ' || event_type || ' | ' || count(*) || ' |' AS line, 1 AS generations FROM events GROUP BY event_type UNION ALL VALUES ('| event_type | n |', 1), ('| --- | --- |', 1)",
        "identifiers": r"SELECT doc_id, coalesce(text <> '' AND NOT regexp_matches(text, '[\t\n\r]'), false) AS fits, lang || '-x' AS made FROM documents",
        "strict_values": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id END AS number, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS flag,
event_id % 5 IN (0, 3) AS is_list, CAST(CASE event_id % 5 WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS n_ids FROM events""",
        "times_out_of_order": "SELECT event_id FROM events WHERE event_id % 4 IN (1, 2)",
        "matrix_faults": "SELECT vec_id, vec_id % 50 NOT IN (7, 9) AS is_valid, vec_id % 50 NOT IN (7, 8, 9) AS is_unit FROM embeddings",
        "packed_codes": f"SELECT vec_id, CAST({vectors.PARTS * vectors.BITS // 8} AS BIGINT) AS n_bytes, true AS same FROM embeddings",
        "index_search": f"SELECT query_id, doc_id, distance FROM ({search_sql})",
        "simhash_index_search": f"SELECT query_id, doc_id, distance FROM ({search_sql})",
        "index_metrics": "SELECT doc_id AS query_id, (SELECT count(*) FROM documents) AS approximate_distances, (SELECT count(*) FROM documents) AS expanded_nodes, 24::BIGINT AS exact_recomputations, 2::BIGINT AS embedding_batches, 0::BIGINT AS upper_layer_hops FROM documents WHERE doc_id % 100 = 0",
        "index_stats": f"SELECT count(*) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS raw_bytes, 0::BIGINT AS edges, count(*) * 16 AS code_bytes, count(*) * {4 * texts.DIMENSION} AS dense_bytes_omitted, true AS on_disk FROM documents",
        "index_damage": "SELECT * FROM (VALUES ('whole', false), ('changed', true), ('lost', true), ('repeated', true)) t(kind, found)",
        "publication_state": state.format(
            "('second builder', 'busy'), ('lock', 'running'), ('orphans', '1'), ('orphans after repair', '0'), ('meta', '3'), ('rows', CAST((SELECT 2 * count(*) FROM region) AS VARCHAR)), ('alias', 'True'), ('no alias', 'False')"
        ),
        "document_origins": f"WITH {prepared} SELECT id AS doc_id, 'differs' AS fault FROM prepared WHERE id % 40 = 1 UNION ALL SELECT -1, 'no origin'",
        "prefix_identity": f"WITH {prepared} SELECT id AS doc_id FROM prepared WHERE id % 50 = 2",
        "parity_fixture": f"""WITH {'s AS (' + texts.oracles()['sample_categories'] + ')'}
SELECT 'document' AS kind, idx AS source_index, CAST(octet_length(encode(text)) AS BIGINT) AS utf8_bytes, categories FROM s JOIN documents ON doc_id = idx
UNION ALL SELECT 'query', item_id, octet_length(encode(text)), 'query' FROM benchmark""",
        "query_subset": "WITH n AS (SELECT count(*) AS n FROM benchmark) SELECT i * (n - 1) // 14 AS row FROM n, range(15) r(i)",
    }
