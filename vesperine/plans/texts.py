"""Registered queries over ``documents``, ``labels``, ``pages`` and ``events``
for text functions and corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vesperine.functions import hashing
from vesperine.functions import text as tx
from vesperine.operators import corpus, neighbours
from vesperine.sources import text as ts

DIMENSION = 256
MOST_BYTES = 2048
SEED = "synthetic-seed:"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenize_counts(spark, sf_dir):
    words = tx.tokenize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct")
    )


def bigram_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.bigrams(tx.tokenize(F.col("text"))).alias("b")).select(
        "doc_id", F.size("b").cast("long").alias("n_bigrams"), F.size(F.array_distinct("b")).cast("long").alias("n_distinct")
    )


def hash_embed_sparse(spark, sf_dir):
    return hashing.features(_docs(spark, sf_dir), dimension=DIMENSION)


def fnv1a_features(spark, sf_dir):
    cells = hashing.features(_docs(spark, sf_dir), dimension=DIMENSION)
    return cells.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("weight").alias("total"), F.sum(F.col("weight") * (F.col("pos") + 1)).alias("weighed")
    )


def _embedded(spark, sf_dir):
    return hashing.embed(_docs(spark, sf_dir), dimension=DIMENSION).select(F.col("doc_id").alias("id"), F.col("embedding").alias("v"))


def text_search_topk(spark, sf_dir):
    rows = _embedded(spark, sf_dir)
    asked = hashing.embed(_docs(spark, sf_dir).filter("doc_id % 100 = 0"), dimension=DIMENSION)
    found = neighbours.top_k(rows, asked.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("v")), 5)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), (F.round(F.col("distance").cast("double"), 5) + 0.0).alias("distance"))


def _prepared(spark, sf_dir):
    return corpus.prepared(_docs(spark, sf_dir), "doc_id", F.col("source"), F.col("text"), MOST_BYTES, SEED)


def prepared_documents(spark, sf_dir):
    return _prepared(spark, sf_dir).select(F.col("id").alias("doc_id"), "raw_bytes", "original_bytes", "truncated", "text_hash")


def prepared_bytes(spark, sf_dir):
    return _prepared(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("raw_bytes").alias("raw_bytes"), F.sum(F.octet_length("prepared").cast("long")).alias("prepared_bytes"),
        F.max(F.octet_length("prepared")).cast("long").alias("largest"), F.count_if("truncated").alias("n_truncated"),
    )


def prepared_queries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    text = tx.query_text(F.col("text"))
    return rows.select("item_id", F.sha2(text.cast("binary"), 256).alias("text_hash"), F.octet_length(text).cast("long").alias("n_bytes"))


def cleaned_lines(spark, sf_dir):
    line = tx.clean_line(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(line).cast("long").alias("n_chars"), F.sha2(line.cast("binary"), 256).alias("line_hash"))


def rank_hash_sample(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", tx.rank_hash(SEED, F.col("doc_id")).alias("rank_hash"))
    return corpus.first_ranked(rows, 100, "rank_hash", "doc_id")


def duplicate_text_groups(spark, sf_dir):
    return corpus.duplicate_groups(_prepared(spark, sf_dir), "text_hash")


def duplicate_stats(spark, sf_dir):
    return corpus.duplicate_stats(_prepared(spark, sf_dir), "text_hash").withColumn("duplicate_rate", F.round("duplicate_rate", 9))


def _rows(spark, sf_dir):
    good = corpus.positives(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic").select(F.col("doc_id").alias("id"), F.lit(True).alias("p"))
    return _prepared(spark, sf_dir).join(good, "id", "left").withColumn("positive", F.coalesce("p", F.lit(False)))


def _tiers(spark, sf_dir):
    n = _docs(spark, sf_dir).count()
    return corpus.tiers(_rows(spark, sf_dir), n // 10, n // 2)


def tier_selection(spark, sf_dir):
    return _tiers(spark, sf_dir).select(F.col("id").alias("doc_id"), "tier", "forced")


def tier_stats(spark, sf_dir):
    return corpus.tier_stats(_tiers(spark, sf_dir), _prepared(spark, sf_dir))


def tier_nesting_violations(spark, sf_dir):
    """Ids of the small tier that a large one made of fewer rows lacks."""
    n = _docs(spark, sf_dir).count()
    rows = _rows(spark, sf_dir)
    return corpus.not_nested(corpus.tiers(rows, n // 10, n // 10), corpus.tiers(rows.filter("id % 9 <> 4"), n // 10, n // 2))


def qrel_semi_join(spark, sf_dir):
    qrels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chosen = _tiers(spark, sf_dir).select(F.col("id").alias("doc_id"))
    return corpus.positives(qrels, "quality").join(chosen, "doc_id", "left_semi").select("doc_id", "quality")


def qrel_coverage(spark, sf_dir):
    qrels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tiers = _tiers(spark, sf_dir).select(F.col("id").alias("doc_id"), "tier")
    return qrels.join(tiers, "doc_id", "left").groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == 0).alias("small"), F.count("tier").alias("large")
    )


def sample_categories(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), F.octet_length("text").alias("n_bytes"))
    return corpus.sample_categories(rows, 20, 10, [3, 5]).select("idx", F.array_join("categories", ",").alias("categories"))


def content_hashes(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("n_bytes"))


def crc32c_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", hashing.crc32c(F.col("text")).alias("crc32c"))


def utf8_validity(spark, sf_dir):
    """Whether a text is whole when cut at some byte."""
    raw = F.col("text").cast("binary")
    cut = F.expr("substring(cast(text as binary), 1, cast(doc_id % 97 + 1 as int))").cast("string")
    return _docs(spark, sf_dir).select(
        "doc_id", F.is_valid_utf8(cut).alias("whole"), F.is_valid_utf8(F.concat(raw, F.unhex(F.lit("C0AF"))).cast("string")).alias("overlong")
    )


def strict_number_parse(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    typed = (
        F.when(F.col("event_id") % 6 == 0, F.concat(cents, F.lit("e-2"))).when(F.col("event_id") % 6 == 1, F.concat(F.lit("+"), cents, F.lit(".5")))
        .when(F.col("event_id") % 6 == 2, F.lit("1e400")).when(F.col("event_id") % 6 == 3, F.lit("1e-400"))
        .when(F.col("event_id") % 6 == 4, F.concat(F.lit("0x"), cents)).otherwise(F.lit("-0.0"))
    )
    return events.select("event_id", typed.alias("typed")).select("event_id", "typed", (tx.parse_decimal(F.col("typed")) + 0.0).alias("parsed"))


def edit_distance_suggest(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name")).distinct()
    typed = names.select(F.substring("name", 2, 100).alias("typed"))
    pairs = typed.join(F.broadcast(names), tx.edit_distance(F.col("typed"), F.col("name"), 2) < 3)  # two vocabularies of option names
    d = tx.edit_distance(F.col("typed"), F.col("name"), 2)
    return pairs.groupBy("typed").agg(F.min_by("name", F.struct(d, F.col("name"))).alias("suggestion"), F.min(d).alias("distance"))


def url_normalize(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    suffix = F.when(F.col("page_id") % 3 == 0, "/v1//").when(F.col("page_id") % 3 == 1, "//").otherwise("")
    return pages.select("page_id", tx.normalize_url(F.concat("url", suffix)).alias("url"))


def dense_document_ids(spark, sf_dir):
    return ts.dense_ids(_docs(spark, sf_dir).select("doc_id"), "doc_id", 128)


QUERIES = (
    tokenize_counts, bigram_counts, hash_embed_sparse, fnv1a_features, text_search_topk, prepared_documents, prepared_bytes, prepared_queries,
    cleaned_lines, rank_hash_sample, duplicate_text_groups, duplicate_stats, tier_selection, tier_stats, tier_nesting_violations,
    qrel_semi_join, qrel_coverage, sample_categories, content_hashes, crc32c_documents, utf8_validity, strict_number_parse,
    edit_distance_suggest, url_normalize, dense_document_ids,
)

_LOWER = f"translate(coalesce(text, ''), '{tx.UPPER}', '{tx.LOWER}')"
_WORDS = f"regexp_extract_all({_LOWER}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_FEATURES = f"""
t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS (
  SELECT doc_id, unnest(w) AS s, 5 AS k FROM t UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1])), 3 FROM t WHERE len(w) > 1),
g AS (SELECT doc_id, s, sum(k) AS k FROM f GROUP BY doc_id, s),
u AS (SELECT DISTINCT s FROM (SELECT s FROM g UNION ALL SELECT '<empty>')),
h AS (
  SELECT s, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, octet_length(encode(s))),
    lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::INT::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM u),
c AS (SELECT s, CAST(h % {DIMENSION} AS BIGINT) AS pos, CASE WHEN (h // 4294967296) % 2 = 1 THEN -1 ELSE 1 END AS sign FROM h),
n AS (SELECT doc_id, pos, CAST(sum(k * sign) AS BIGINT) AS weight FROM g JOIN c USING (s) GROUP BY doc_id, pos HAVING sum(k * sign) <> 0),
sparse AS (
  SELECT * FROM n UNION ALL
  SELECT doc_id, pos, 5 * sign FROM documents, c WHERE c.s = '<empty>' AND doc_id NOT IN (SELECT doc_id FROM n))"""
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean(column: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({column}, ''), chr(0), ' '), '{_SPACES}+', ' ', 'g'))"


_PREPARED = f"""
c AS (SELECT doc_id AS id, concat_ws('. ', nullif({_clean('source')}, ''), nullif({_clean('text')}, '')) AS content FROM documents),
o AS (SELECT id, content, '{tx.DOCUMENT_PREFIX}' || content AS original FROM c WHERE content <> ''),
p AS (
  SELECT id, octet_length(encode(content)) AS raw_bytes, octet_length(encode(original)) AS original_bytes,
    octet_length(encode(original)) > {MOST_BYTES} AS truncated,
    CASE WHEN octet_length(encode(original)) <= {MOST_BYTES} THEN original ELSE regexp_replace(coalesce(
      {", ".join(f"TRY(decode(encode(original)[1:{MOST_BYTES - k}]))" for k in range(4))}), '{_SPACES}+$', '') END AS prepared FROM o),
prepared AS (SELECT *, sha256(prepared) AS text_hash, sha256('{SEED}' || id) AS rank_hash FROM p)"""
_TIERS = f"""{_PREPARED},
r AS (SELECT p.*, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS forced FROM prepared p LEFT JOIN (SELECT doc_id FROM labels WHERE toxic > 0) l ON l.doc_id = id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY forced DESC, rank_hash, id) = 1),
k AS (SELECT *, row_number() OVER (ORDER BY forced DESC, rank_hash, id) AS place FROM b),
tiers AS (SELECT id, CASE WHEN place <= (SELECT count(*) // 10 FROM documents) THEN 0 ELSE 1 END AS tier, forced FROM k WHERE place <= (SELECT count(*) // 2 FROM documents))"""


def oracles() -> dict[str, str]:
    return {
        "tokenize_counts": f"SELECT doc_id, len({_WORDS}) AS n_tokens, len(list_distinct({_WORDS})) AS n_distinct FROM documents",
        "bigram_counts": f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1]) AS b FROM t) SELECT doc_id, len(b) AS n_bigrams, len(list_distinct(b)) AS n_distinct FROM b",
        "hash_embed_sparse": f"WITH {_FEATURES} SELECT doc_id, pos, weight FROM sparse",
        "fnv1a_features": f"WITH {_FEATURES} SELECT doc_id, count(*) AS cells, CAST(sum(weight) AS BIGINT) AS total, CAST(sum(weight * (pos + 1)) AS BIGINT) AS weighed FROM sparse GROUP BY doc_id",
        "text_search_topk": f"""WITH {_FEATURES},
e AS (SELECT doc_id, pos, CAST(CAST(CAST(weight AS DOUBLE) / sqrt(CAST(sum(weight * weight) OVER (PARTITION BY doc_id) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS x FROM sparse),
d AS (SELECT q.doc_id AS query_id, e.doc_id, CAST(1.0 - list_sum(list(q.x * e.x ORDER BY pos)) AS FLOAT) AS distance FROM e q JOIN e USING (pos) WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, e.doc_id),
z AS (SELECT q.doc_id AS query_id, a.doc_id, coalesce(distance, 1.0::FLOAT) AS distance FROM documents q CROSS JOIN documents a LEFT JOIN d ON d.query_id = q.doc_id AND d.doc_id = a.doc_id WHERE q.doc_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM z)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(CAST(distance AS DOUBLE), 5) + 0.0::DOUBLE AS distance FROM k WHERE rank <= 5""",
        "prepared_documents": f"WITH {_PREPARED} SELECT id AS doc_id, raw_bytes, original_bytes, truncated, text_hash FROM prepared",
        "prepared_bytes": f"WITH {_PREPARED} SELECT count(*) AS documents, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(octet_length(encode(prepared))) AS BIGINT) AS prepared_bytes, max(octet_length(encode(prepared))) AS largest, count(*) FILTER (truncated) AS n_truncated FROM prepared",
        "prepared_queries": f"SELECT item_id, sha256('{tx.QUERY_PREFIX}' || {_clean('text')}) AS text_hash, octet_length(encode('{tx.QUERY_PREFIX}' || {_clean('text')})) AS n_bytes FROM benchmark",
        "cleaned_lines": f"SELECT doc_id, length({_clean('text')}) AS n_chars, sha256({_clean('text')}) AS line_hash FROM documents",
        "rank_hash_sample": f"SELECT doc_id, sha256('{SEED}' || doc_id) AS rank_hash FROM documents ORDER BY 2, 1 LIMIT 100",
        "duplicate_text_groups": f"WITH {_PREPARED} SELECT text_hash, count(*) AS n, min(id) AS least_id FROM prepared GROUP BY text_hash HAVING count(*) > 1",
        "duplicate_stats": f"WITH {_PREPARED} SELECT count(*) AS rows, count(DISTINCT text_hash) AS unique_texts, count(*) - count(DISTINCT text_hash) AS duplicate_rows, round((count(*) - count(DISTINCT text_hash)) / count(*), 9) AS duplicate_rate FROM prepared",
        "tier_selection": f"WITH {_TIERS} SELECT id AS doc_id, tier, forced FROM tiers",
        "tier_stats": f"""WITH {_TIERS}, j AS (SELECT tier, p.* FROM tiers JOIN prepared p USING (id)), x AS (SELECT 'large' AS name, * FROM j UNION ALL SELECT 'small', * FROM j WHERE tier = 0)
SELECT name, count(*) AS documents, CAST(sum(octet_length(encode(prepared))) AS BIGINT) AS bytes, max(octet_length(encode(prepared))) AS largest, count(*) FILTER (truncated) AS n_truncated, count(DISTINCT text_hash) AS unique_texts FROM x GROUP BY name""",
        "tier_nesting_violations": f"""WITH {_TIERS},
f AS (SELECT * FROM r WHERE id % 9 <> 4 QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY forced DESC, rank_hash, id) = 1),
l AS (SELECT id FROM f QUALIFY row_number() OVER (ORDER BY forced DESC, rank_hash, id) <= (SELECT count(*) // 2 FROM documents))
SELECT id FROM tiers WHERE tier = 0 AND id NOT IN (SELECT id FROM l)""",
        "qrel_semi_join": f"WITH {_TIERS} SELECT doc_id, quality FROM labels WHERE quality > 0 AND doc_id IN (SELECT id FROM tiers)",
        "qrel_coverage": f"WITH {_TIERS} SELECT quality, count(*) AS n, count(*) FILTER (tier = 0) AS small, count(tier) AS large FROM labels LEFT JOIN tiers ON id = doc_id GROUP BY quality",
        "sample_categories": """WITH n AS (SELECT count(*) AS n FROM documents),
a AS (SELECT i * (n - 1) // 19 AS idx, 'evenly_spaced' AS c FROM n, range(20) r(i)
  UNION SELECT * FROM (SELECT doc_id, 'longest' FROM documents ORDER BY octet_length(encode(text)) DESC, doc_id LIMIT 10)
  UNION SELECT doc_id, 'explicit' FROM documents WHERE doc_id IN (3, 5))
SELECT idx, string_agg(c, ',' ORDER BY c) AS categories FROM a GROUP BY idx""",
        "content_hashes": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents",
        "crc32c_documents": f"""WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::UINTEGER, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {hashing.CRC32C_POLYNOMIAL}::UINTEGER) ELSE a >> 1 END)) AS t),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
    lambda a, x: xor(a >> 8, t[CAST(xor(a, x) % 256 AS INT) + 1]::UBIGINT)) AS c FROM b, t)
SELECT doc_id, CAST(xor(c, 4294967295::UBIGINT) AS BIGINT) AS crc32c FROM c""",
        "utf8_validity": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(strlen(TRY(decode(encode(text)[1:doc_id % 97 + 1]))) >= 0, false) END AS whole, CASE WHEN text IS NOT NULL THEN false END AS overlong FROM documents",
        "strict_number_parse": """WITH e AS (SELECT event_id, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS c FROM events),
t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN c || 'e-2' WHEN 1 THEN '+' || c || '.5' WHEN 2 THEN '1e400' WHEN 3 THEN '1e-400' WHEN 4 THEN '0x' || c ELSE '-0.0' END AS typed FROM e)
SELECT event_id, typed, CASE WHEN event_id % 6 IN (0, 1, 5) THEN CAST(ltrim(typed, '+') AS DOUBLE) + 0.0 END AS parsed FROM t""",
        "edit_distance_suggest": """WITH n AS (SELECT DISTINCT event_type AS name FROM events), t AS (SELECT substr(name, 2) AS typed FROM n)
SELECT typed, arg_min(name, (levenshtein(typed, name), name)) AS suggestion, CAST(min(levenshtein(typed, name)) AS INT) AS distance FROM t, n WHERE levenshtein(typed, name) < 3 GROUP BY typed""",
        "url_normalize": "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || CASE page_id % 3 WHEN 0 THEN '/v1//' WHEN 1 THEN '//' ELSE '' END, '/+$', ''), '/v1$', ''), '/+$', '') AS url FROM pages",
        "dense_document_ids": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS dense_id FROM documents",
    }
