"""Registered queries over ``embeddings``.

Searches ask with every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperine.functions import vector as vf
from vesperine.operators import evaluate, graph, neighbours, quantize, search, sketch
from vesperine.sources.storage import write_shared

D = 64
SKETCH_BITS, SHORTLIST = 512, 256
PARTS, BITS, PQ_ITERATIONS = 32, 4, 4
NPROBE = 12  # of 16 cells
DEGREE, LOW_DEGREE, HUB_RATIO = 8, 6, 0.02
CONFIG = search.SearchConfig(top_k=10, ef_search=128, rerank_ratio=0.25)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("id % 100 = 0").select(F.col("id").alias("query_id"), "v", "label")


def _rounded(distance):
    """Five digits; adding zero makes a negative zero positive."""
    return (F.round(distance.cast("double"), 5) + 0.0).alias("distance")


def vector_norms(spark, sf_dir):
    v = F.col("v")
    return vectors(spark, sf_dir).select(
        F.col("id").alias("vec_id"), F.round(vf.norm(v), 6).alias("norm"), vf.is_valid(v, D).alias("is_valid"), vf.is_unit(v).alias("is_unit")
    )


def vector_normalize(spark, sf_dir):
    unit = vectors(spark, sf_dir).select("id", vf.normalize(F.transform("v", lambda x: x * F.lit(3.0).cast("float"))).alias("u"))
    weighed = F.aggregate(F.transform("u", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return unit.select(F.col("id").alias("vec_id"), F.size("u").alias("n"), F.round(weighed, 4).alias("weighed"))


def _pairs(spark, sf_dir):
    """Each vector with the first of its label."""
    rows = vectors(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min("id").alias("anchor"))
    anchors = first.join(rows.select(F.col("id").alias("anchor"), F.col("v").alias("a")), "anchor").select("label", "anchor", "a")
    return rows.join(anchors, "label")


def cosine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("id").alias("vec_id"), "anchor", _rounded(vf.cosine_distance(F.col("v"), F.col("a"))))


def squared_l2_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("id").alias("vec_id"), "anchor", _rounded(vf.squared_distance(F.col("v"), F.col("a"))))


def _truth(spark, sf_dir, k=10):
    return neighbours.top_k(vectors(spark, sf_dir), asked(spark, sf_dir), k)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), _rounded(F.col("distance")))


def knn_exact_topk(spark, sf_dir):
    return _shown(_truth(spark, sf_dir))


def knn_label_agreement(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = _truth(spark, sf_dir).join(rows.select("id", F.col("label").alias("near")), "id").join(asked(spark, sf_dir).select("query_id", "label"), "query_id")
    return found.groupBy("query_id").agg(F.count_if(F.col("near") == F.col("label")).alias("agree"), F.count(F.lit(1)).alias("n"))


def ground_truth_long(spark, sf_dir):
    return _truth(spark, sf_dir).select("query_id", "rank", F.col("id").alias("doc_id"))


def ground_truth_rows(spark, sf_dir):
    from vesperine.sources.text import ground_truth_rows as rows

    return rows(_truth(spark, sf_dir))


def _sketches(spark, sf_dir):
    return sketch.sketches(vectors(spark, sf_dir), SKETCH_BITS, D)


def simhash_sketch(spark, sf_dir):
    return _sketches(spark, sf_dir).select(F.col("id").alias("vec_id"), sketch.bit_string(F.col("v"), SKETCH_BITS).alias("bits"))


def _hamming(spark, sf_dir, k):
    rows = _sketches(spark, sf_dir)
    return neighbours.top_k(rows, rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), k, sketch.hamming)


def simhash_hamming_topk(spark, sf_dir):
    return _shown(_hamming(spark, sf_dir, 10))


def simhash_recall(spark, sf_dir):
    """Recall@10 of an exact rerank of the nearest sketches."""
    found = search.rerank(_hamming(spark, sf_dir, SHORTLIST), vectors(spark, sf_dir), asked(spark, sf_dir), SHORTLIST, 10)
    out = evaluate.recall(found, _truth(spark, sf_dir), 10)
    return out.select("query_id", "found", F.round("recall", 6).alias("recall"))


def _book_of(spark, sf_dir, parts, bits, iterations):
    return quantize.train(vectors(spark, sf_dir), parts, bits, iterations)


def _book(spark, sf_dir):
    return _book_of(spark, sf_dir, PARTS, BITS, PQ_ITERATIONS)


def pq_codebook(spark, sf_dir):
    book = _book(spark, sf_dir)
    rows = [(m, k, j, float(x)) for m, part in enumerate(book.centroids) for k, c in enumerate(part) for j, x in enumerate(c)]
    df = spark.createDataFrame(rows, "part int, centroid int, coord int, x double")
    return df.select("part", "centroid", "coord", F.round("x", 4).alias("x"))


def pq_encode(spark, sf_dir):
    codes = quantize.encode(vectors(spark, sf_dir), _book(spark, sf_dir))
    return codes.select(F.col("id").alias("vec_id"), F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


def _adc(spark, sf_dir, k):
    book = _book(spark, sf_dir)
    return search.adc_top_k(quantize.encode(vectors(spark, sf_dir), book), asked(spark, sf_dir), book, k)


def pq_adc_topk(spark, sf_dir):
    return _adc(spark, sf_dir, 10).select("query_id", "rank", F.col("id").alias("vec_id"), F.round(F.col("distance").cast("double"), 4).alias("distance"))


def pq_rerank_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found, _ = search.flat_search(rows, asked(spark, sf_dir), _book(spark, sf_dir), CONFIG, rows.count())
    return _shown(found)


def pq_rerank_recall(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found, _ = search.flat_search(rows, asked(spark, sf_dir), _book(spark, sf_dir), CONFIG, rows.count())
    return evaluate.recall(found, _truth(spark, sf_dir), 10).select("query_id", "found", F.round("recall", 6).alias("recall"))


def pq_code_bytes(spark, sf_dir):
    per = -(-PARTS * BITS // 8)
    return vectors(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * per).alias("code_bytes"), F.sum(F.size("v") * F.lit(4).cast("long")).alias("dense_bytes"),
        F.round(F.count(F.lit(1)) * per * 100.0 / F.sum(F.size("v") * F.lit(4).cast("long")), 6).alias("percent"),
    )


def _edges(spark, sf_dir):
    return graph.knn_edges(vectors(spark, sf_dir), 2 * DEGREE)


def knn_graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst", _rounded(F.col("distance")))


def cell_graph_recall(spark, sf_dir):
    """How many of each vector's true edges the graph built in cells has."""
    rows = vectors(spark, sf_dir).select("id", "v")
    cells = graph.knn_edges_in_cells(rows, 2 * DEGREE, bits=4, nprobe=NPROBE, chunk=128)
    both = _edges(spark, sf_dir).select("src", "dst").join(cells.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return both.agg(F.count(F.lit(1)).alias("edges"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


def graph_hubs(spark, sf_dir):
    return graph.hubs(_edges(spark, sf_dir), vectors(spark, sf_dir), HUB_RATIO)


def _graph(spark, sf_dir):
    edges = write_shared(_edges(spark, sf_dir), "edges")
    return graph.prune(edges, graph.hubs(edges, vectors(spark, sf_dir), HUB_RATIO), DEGREE, LOW_DEGREE)


def graph_pruned(spark, sf_dir):
    return _graph(spark, sf_dir).select("src", "ord", "dst")


def graph_csr_offsets(spark, sf_dir):
    return graph.offsets(_graph(spark, sf_dir), vectors(spark, sf_dir))


def graph_degree_stats(spark, sf_dir):
    return _graph(spark, sf_dir).groupBy("src").count().groupBy(F.col("count").alias("degree")).agg(F.count(F.lit(1)).alias("nodes"))


def graph_khop(spark, sf_dir):
    start = asked(spark, sf_dir).select("query_id", F.col("query_id").alias("id"))
    return graph.hops(write_shared(_graph(spark, sf_dir), "graph"), start, 3).groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("nodes"))


def graph_levels(spark, sf_dir):
    return vectors(spark, sf_dir).select(graph.level(F.col("id"), 16).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


def graph_upper_layers(spark, sf_dir):
    return graph.layers(vectors(spark, sf_dir).select("id", "v"), DEGREE).select("level", "src", "ord", "dst")


def graph_routing(spark, sf_dir):
    """Where greedy descent of the upper layers ends, and its moves."""
    rows = vectors(spark, sf_dir).select("id", "v")
    upper = write_shared(graph.layers(rows, DEGREE), "layers")
    at = search.route(upper, rows, asked(spark, sf_dir).select("query_id", "v"), graph.entry_point(rows))
    return at.select("query_id", F.col("id").alias("vec_id"), "hops", _rounded(F.col("distance")))


def graph_entry_point(spark, sf_dir):
    return graph.entry_point(vectors(spark, sf_dir))


def _walked(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "v")
    queries = asked(spark, sf_dir).select("query_id", "v")
    base = write_shared(_graph(spark, sf_dir), "graph")
    upper = write_shared(graph.layers(rows, DEGREE), "layers")
    start = search.starts(search.route(upper, rows, queries, graph.entry_point(rows)), graph.seeds(rows), rows, queries)
    return search.beam_search(base, rows, queries, start, 192, 10)


def graph_beam_search(spark, sf_dir):
    return _shown(_walked(spark, sf_dir)[0])


def graph_beam_recall(spark, sf_dir):
    return evaluate.recall(_walked(spark, sf_dir)[0], _truth(spark, sf_dir), 10).select("query_id", "found", F.round("recall", 6).alias("recall"))


def search_budget_metrics(spark, sf_dir):
    n = vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    exact, beam = search.within(CONFIG, F.col("n"))
    return n.select("n", exact.alias("exact_budget"), beam.alias("beam"), F.ceil(exact / F.lit(CONFIG.recompute_batch_size)).cast("long").alias("batches"))


def _ivf(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.ivf_search(rows.select("id", "v"), asked(spark, sf_dir).select("query_id", "v"), _book_of(spark, sf_dir, 1, 4, 8), NPROBE, 10)


def ivf_topk(spark, sf_dir):
    return _shown(_ivf(spark, sf_dir))


def ivf_recall(spark, sf_dir):
    return evaluate.recall(_ivf(spark, sf_dir), _truth(spark, sf_dir), 10).select("query_id", "found", F.round("recall", 6).alias("recall"))


def result_invariants(spark, sf_dir):
    """Queries whose results are not ten distinct ids in range; some results
    are broken on purpose: repeated, out of range, or one too few."""
    n = vectors(spark, sf_dir).count()
    k = F.col("query_id") % 500
    broken = F.when(k == 100, F.col("id") % 2).when((k == 200) & (F.col("rank") == 1), F.lit(n)).otherwise(F.col("id"))
    found = _truth(spark, sf_dir).withColumn("id", broken.cast("long")).filter((k != 300) | (F.col("rank") < 10))
    return evaluate.result_faults(found, 10, n)


def recall_summary(spark, sf_dir):
    """Micro-averaged recall at 10 and at 1 of the sketch search."""
    found = write_shared(search.rerank(_hamming(spark, sf_dir, SHORTLIST), vectors(spark, sf_dir), asked(spark, sf_dir), SHORTLIST, 10), "found")
    truth = write_shared(_truth(spark, sf_dir), "truth")
    parts = [
        evaluate.recall(found, truth, k).agg(F.lit(k).alias("k"), F.sum("found").alias("found"), F.round(F.avg("recall"), 6).alias("recall")) for k in (1, 10)
    ]
    return parts[0].union(parts[1])


def embedding_parity(spark, sf_dir):
    from vesperine.operators import corpus

    rows = vectors(spark, sf_dir).select("id", F.when(F.col("label") < 5, "low").otherwise("high").alias("kind"), "v")
    rough = rows.withColumn("v", F.transform("v", lambda x: F.round(x, 2)))
    out = corpus.parity_report(corpus.parity(rows, rough))
    return out.select("kind", "n", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), F.round("max_abs", 6).alias("max_abs"), "worst_id")


QUERIES = (
    vector_norms, vector_normalize, cosine_pairs, squared_l2_pairs, knn_exact_topk, knn_label_agreement, ground_truth_long,
    ground_truth_rows, simhash_sketch, simhash_hamming_topk, simhash_recall, pq_codebook, pq_encode, pq_adc_topk, pq_rerank_topk,
    pq_rerank_recall, pq_code_bytes, knn_graph_edges, cell_graph_recall, graph_hubs, graph_pruned, graph_csr_offsets, graph_degree_stats, graph_khop,
    graph_levels, graph_upper_layers, graph_routing, graph_entry_point, graph_beam_search, graph_beam_recall, search_budget_metrics, ivf_topk, ivf_recall,
    result_invariants, recall_summary, embedding_parity,
)

_DIST = "CAST(1.0::DOUBLE - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS FLOAT)"
_TRUTH = f"""
truth AS (
  SELECT * FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, {_DIST} AS distance,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
  WHERE rank <= 10)"""
_SHOWN = "SELECT query_id, CAST(rank AS INT) AS rank, id AS vec_id, round(CAST(distance AS DOUBLE), 5) + 0.0::DOUBLE AS distance"


def _sketch_sql() -> str:
    table = sketch.projections(SKETCH_BITS, D)
    rows = ", ".join(f"({b}, {c + 1}, {s})" for b, row in enumerate(table) for c, s in row)
    return f"""
p(bit, coord, sign) AS (VALUES {rows}),
s AS (
  SELECT vec_id, bit, CASE WHEN sum(sign * CAST(embedding[coord] AS DOUBLE)) >= 0 THEN 1 ELSE 0 END AS one
  FROM embeddings, p GROUP BY vec_id, bit),
w AS (SELECT vec_id AS id, list(one ORDER BY bit) AS bits FROM s GROUP BY vec_id),
h AS (
  SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (
    SELECT q.id AS query_id, e.id, CAST(list_sum(list_transform(range(1, {SKETCH_BITS + 1}), lambda i: q.bits[i] <> e.bits[i])) / {SKETCH_BITS}.0 AS FLOAT) AS d
    FROM w q, w e WHERE q.id % 100 = 0)),
found AS (
  SELECT h.query_id, h.id, {_DIST} AS distance, row_number() OVER (PARTITION BY h.query_id ORDER BY {_DIST}, h.id) AS rank
  FROM h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings e ON e.vec_id = h.id WHERE h.rank <= {SHORTLIST})"""


def _recall_sql(k: int) -> str:
    return f"""SELECT t.query_id, count(f.id) AS found, round(count(f.id) / {k}.0, 6) AS recall
FROM (SELECT * FROM truth WHERE rank <= {k}) t LEFT JOIN (SELECT * FROM found WHERE rank <= {k}) f USING (query_id, id) GROUP BY t.query_id"""


def _pq_sql(parts: int, bits: int, iterations: int) -> str:
    """The training unrolled: the first 2^bits rows by hash seed the centroids;
    then assignments and means in turn."""
    k, d = 2**bits, D // parts
    ctes = [f"""
sm AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('pq-42:' || vec_id), vec_id) - 1 AS pos, embedding FROM embeddings
  QUALIFY row_number() OVER (ORDER BY sha256('pq-42:' || vec_id), vec_id) <= 4096),
x AS (SELECT vec_id, pos, m AS part, CAST(embedding[m * {d} + 1 : m * {d} + {d}] AS DOUBLE[]) AS v FROM sm, range({parts}) r(m)),
c0 AS (SELECT part, CAST(pos AS INT) AS centroid, CAST(v AS FLOAT[]) AS c FROM x WHERE pos < {k})"""]  # fmt: skip
    for i in range(1, iterations + 1):
        ctes.append(f"""
a{i} AS MATERIALIZED (
  SELECT x.vec_id, x.part, arg_min(c.centroid, (CAST(list_distance(x.v, CAST(c.c AS DOUBLE[])) ** 2 AS FLOAT), c.centroid)) AS centroid
  FROM x JOIN c{i - 1} c USING (part) GROUP BY x.vec_id, x.part),
c{i} AS MATERIALIZED (
  SELECT part, centroid, list(CAST(s AS FLOAT) ORDER BY j) AS c FROM (
    SELECT part, centroid, j, avg(v[j]) AS s FROM a{i} JOIN x USING (vec_id, part), range(1, {d + 1}) r(j) GROUP BY part, centroid, j)
  GROUP BY part, centroid)""")
    ctes.append(f"""
book AS (SELECT * FROM c{iterations}),
y AS (SELECT vec_id, m AS part, CAST(embedding[m * {d} + 1 : m * {d} + {d}] AS DOUBLE[]) AS v FROM embeddings, range({parts}) r(m)),
codes AS MATERIALIZED (
  SELECT y.vec_id, y.part, arg_min(b.centroid, (CAST(list_distance(y.v, CAST(b.c AS DOUBLE[])) ** 2 AS FLOAT), b.centroid)) AS code
  FROM y JOIN book b USING (part) GROUP BY y.vec_id, y.part)""")
    return ",".join(ctes)


_PQ = _pq_sql(PARTS, BITS, PQ_ITERATIONS)
_ADC = """
tab AS (SELECT y.vec_id AS query_id, y.part, b.centroid AS code, -list_dot_product(y.v, CAST(b.c AS DOUBLE[])) AS t FROM y JOIN book b USING (part) WHERE y.vec_id % 100 = 0),
adc AS (
  SELECT query_id, id, d AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (
    SELECT query_id, vec_id AS id, CAST(1.0 + sum(t ORDER BY part) AS FLOAT) AS d FROM codes JOIN tab USING (part, code) GROUP BY query_id, vec_id))"""
_EXACT = f"""
found AS (
  SELECT * FROM (
    SELECT h.query_id, h.id, {_DIST} AS distance, row_number() OVER (PARTITION BY h.query_id ORDER BY {_DIST}, h.id) AS rank
    FROM adc h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings e ON e.vec_id = h.id WHERE h.rank <= {CONFIG.ef_search})
  WHERE rank <= 10)"""
_EDGES = f"""
edges AS (
  SELECT src, dst, distance FROM (
    SELECT q.vec_id AS src, e.vec_id AS dst, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS k
    FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id) WHERE k <= {2 * DEGREE}),
deg AS (
  SELECT vec_id AS id, coalesce(n, 0) AS degree FROM embeddings LEFT JOIN (
    SELECT src, count(*) AS n FROM (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) GROUP BY src) ON src = vec_id),
hub AS (
  SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) <= greatest(1, ceil({HUB_RATIO} * (SELECT count(*) FROM deg))) AS is_hub FROM deg),
kept AS (
  SELECT src, dst, distance FROM (
    SELECT e.*, is_hub, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS k FROM edges e JOIN hub ON id = src)
  WHERE k <= CASE WHEN is_hub THEN {2 * DEGREE} ELSE {LOW_DEGREE} END),
graph AS (
  SELECT src, CAST(k AS INT) AS ord, dst FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS k FROM (
      SELECT src, dst, distance FROM kept UNION SELECT dst, src, distance FROM kept))
  WHERE k <= {2 * DEGREE})"""
_LEVEL = f"CAST(least(floor(-ln(greatest(CAST(('0x' || substr(sha256('level-42:' || vec_id), 1, 12))::BIGINT AS DOUBLE) / {float(2**48)!r}, {2.0**-48!r}::DOUBLE)) / ln(16.0::DOUBLE)), 16) AS INT)"
_UPPER = f"""
node AS (SELECT vec_id, embedding, {_LEVEL} AS top FROM embeddings),
up AS (
  SELECT level, src, ord, dst FROM (
    SELECT CAST(l.level AS INT) AS level, q.vec_id AS src, e.vec_id AS dst, CAST(row_number() OVER (PARTITION BY l.level, q.vec_id ORDER BY {_DIST}, e.vec_id) AS INT) AS ord
    FROM range(1, 17) l(level) JOIN node q ON q.top >= l.level JOIN node e ON e.top >= l.level AND e.vec_id <> q.vec_id)
  WHERE ord <= {DEGREE})"""
_ROUTE = f"""
asks AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
near AS (
  SELECT query_id, level, src, arg_min(dst, (d, dst)) AS dst, min(d) AS d FROM (
    SELECT q.query_id, level, src, dst, {_DIST} AS d FROM up JOIN embeddings e ON e.vec_id = dst, asks q) GROUP BY ALL),
top AS (SELECT vec_id, {_LEVEL} AS level, embedding FROM embeddings ORDER BY level DESC, sha256('level-42:' || vec_id) LIMIT 1),
w AS (
  SELECT q.query_id, e.vec_id AS id, e.level, {_DIST} AS d, 0 AS hops FROM asks q, top e
  UNION ALL
  SELECT w.query_id, CASE WHEN better THEN n.dst ELSE w.id END, CASE WHEN better THEN w.level ELSE w.level - 1 END, CASE WHEN better THEN n.d ELSE w.d END, w.hops + CAST(better AS INT)
  FROM (SELECT w.*, coalesce((n.d, n.dst) < (w.d, w.id), false) AS better FROM w LEFT JOIN near n ON n.query_id = w.query_id AND n.level = w.level AND n.src = w.id WHERE w.level > 0) w
  LEFT JOIN near n ON n.query_id = w.query_id AND n.level = w.level AND n.src = w.id)"""
# The walk, a level of all beams at a time: what each query has met, and what of
# its beam is expanded.
_BEAM = f"""
dist AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DIST} AS d FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
seed AS (SELECT vec_id AS id FROM embeddings ORDER BY sha256('seeds-42:' || vec_id), vec_id LIMIT 64),
start AS (
  SELECT query_id, id, d FROM w WHERE level = 0 UNION
  SELECT query_id, id, d FROM (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS k FROM dist JOIN seed USING (id)) WHERE k <= 4),
b AS (
  SELECT query_id, 0 AS step, list({{'d': d, 'id': id, 'done': false}}) AS v FROM start GROUP BY query_id
  UNION ALL
  SELECT f.query_id, f.step + 1, list_concat(list_transform(f.v, lambda x: {{'d': x.d, 'id': x.id, 'done': x.done OR list_contains(f.front, x.id)}}), coalesce(n.new, []))
  FROM (SELECT *, list_transform(list_filter(list_sort(v)[1:192], lambda x: NOT x.done), lambda x: x.id) AS front FROM b) f
  LEFT JOIN (
    SELECT query_id, list({{'d': d, 'id': dst, 'done': false}}) AS new FROM (
      SELECT DISTINCT s.query_id, g.dst, p.d
      FROM (SELECT query_id, v, unnest(list_transform(list_filter(list_sort(v)[1:192], lambda x: NOT x.done), lambda x: x.id)) AS src FROM b) s
      JOIN graph g ON g.src = s.src JOIN dist p ON p.query_id = s.query_id AND p.id = g.dst
      WHERE NOT list_contains(list_transform(s.v, lambda x: x.id), g.dst)) GROUP BY query_id) n ON n.query_id = f.query_id
  WHERE len(f.front) > 0),
walked AS (
  SELECT query_id, x.id AS id, x.d AS d, row_number() OVER (PARTITION BY query_id ORDER BY x.d, x.id) AS rank FROM (
    SELECT query_id, unnest(v) AS x FROM (SELECT query_id, arg_max(v, step) AS v FROM b GROUP BY query_id)))"""
_ANCHOR = "SELECT e.vec_id, q.vec_id AS anchor, {} AS distance FROM embeddings e JOIN (SELECT label, min(vec_id) AS a FROM embeddings GROUP BY label) USING (label) JOIN embeddings q ON q.vec_id = a"
_NORM = "sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))"


def oracles() -> dict[str, str]:
    sk, coarse = _sketch_sql(), _pq_sql(1, 4, 8)
    ivf = f"""{coarse},
cells AS (
  SELECT * FROM (
    SELECT y.vec_id AS query_id, centroid AS cell, row_number() OVER (PARTITION BY y.vec_id ORDER BY CAST(list_distance(y.v, CAST(b.c AS DOUBLE[])) ** 2 AS FLOAT), centroid) AS k
    FROM y, book b WHERE y.vec_id % 100 = 0) WHERE k <= {NPROBE}),
found AS (
  SELECT * FROM (
    SELECT query_id, e.vec_id AS id, {_DIST} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {_DIST}, e.vec_id) AS rank
    FROM cells JOIN codes ON code = cell JOIN embeddings e ON e.vec_id = codes.vec_id JOIN embeddings q ON q.vec_id = query_id)
  WHERE rank <= 10)"""
    return {
        "vector_norms": f"SELECT vec_id, round({_NORM}, 6) AS norm, len(embedding) = {D} AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS is_valid, abs({_NORM} - 1) <= 0.002 AS is_unit FROM embeddings",
        "vector_normalize": f"""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 3.0::FLOAT AS FLOAT)) AS embedding FROM embeddings),
u AS (SELECT vec_id, {_NORM} AS n, embedding AS e FROM a)
SELECT vec_id, CAST(len(e) AS INT) AS n, round(list_sum(list_transform(e, lambda x, i: CAST(CAST(x AS DOUBLE) / n AS FLOAT)::DOUBLE * i)), 4) AS weighed FROM u""",
        "cosine_pairs": _ANCHOR.format(f"round(CAST({_DIST} AS DOUBLE), 5) + 0.0::DOUBLE"),
        "squared_l2_pairs": _ANCHOR.format("round(CAST(CAST(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) ** 2 AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE"),
        "knn_exact_topk": f"WITH {_TRUTH} {_SHOWN} FROM truth",
        "knn_label_agreement": f"WITH {_TRUTH} SELECT query_id, count(*) FILTER (e.label = q.label) AS agree, count(*) AS n FROM truth JOIN embeddings e ON e.vec_id = id JOIN embeddings q ON q.vec_id = query_id GROUP BY query_id",
        "ground_truth_long": f"WITH {_TRUTH} SELECT query_id, CAST(rank AS INT) AS rank, id AS doc_id FROM truth",
        "ground_truth_rows": f"WITH {_TRUTH} SELECT query_id, string_agg(id::VARCHAR, ' ' ORDER BY rank) AS ids FROM truth GROUP BY query_id",
        "simhash_sketch": f"WITH {sk} SELECT id AS vec_id, array_to_string(bits, '') AS bits FROM w",
        "simhash_hamming_topk": f"WITH {sk} SELECT query_id, CAST(rank AS INT) AS rank, id AS vec_id, round(CAST(d AS DOUBLE), 5) AS distance FROM h WHERE rank <= 10",
        "simhash_recall": f"WITH {_TRUTH}, {sk} {_recall_sql(10)}",
        "recall_summary": f"WITH {_TRUTH}, {sk}, r1 AS ({_recall_sql(1)}), r10 AS ({_recall_sql(10)}) SELECT 1 AS k, CAST(sum(found) AS BIGINT) AS found, round(avg(recall), 6) AS recall FROM r1 UNION ALL SELECT 10, CAST(sum(found) AS BIGINT), round(avg(recall), 6) FROM r10",
        "pq_codebook": f"WITH {_PQ} SELECT CAST(part AS INT) AS part, centroid, CAST(j - 1 AS INT) AS coord, round(CAST(c[j] AS DOUBLE), 4) AS x FROM book, range(1, {D // PARTS + 1}) r(j)",
        "pq_encode": f"WITH {_PQ} SELECT vec_id, string_agg(code::VARCHAR, ' ' ORDER BY part) AS codes FROM codes GROUP BY vec_id",
        "pq_adc_topk": f"WITH {_PQ}, {_ADC} SELECT query_id, CAST(rank AS INT) AS rank, id AS vec_id, round(CAST(distance AS DOUBLE), 4) AS distance FROM adc WHERE rank <= 10",
        "pq_rerank_topk": f"WITH {_PQ}, {_ADC}, {_EXACT} {_SHOWN} FROM found",
        "pq_rerank_recall": f"WITH {_TRUTH}, {_PQ}, {_ADC}, {_EXACT} {_recall_sql(10)}",
        "pq_code_bytes": f"SELECT count(*) AS n, count(*) * {PARTS * BITS // 8} AS code_bytes, CAST(sum(len(embedding) * 4) AS BIGINT) AS dense_bytes, round(count(*) * {PARTS * BITS // 8} * 100.0 / sum(len(embedding) * 4), 6) AS percent FROM embeddings",
        "knn_graph_edges": f"WITH {_EDGES} SELECT src, dst, round(CAST(distance AS DOUBLE), 5) + 0.0::DOUBLE AS distance FROM edges",
        "cell_graph_recall": f"""WITH {_pq_sql(1, 4, 10)}, {_EDGES},
near AS (SELECT * FROM (
  SELECT y.vec_id, centroid AS cell, row_number() OVER (PARTITION BY y.vec_id ORDER BY CAST(list_distance(y.v, CAST(b.c AS DOUBLE[])) ** 2 AS FLOAT), centroid) AS k FROM y, book b) WHERE k <= {NPROBE}),
cand AS (
  SELECT n.vec_id AS src, e.vec_id AS dst, row_number() OVER (PARTITION BY n.vec_id ORDER BY {_DIST}, e.vec_id) AS k
  FROM near n JOIN near m ON m.cell = n.cell AND m.k = 1 JOIN embeddings q ON q.vec_id = n.vec_id JOIN embeddings e ON e.vec_id = m.vec_id WHERE n.vec_id <> m.vec_id)
SELECT count(*) AS edges, round(count(c.src) / count(*), 6) AS recall FROM edges LEFT JOIN (SELECT * FROM cand WHERE k <= {2 * DEGREE}) c USING (src, dst)""",
        "graph_hubs": f"WITH {_EDGES} SELECT id, degree, is_hub FROM hub",
        "graph_pruned": f"WITH {_EDGES} SELECT src, ord, dst FROM graph",
        "graph_csr_offsets": f"WITH {_EDGES}, n AS (SELECT vec_id AS id, count(src) AS n FROM embeddings LEFT JOIN graph ON src = vec_id GROUP BY vec_id) SELECT id, CAST(sum(n) OVER (ORDER BY id) AS BIGINT) - n AS begin, CAST(sum(n) OVER (ORDER BY id) AS BIGINT) AS \"end\" FROM n",
        "graph_degree_stats": f"WITH {_EDGES} SELECT n AS degree, count(*) AS nodes FROM (SELECT src, count(*) AS n FROM graph GROUP BY src) GROUP BY n",
        "graph_khop": f"""WITH {_EDGES},
h0 AS (SELECT vec_id AS query_id, vec_id AS id, 0 AS hop FROM embeddings WHERE vec_id % 100 = 0),
h1 AS (SELECT DISTINCT query_id, dst AS id, 1 AS hop FROM h0 JOIN graph ON src = id),
h2 AS (SELECT DISTINCT query_id, dst AS id, 2 AS hop FROM h1 JOIN graph ON src = id),
h3 AS (SELECT DISTINCT query_id, dst AS id, 3 AS hop FROM h2 JOIN graph ON src = id),
a AS (SELECT query_id, id, min(hop) AS hop FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY query_id, id)
SELECT query_id, hop, count(*) AS nodes FROM a GROUP BY query_id, hop""",
        "graph_levels": f"SELECT {_LEVEL} AS level, count(*) AS nodes FROM embeddings GROUP BY 1",
        "graph_upper_layers": f"WITH {_UPPER} SELECT level, src, ord, dst FROM up",
        "graph_beam_search": f"""WITH RECURSIVE {_EDGES}, {_UPPER}, {_ROUTE}, {_BEAM}
SELECT query_id, CAST(rank AS INT) AS rank, id AS vec_id, round(CAST(d AS DOUBLE), 5) + 0.0::DOUBLE AS distance FROM walked WHERE rank <= 10""",
        "graph_beam_recall": f"""WITH RECURSIVE {_EDGES}, {_UPPER}, {_ROUTE}, {_BEAM}, {_TRUTH}, found AS (SELECT query_id, id, rank FROM walked WHERE rank <= 10)
{_recall_sql(10)}""",
        "graph_routing": f"""WITH RECURSIVE {_UPPER}, {_ROUTE}
SELECT query_id, id AS vec_id, hops, round(CAST(d AS DOUBLE), 5) + 0.0::DOUBLE AS distance FROM w WHERE level = 0""",
        "graph_entry_point": f"SELECT vec_id AS id, {_LEVEL} AS level FROM embeddings ORDER BY level DESC, sha256('level-42:' || vec_id) LIMIT 1",
        "search_budget_metrics": "SELECT count(*) AS n, least(128, count(*)) AS exact_budget, least(count(*), greatest(least(128, count(*)), CAST(ceil(least(128, count(*)) / 0.25) AS BIGINT))) AS beam, CAST(ceil(least(128, count(*)) / 16.0) AS BIGINT) AS batches FROM embeddings",
        "ivf_topk": f"WITH {ivf} {_SHOWN} FROM found",
        "ivf_recall": f"WITH {_TRUTH}, {ivf} {_recall_sql(10)}",
        "result_invariants": "SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 500 IN (100, 200, 300)",
        "embedding_parity": """WITH p AS (
  SELECT vec_id AS id, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS kind, CAST(embedding AS DOUBLE[]) AS a,
    CAST(list_transform(embedding, lambda x: CAST(round(x, 2) AS FLOAT)) AS DOUBLE[]) AS b FROM embeddings),
r AS (SELECT id, kind, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS c,
    list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) AS m FROM p)
SELECT kind, count(*) AS n, round(min(c), 6) AS least, round(avg(c), 6) AS mean, round(max(m), 6) AS max_abs, arg_min(id, (round(c, 9), id)) AS worst_id FROM r GROUP BY kind""",
    }
