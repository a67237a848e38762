import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vesperine import api, cli
from vesperine.functions import hashing
from vesperine.functions import text as tx
from vesperine.functions import vector as vf
from vesperine.operators import corpus, evaluate, graph, neighbours, quantize, search, sketch
from vesperine.plans import publish, roundtrips
from vesperine.sources import documents, storage, vectors
from vesperine.sources import text as ts

TOPICS = (
    "apple orange banana pear ripe orchard fruit juice",
    "compiler function variable source code software debug",
    "planet star galaxy orbit telescope astronomy comet",
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def topic_docs(spark, n=60):
    words = [t.split() for t in TOPICS]
    rows = [(i, " ".join(words[i % 3][(i // 3 + k) % len(words[i % 3])] for k in range(5)) + f" item{i % 7}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_known_answers():
    assert hashing.crc32c_of([b"123456789", b""]).tolist() == [0xE3069283, 0]
    h = hashing.fnv1a(np.frombuffer(b"hi", np.uint8), np.array([0]), np.array([2]))
    assert int(h[0]) == 628919584683901914
    assert hashing.splitmix64(0) == 0xE220A8397B1DCDAF
    assert hashing.canonical_hash({"b": 1, "a": "é"}) == hashing.canonical_hash({"a": "é", "b": 1})


def test_crc32c_of_more_rows_than_a_slice(spark):
    rows = spark.range(1300).repartition(1).select(F.col("id").cast("string").alias("t")).select("t", hashing.crc32c(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == hashing.crc32c_of([r.t.encode() for r in rows]).tolist() and len(rows) == 1300


def test_tokens_do_not_cross_texts():
    buf, starts, ends, first = hashing.tokens(pa.array(["Ab, c", None, "", "d-é"]))
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends)] == [b"Ab", b"c", b"d", "é".encode()]
    assert first.tolist() == [0, 2, 2, 2, 4]


def test_hash_embedding_is_deterministic_and_unit():
    texts = pa.array(["one two three", "ONE two THREE", "", None, "a"])
    v = hashing.hash_embed(texts, 64)
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and (v[0] == v[1]).all() and (v[2] == v[3]).all()


def test_text_functions(spark):
    assert one(spark, tx.clean_line(F.lit(" a\x00 b\n\x1cc "))) == "a b c"
    assert one(spark, tx.truncate_utf8(F.lit("é" * 10), 7)) == "ééé"
    assert one(spark, tx.truncate_utf8(F.lit("ab   cdef"), 5)) == "ab"
    assert one(spark, tx.truncate_utf8(F.lit("short"), 80)) == "short"
    good = {"1": 1.0, "+1.5e3": 1500.0, ".5": 0.5, "-0": 0.0, "0e-999": 0.0}
    for text, value in good.items():
        assert one(spark, tx.parse_decimal(F.lit(text))) == value
    for text in ("", "1e400", "1e-400", "nan", "inf", "0x1", "1,0", " 1", "1e", "1d"):
        assert one(spark, tx.parse_decimal(F.lit(text))) is None
    assert one(spark, tx.edit_distance(F.lit("kitten"), F.lit("sitting"), 2)) == 3
    assert one(spark, tx.normalize_url(F.lit("http://h/v1//"))) == "http://h"
    assert one(spark, tx.identifier(F.lit("a\tb"))) is None
    assert one(spark, tx.bigrams(tx.tokenize(F.lit("A b-C")))) == ["a\x1fb", "b\x1fc"]


def test_prepared_texts(spark):
    prefix = tx.DOCUMENT_PREFIX
    long = "é" * 60
    rows = [(1, "T", " x "), (2, None, "  "), (3, "", long), (4, None, "a" * 63), (5, None, "a" * 64), (6, None, "a" * 62 + "  b")]
    got = {r.id: r for r in corpus.prepared(spark.createDataFrame(rows, "id long, t string, x string"), "id", F.col("t"), F.col("x"), 80, "s").collect()}
    assert sorted(got) == [1, 3, 4, 5, 6]  # a document without usable text is left out
    assert {k: r.prepared for k, r in got.items()} == {1: prefix + "T. x", 3: prefix + "é" * 31, 4: prefix + "a" * 63, 5: prefix + "a" * 63, 6: prefix + "a" * 62}
    assert {k: (r.raw_bytes, r.original_bytes, r.truncated) for k, r in got.items()} == {
        1: (4, 21, False), 3: (120, 137, True), 4: (63, 80, False), 5: (64, 81, True), 6: (64, 81, True)
    }


@pytest.mark.parametrize("bad", [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [float("-inf"), 0.0]])
def test_normalize_rejects(spark, bad):
    df = spark.createDataFrame([(bad,)], "v array<float>")
    with pytest.raises(Exception, match="norm"):
        df.select(vf.normalize(F.col("v"))).collect()


def test_ties_go_to_the_lower_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(10)] + [(10, [0.0, 1.0])], "id long, v array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, v array<float>")
    for n in (1, 5):
        assert [r.id for r in neighbours.top_k(rows.repartition(n), q, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_many_query_blocks_agree(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(50)], "id long, v array<float>")
    q = rows.withColumnRenamed("id", "query_id")
    a, b = (sorted(map(tuple, neighbours.top_k(rows, q, 4, block=n).collect())) for n in (4096, 7))
    assert a == b and len(a) == 200


def test_quantizer_round_trip_and_checks(spark):
    codes = [3, 0, 15, 7, 1]
    raw = quantize.pack(np.array([codes, codes[::-1]]), 4)
    assert quantize.unpack(raw, 5, 4).tolist() == [codes, codes[::-1]] and quantize.pack(np.array([codes]), 5).shape == (1, 4)
    assert raw[0].tobytes() == sum(c << (4 * k) for k, c in enumerate(codes)).to_bytes(3, "little")
    rows = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(4)]) for i in range(30)], "id long, v array<float>")
    book = quantize.train(rows, 2, 2)
    assert book.code_bytes == 1 and book.centroids.shape == (2, 4, 2)
    v = np.eye(4, dtype=np.float32)
    exact = 1 - (v @ np.concatenate([book.centroids[m][book.encode(v)[:, m]] for m in range(2)], axis=1).T)
    assert np.allclose(book.distances(book.table(v), book.encode(v).astype(int)), exact)
    for parts, bits in ((3, 2), (2, 9), (0, 2)):
        with pytest.raises(ValueError):
            quantize.train(rows, parts, bits)


def test_configs_are_checked():
    for bad in ({"top_k": 0}, {"top_k": 9, "ef_search": 8}, {"rerank_ratio": 0.0}, {"rerank_ratio": float("nan")}, {"recompute_batch_size": 0}):
        with pytest.raises(ValueError):
            search.SearchConfig(**bad)
    for bad in ({"hub_ratio": 2.0}, {"low_degree": 0}, {"sketch_bits": 65}, {"pq_bits": 9}):
        with pytest.raises(ValueError):
            search.BuildConfig(**bad)
    assert search.SearchConfig(ef_search=64, rerank_ratio=0.25).budget(100) == (64, 100)
    assert search.SearchConfig(ef_search=64, rerank_ratio=0.25).budget(1000) == (64, 256)
    with pytest.raises(ValueError):
        sketch.projections(65, 8)


def test_pruned_graph_bounds(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(80, 6)))], "id long, v array<float>")
    edges = graph.knn_edges(rows, 8)
    marked = graph.hubs(edges, rows, 0.05)
    assert marked.filter("is_hub").count() == 4
    g = graph.prune(edges, marked, 4, 2)
    assert g.groupBy("src").count().agg(F.max("count")).first()[0] <= 8 and g.filter("src = dst").count() == 0
    a = sorted(map(tuple, g.collect()))
    shuffled = rows.repartition(7).orderBy(F.desc("id"))
    again = graph.knn_edges(shuffled, 8)
    assert a == sorted(map(tuple, graph.prune(again, graph.hubs(again, shuffled, 0.05), 4, 2).collect()))
    assert graph.hubs(edges, rows, 0).filter("is_hub").count() == 0
    ends = graph.offsets(g, rows, slice_rows=16).orderBy("id").collect()
    assert ends[0].begin == 0 and ends[-1].end == len(a) and all(x.end == y.begin for x, y in zip(ends, ends[1:]))


def test_recall_and_invariants(spark):
    truth = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7), (1, 2, 8)], "query_id long, rank int, id long")
    got = spark.createDataFrame([(0, 1, 6), (0, 2, 5), (1, 1, 1), (1, 2, 8)], "query_id long, rank int, id long")
    assert {r.query_id: r.recall for r in evaluate.recall(got, truth, 2).collect()} == {0: 1.0, 1: 0.5}
    assert {r.query_id: r.recall for r in evaluate.recall(got, truth, 1).collect()} == {0: 0.0, 1: 0.0}
    assert evaluate.result_faults(got, 2, 9).count() == 0 and evaluate.result_faults(got, 2, 8).count() == 1


def test_percentile_rules(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    got = df.agg(evaluate.disc("v", 0.5).alias("a"), evaluate.disc("v", 0.95).alias("b"), evaluate.linear("v", 0.5).alias("c"), evaluate.linear("v", 0.95).alias("d")).first()
    assert tuple(round(x, 9) for x in got) == (2.0, 10.0, 2.5, 8.95)


def test_evenly_spaced(spark):
    for count, n, want in ((10, 4, [0, 3, 6, 9]), (10, 1, [0]), (3, 8, [0, 1, 2]), (10, 0, [])):
        assert [r.idx for r in corpus.evenly_spaced(spark, count, n).orderBy("idx").collect()] == want
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([5, 9, 30, 9, 30, 1])], "idx long, n_bytes int")
    got = {r.idx: r.categories for r in corpus.sample_categories(rows, 3, 1, [3]).collect()}
    assert got[2] == ["evenly_spaced", "longest"] and sorted(got) == [0, 2, 3, 5]


def test_tiers_are_nested_and_unique(spark):
    rows = spark.createDataFrame(
        [(i, f"t{i if i != 15 else 14}", tx_hash(i), i < 3) for i in range(18)], "id long, text_hash string, rank_hash string, positive boolean"
    )
    small, large = corpus.tiers(rows, 7, 12), corpus.tiers(rows, 7, 16)
    a, b = {r.id for r in small.filter("tier = 0").collect()}, {r.id for r in large.filter("tier = 0").collect()}
    assert a == b and len(a) == 7 and {0, 1, 2} <= a
    assert len({14, 15} & {r.id for r in large.collect()}) == 1
    assert corpus.not_nested(small, large).count() == 0


def tx_hash(i):
    import hashlib

    return hashlib.sha256(f"synthetic-seed{i}".encode()).hexdigest()


def test_ground_truth_files(spark, tmp_path):
    truth = spark.createDataFrame([(0, 1, 0), (0, 2, 2), (1, 1, 3), (1, 2, 1)], "query_id long, rank int, id long")
    path = f"file://{tmp_path}/gt"
    ts.write_ground_truth(truth, path, 2, 4, "GT1")
    lines = ts.read_lines(spark, path)
    assert sorted(map(tuple, ts.parse_ground_truth(lines, 2, 2, 4, "GT1").collect())) == sorted(map(tuple, truth.collect()))
    assert ts.parse_ground_truth(lines, 2, 1, 4, "GT1").count() == 2
    make = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for bad in (make("GT1 2 2 4", "0 0", "3 1"), make("GT1 2 2 4", "0 4", "3 1"), make("GT1 2 1 4", "0", "3"), make("GT1 2 2 4", "0 2"), make("X 2 2 4", "0 2", "3 1"), make("GT1 2 2 4", "0 02", "3 1")):
        with pytest.raises(ValueError):
            ts.parse_ground_truth(bad, 2, 2, 4, "GT1")


def test_line_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\ntwo\rstill two\nthree")
    rows = ts.read_lines(spark, str(tmp_path / "a.txt")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(0, "one"), (1, "two\rstill two"), (2, "three")]
    assert ts.source_identity(spark, str(tmp_path / "a.txt")).first()["size"] == 25
    kv = ts.key_values(spark.createDataFrame([(0, "a = 1=2"), (1, "nothing")], "doc_id long, text string")).collect()
    assert [(r.key, r.value) for r in kv] == [("a", "1=2")]


def test_retrieval_dataset_scans(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"_id": "1", "text": "x"}\n{"_id": "2", "text": "y"}\n')
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\n1\td1\t1\n2\td2\t0\n")
    assert ts.read_queries(spark, str(tmp_path / "q.jsonl")).count() == 2
    assert corpus.positives(ts.read_qrels(spark, str(tmp_path / "r.tsv"))).count() == 1
    (tmp_path / "q2.jsonl").write_text('{"_id": "1", "text": "x"}\n{"_id": "1", "text": "y"}\n')
    (tmp_path / "r2.tsv").write_text("query-id\tcorpus-id\tscore\n1\td1\tnan\n")
    with pytest.raises(ValueError):
        ts.read_queries(spark, str(tmp_path / "q2.jsonl"))
    with pytest.raises(ValueError):
        ts.read_qrels(spark, str(tmp_path / "r2.tsv"))


def test_embedding_caches(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "row_id long, embedding array<float>")
    path = f"file://{tmp_path}/cache"
    vectors.write_cache(rows, path, "f", 2, 10, "aa")
    assert vectors.read_cache(spark, path, "f", 2, 2, (10, "aa")).count() == 2
    for wrong in ({"fingerprint": "g"}, {"rows": 3}, {"dimension": 4}, {"source": (11, "aa")}):
        with pytest.raises(ValueError):
            vectors.read_cache(spark, path, **wrong)
    with pytest.raises(FileExistsError):
        vectors.write_cache(rows, path, "f", 2)
    with pytest.raises(ValueError):
        vectors.write_cache(rows.select("row_id", F.array(F.lit(2.0), F.lit(0.0)).cast("array<float>").alias("embedding")), path + "2", "f", 2)
    raw = vectors.encode_binary(np.eye(2, dtype=np.float32), b"fp", b"CACHE002", (7, b"s" * 32))
    got, fp, source = vectors.decode_binary(raw, b"CACHE002", True)
    assert (got == np.eye(2)).all() and fp == b"fp" and source == (7, b"s" * 32)
    for bad in (raw[:-1], raw + b"x", b"X" + raw[1:], vectors.encode_binary(2 * np.eye(2), b"f", b"CACHE002", (7, b"s" * 32)), vectors.encode_binary(np.eye(2) * np.nan, b"f", b"CACHE002", (7, b"s" * 32))):
        with pytest.raises(ValueError):
            vectors.decode_binary(bad, b"CACHE002", True)
    (tmp_path / "c.bin").write_bytes(raw)
    assert vectors.read_binary(spark, str(tmp_path / "c.bin"), b"CACHE002", True).count() == 2


def test_document_store(spark, tmp_path):
    docs = topic_docs(spark, 20)
    path = f"{tmp_path}/store"
    documents.write(docs, path, 3)
    store = documents.open_store(spark, path)
    assert documents.read(store, 7).first().text == docs.filter("doc_id = 7").first().text
    asked = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "ord int, doc_id long")
    assert [r.doc_id for r in documents.read_many(store, asked).orderBy("ord").collect()] == [5, 2, 5]
    with pytest.raises(Exception, match="checksum"):
        documents.read(store.withColumn("crc32c", F.col("crc32c") + 1), 7).collect()


def test_index_round_trip(spark, tmp_path, capsys):
    docs = topic_docs(spark)
    path = f"file://{tmp_path}/index"
    embedder = api.hash_embedder(64)
    index = api.VectorIndex.build(docs, path, embedder, search.BuildConfig(graph_degree=6, low_degree=3, pq_parts=16))
    asked = spark.createDataFrame([(0, "ripe apple orchard fruit"), (1, "planet orbit star")], "query_id long, text string")
    for limit in (100_000, 1):
        found, metrics = index.search(asked, embedder, search.SearchConfig(top_k=3, ef_search=24, scan_limit=limit, rerank_ratio=0.5))
        rows = found.collect()
        assert len(rows) == 6 and all(r.doc_id % 3 == (0 if r.query_id == 0 else 2) for r in rows)
        assert all(m.exact_recomputations <= 24 for m in metrics.collect())
    every, _ = index.search(asked, embedder, search.SearchConfig(top_k=5, ef_search=60, rerank_ratio=1.0))
    truth = neighbours.top_k(api.embedded(docs, embedder), api.embedded(asked.withColumnRenamed("query_id", "doc_id"), embedder).withColumnRenamed("id", "query_id"), 5)
    assert {(r.query_id, r["rank"], r.doc_id) for r in every.collect()} == {(r.query_id, r["rank"], r.id) for r in truth.collect()}
    with pytest.raises(api.FingerprintMismatch):
        index.search(asked, api.hash_embedder(128))
    stats = index.stats().first()
    assert stats.documents == 60 and stats.code_bytes == 60 * 8
    assert cli.main(["search", "--index", path, "--query", "telescope comet", "--hash-dim", "64", "--format", "json"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)) == 3
    with pytest.raises(SystemExit):
        cli.main(["search", "--index", path, "--query", "x", "--topk", "2"], spark)
    assert "did you mean --top-k" in capsys.readouterr().err
    with pytest.raises(ValueError):
        api.VectorIndex.build(docs.union(docs), path + "2", embedder, search.BuildConfig(pq_parts=16))


def test_exact_top_k_sums_in_order(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 48))
    v[40:200] = v[7]  # copies
    v[200:240] = v[7] + 1e-7 * rng.normal(size=(40, 48))  # nearer than an FP32 product can tell
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    order = rng.permutation(300)
    rows = spark.createDataFrame([(int(i), v[i].tolist()) for i in order] + [(999, None)], "id long, v array<float>").repartition(5)
    asked = rows.filter("id % 10 = 7 or id = 999").withColumnRenamed("id", "query_id")
    d = (1.0 - np.add.accumulate(v[:, None, :].astype(np.float64) * v[None], axis=2)[:, :, -1]).astype(np.float32)
    wanted = {(q, r + 1, int(i)) for q in range(7, 300, 10) for r, i in enumerate(np.lexsort((np.arange(300), d[q]))[:4])}
    for block in (100, 9):
        found = neighbours.exact_top_k(rows, asked, 4, block).collect()
        assert {(r.query_id, r["rank"], r.id) for r in found} == wanted and len(found) == len(wanted)
        assert all(r.distance == d[r.query_id, r.id] for r in found)
    assert neighbours.exact_top_k(rows.limit(0), asked, 4).count() == 0
    assert neighbours.exact_top_k(rows, asked.limit(0), 4).count() == 0


def test_normalize_sums_a_norm_once(spark):
    rows = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(512)), lambda x: (x * (F.col("id") + 1)).cast("float")).alias("v"))
    one = rows.select(vf.normalize(F.col("v")).alias("v"))
    assert one.filter(~vf.is_unit(F.col("v"), 1e-6)).count() == 0
    plan = one._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1  # it stood in the lambda of each coordinate
    kept = spark.sql("select array(float(0.6), float(0.8)) v").select(vf.normalize(F.col("v"), vf.ROUNDED).alias("a"), vf.normalize(F.array(F.lit(3.0), F.lit(4.0)), vf.ROUNDED).alias("b")).first()
    assert kept.a == kept.b == [np.float32(0.6), np.float32(0.8)]


def test_budget_of_all_documents_makes_no_row_per_pair(spark, tmp_path, monkeypatch):
    docs = topic_docs(spark, 90)
    asked = docs.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    written = []
    monkeypatch.setattr(api, "write_shared", lambda df, label: written.append(label) or storage.write_shared(df, label))
    for approx in ("pq", "simhash"):
        index = api.VectorIndex.build(docs, f"file://{tmp_path}/{approx}", api.hash_embedder(64), search.BuildConfig(pq_parts=16, approx=approx), with_graph=False)
        found, metrics = index.search(asked, None, search.SearchConfig(top_k=5, ef_search=90, rerank_ratio=1.0))
        assert "shortlist" not in written and found.count() == 45
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the scan's worker has none beside it
        assert {m.exact_recomputations for m in metrics.collect()} == {90}
        vectors = api.embedded(docs, api.hash_embedder(64))
        pairs = vectors.join(vectors.filter("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")))
        truth = search.ranked(pairs.select("query_id", "id", vf.cosine_distance(F.col("q"), F.col("v")).alias("distance")), 5)
        assert {(r.query_id, r["rank"], r.doc_id, r.distance) for r in found.collect()} == {(r.query_id, r["rank"], r.id, r.distance) for r in truth.collect()}


def test_index_searches_have_null_texts_as_empty(spark, tmp_path):
    rows = [(0, "ripe apple"), (1, None), (2, ""), (3, "orbit star"), (4, "code"), (5, "apple"), (100, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (roundtrips.index_search, roundtrips.simhash_index_search):
        found = {(r.query_id, r.doc_id) for r in query(spark, str(tmp_path)).collect()}
        assert {(100, 1), (100, 2), (100, 100)} <= found and len(found) == 10


def test_publication(spark, tmp_path):
    path = f"file://{tmp_path}/pub"
    df = spark.range(3).toDF("x")
    first = publish.publish(spark, path, {"t": df}, {"a": 1})
    with publish.lock(spark, path):
        with pytest.raises(publish.IndexBusy):
            publish.publish(spark, path, {"t": df}, {})
        assert publish.doctor(spark, path, repair=True)["lock"] == "running"
    broken = df.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        publish.publish(spark, path, {"t": broken}, {})
    assert publish.manifest(spark, path)["version"] == first
    second = publish.publish(spark, path, {"t": df.union(df)}, {"a": 2})
    meta, tables = publish.load(spark, path)
    assert meta == {"a": 2} and tables["t"].count() == 6
    df.write.parquet(f"{path}/versions/stray/t")
    assert publish.doctor(spark, path)["orphans"] == ["stray"]
    assert publish.doctor(spark, path, repair=True)["repaired"] and publish.doctor(spark, path)["orphans"] == []
    assert publish.manifest(spark, path)["version"] == second
    with pytest.raises(publish.InvalidIndex):
        publish.manifest(spark, f"file://{tmp_path}/nothing")


def test_incremental_ingest(spark, tmp_path):
    from vesperine.streaming.ingest import ingest

    docs = topic_docs(spark, 30)
    embedder = api.hash_embedder(32)
    book = quantize.train(api.embedded(docs, embedder), 8, 3)
    source, target, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    docs.filter("doc_id < 20").write.parquet(source)
    ingest(spark, source, target, state, embedder, book).awaitTermination()
    docs.filter("doc_id >= 20").write.mode("append").parquet(source)
    ingest(spark, source, target, state, embedder, book).awaitTermination()
    assert spark.read.parquet(target).select("id").distinct().count() == 30


def test_measurement_joins(spark):
    files = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "y", "2"), ("b", "x", "1")], "k string, name string, digest string")
    assert evaluate.set_hash(files, ["k"]).select("set_hash").distinct().count() == 1
    grid = spark.createDataFrame([("a", 1), ("a", 2)], "s string, v int")
    assert evaluate.missing(grid, grid.limit(1)).count() == 1
    both = ts.union_of_keys([grid, grid.select("s").withColumn("w", F.lit(1))])
    assert both.columns == ["s", "v", "w"] and both.count() == 4


def test_cell_edges_reach_their_recall_with_the_defaults(spark):
    x = np.random.default_rng(7).standard_normal((3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = {(r.src, r.dst) for r in graph.knn_edges_in_cells(rows, 8).filter("src % 100 = 0").collect()}
    near = x[::100] @ x.T
    near[np.arange(30), np.arange(30) * 100] = -2
    true = {(100 * k, int(j)) for k, row in enumerate(np.argsort(-near, axis=1)[:, :8]) for j in row}
    assert len(got & true) >= 0.9 * len(true)


def test_bench_command(spark, tmp_path, capsys):
    docs = topic_docs(spark)
    path = f"file://{tmp_path}/index"
    (tmp_path / "docs.txt").write_text("\n".join(r.text for r in docs.orderBy("doc_id").collect()))
    (tmp_path / "queries.txt").write_text("ripe apple orchard\nplanet orbit star\ncompiler source code\n")
    build = ["build", "--docs", f"file://{tmp_path}/docs.txt", "--index", path, "--hash-dim", "64", "--pq-subquantizers", "16", "--graph-degree", "6", "--format", "json"]
    assert cli.main(build, spark) == 0 and json.loads(capsys.readouterr().out)["documents"] == 60
    assert cli.main([*build[:4], f"file://{tmp_path}/docs.txt/x", *build[5:]], spark) == 1  # the index would stand in its documents
    assert "overwrite" in capsys.readouterr().err
    embedder = api.hash_embedder(64)
    asked = ts.read_lines(spark, f"file://{tmp_path}/queries.txt")
    truth = neighbours.top_k(api.embedded(docs, embedder), api.embedded(asked, embedder).withColumnRenamed("id", "query_id"), 3)
    ts.write_ground_truth(truth, f"file://{tmp_path}/truth", 3, 60, ts.GROUND_TRUTH)
    bench = ["bench", "--index", path, "--queries", f"file://{tmp_path}/queries.txt", "--hash-dim", "64", "--ef-search", "60", "--rerank-ratio", "1.0", "--repeat", "2"]
    bench += ["--warmup", "0", "--report-k", "1", "--csv", f"file://{tmp_path}/rows", "--ground-truth", f"file://{tmp_path}/truth", "--format", "json"]
    assert cli.main(bench, spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["queries"] == 3 and out["recall"] == out["recall_at_1"] == 1.0 and out["exact_recomputations"] == 60
    assert 0 < out["batch_ms_p50"] <= out["batch_ms_p95"] and out["queries_per_second"] > 0
    kinds = spark.read.csv(f"file://{tmp_path}/rows", header=True)
    assert kinds.count() == 3 and {"query_index", "recall", "result_ids", "upper_layer_hops"} <= set(kinds.columns)
    assert cli.main(["stats", "--index", path + "-none"], spark) == 1


def test_simhash_index(spark, tmp_path):
    docs = topic_docs(spark, 150)
    seen = []
    config = search.BuildConfig(graph_degree=12, low_degree=5, hub_ratio=0.04, sketch_bits=192, approx="simhash")
    index = api.VectorIndex.build(docs, f"file://{tmp_path}/index", api.hash_embedder(256), config, progress=lambda phase, n: seen.append((phase, n)))
    assert seen == [("embedded", 150), ("compressed", 150), ("linked", 150), ("published", 150)]
    asked = spark.createDataFrame([(0, "ripe apple orchard fruit")], "query_id long, text string")
    found, metrics = index.search(asked, None, search.SearchConfig(top_k=5, ef_search=30, rerank_ratio=0.5))
    assert len(rows := found.collect()) == 5 and all(r.doc_id % 3 == 0 for r in rows)
    assert metrics.first().exact_recomputations == 30
    stats = index.stats().first()
    assert stats.code_bytes == 150 * 24 and stats.index_bytes > 0

    def stop(phase, n):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        api.VectorIndex.build(docs, f"file://{tmp_path}/stopped", api.hash_embedder(256), config, progress=stop)
    with pytest.raises(publish.InvalidIndex):
        api.VectorIndex.load(spark, f"file://{tmp_path}/stopped")
    with pytest.raises(api.FingerprintMismatch):
        api.embedder_of("nobody:7")


def test_intermediate_tables_go(spark):
    """What a kept table was made of is deleted; the table itself stays."""
    from vesperine.sources import storage

    seen = []

    def make():
        inner = storage.write_shared(spark.range(5).toDF("x"), "inner")
        seen.append(inner.inputFiles()[0].rpartition("/")[0])
        seen.append(storage.kept(spark, lambda: inner, "nested").inputFiles()[0].rpartition("/")[0])
        return inner.withColumn("y", F.col("x") + 1)

    out = storage.kept(spark, make, "outer")
    assert sorted(map(tuple, out.collect())) == [(k, k + 1) for k in range(5)]
    assert not any(storage.exists(spark, path) for path in seen)


def test_hubs_of_tied_degrees(spark):
    edges = spark.createDataFrame([(k, (k + 1) % 50) for k in range(50)], "src long, dst long")  # all of degree 2
    got = graph.hubs(edges, spark.range(50), 0.3, slice_rows=4)
    assert sorted(r.id for r in got.filter("is_hub").collect()) == list(range(15))


def test_spread_seeds():
    points = np.repeat(np.eye(4), 5, axis=0)
    assert len(np.unique(quantize.spread_seeds(points, 4, 1), axis=0)) == 4  # a chosen point has no chance any more
    assert quantize.spread_seeds(np.zeros((3, 2)), 5, 1).shape == (5, 2)


def test_long_strings_have_the_same_checksum():
    rng = np.random.default_rng(1)
    values = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 1023, 1024, 1025, 5000, 40_000)]
    table = hashing._crc_table()
    for value, got in zip(values, hashing.crc32c_of(values)):
        crc = 0xFFFFFFFF
        for byte in value:
            crc = int(table[(crc ^ byte) & 0xFF]) ^ (crc >> 8)
        assert crc ^ 0xFFFFFFFF == got


def test_strict_sources(spark, tmp_path):
    docs = topic_docs(spark, 20)
    documents.write(docs, f"{tmp_path}/store", 3)
    store = documents.open_store(spark, f"{tmp_path}/store")
    with pytest.raises(Exception, match="no document 99"):
        documents.read_many(store, spark.createDataFrame([(0, 5), (1, 99)], "ord int, doc_id long")).collect()
    with pytest.raises(ValueError):
        documents.open_store(spark, _written(docs.drop("text"), f"{tmp_path}/other"))
    broken = spark.range(1).select(F.unhex(F.lit("61C0AF")).cast("string").alias("x"))
    with pytest.raises(Exception, match="UTF-8"):
        broken.select(ts.as_json(F.col("x"))).collect()
    for k in range(3):  # files in the order of their names, whatever their sizes
        (tmp_path / f"part-{k}.txt").write_text("\n".join(f"{k} {i}" for i in range(5 * (3 - k))))
    lines = ts.read_lines(spark, f"{tmp_path}/part-*.txt").orderBy("doc_id").collect()
    assert [r.text for r in lines] == [f"{k} {i}" for k in range(3) for i in range(5 * (3 - k))] and [r.doc_id for r in lines] == list(range(30))
    with pytest.raises(Exception, match="constraint"):
        ts.staged(spark.createDataFrame([(1, "x", 2)], "id long, text string, n_bytes int"), "v").collect()
    with pytest.raises(ValueError):
        api.VectorIndex.build(spark.createDataFrame([(None, "x")], "doc_id long, text string"), f"{tmp_path}/i", api.hash_embedder(64), search.BuildConfig(pq_parts=16))


def _written(df, path):
    df.write.parquet(path)
    return path
