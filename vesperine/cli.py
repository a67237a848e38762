"""``python -m vesperine.cli build|search|stats|bench|doctor``."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vesperine import api
from vesperine.functions.text import nearest_name
from vesperine.operators import evaluate, neighbours, search
from vesperine.plans import publish
from vesperine.sources import text as ts
from vesperine.sources.storage import write_shared


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:  # type: ignore[override]
        if message.startswith("unrecognized arguments"):
            nested = [p for a in self._actions if isinstance(a.choices, dict) for p in a.choices.values()]
            known = [o for p in [self, *nested] for a in p._actions for o in a.option_strings]
            for word in message.split()[2:]:
                near = nearest_name(word.partition("=")[0], known)
                if near:
                    message += f"; did you mean {near}?"
                    break
        super().error(message)


def _parser() -> _Parser:
    top = _Parser(prog="vesperine", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    for name in ("build", "search", "stats", "bench", "doctor"):
        p = commands.add_parser(name, allow_abbrev=False)
        p.add_argument("--index", required=True)
        p.add_argument("--format", choices=("text", "json"), default="text")
        if name in ("build", "search", "bench"):
            p.add_argument("--hash-dim", type=int, default=256)
        if name in ("search", "bench"):
            p.add_argument("--top-k", type=int, default=3)
            p.add_argument("--ef-search", type=int, default=64)
            p.add_argument("--rerank-ratio", type=float, default=0.25)
            p.add_argument("--scan-limit", type=int, default=100_000)
    commands.choices["build"].add_argument("--docs", required=True)
    commands.choices["build"].add_argument("--approx", choices=("pq", "simhash"), default="pq")
    commands.choices["build"].add_argument("--sketch-bits", type=int, default=128)
    commands.choices["build"].add_argument("--seed", type=int, default=42)
    for option, kind, value in (("--graph-degree", int, 16), ("--low-degree", int, 3), ("--hub-ratio", float, 0.02), ("--pq-subquantizers", int, 64), ("--pq-bits", int, 4)):
        commands.choices["build"].add_argument(option, type=kind, default=value)
    commands.choices["search"].add_argument("--query", required=True)
    commands.choices["bench"].add_argument("--queries", required=True)
    commands.choices["bench"].add_argument("--ground-truth", help="lines as written by write_ground_truth; brute force if left out")
    commands.choices["bench"].add_argument("--ground-truth-word", default=ts.GROUND_TRUTH, help="the first word of the ground-truth file")
    commands.choices["bench"].add_argument("--report-k", type=int, help="recall is also reported at this smaller k")
    commands.choices["bench"].add_argument("--warmup", type=int, default=1, help="runs before the measured ones")
    commands.choices["bench"].add_argument("--repeat", type=int, default=3)
    commands.choices["bench"].add_argument("--csv", help="folder for one row per query")
    commands.choices["doctor"].add_argument("--repair", action="store_true")
    commands.choices["doctor"].add_argument("--force-unlock", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vesperine").getOrCreate()
    try:
        return _run(args, spark)
    except (ValueError, RuntimeError, FileExistsError) as error:
        print(f"vesperine: {error}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        return 130


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    out: object
    if args.command == "build":
        config = search.BuildConfig(
            args.graph_degree, args.low_degree, args.hub_ratio, args.pq_subquantizers, args.pq_bits, sketch_bits=args.sketch_bits, seed=args.seed, approx=args.approx
        )
        if publish.aliased(spark, [args.docs], args.index):
            raise ValueError("the index would overwrite its documents")
        index = api.VectorIndex.build(ts.read_lines(spark, args.docs), args.index, api.hash_embedder(args.hash_dim), config)
        out = index.stats().first().asDict()
    elif args.command == "stats":
        out = api.VectorIndex.load(spark, args.index).stats().first().asDict()
    elif args.command == "doctor":
        out = publish.doctor(spark, args.index, args.repair, args.force_unlock)
    else:
        index = api.VectorIndex.load(spark, args.index)
        embedder = api.hash_embedder(args.hash_dim)
        config = search.SearchConfig(args.top_k, args.ef_search, scan_limit=args.scan_limit, rerank_ratio=args.rerank_ratio)
        if args.command == "search":
            asked = spark.createDataFrame([(0, args.query)], "query_id long, text string")
            found, _ = index.search(asked, embedder, config)
            out = [r.asDict() for r in found.orderBy("rank").collect()]
        else:
            out = _bench(args, spark, index, embedder, config)
    if args.format == "json":
        print(json.dumps(out, allow_nan=False))
    else:
        for row in out if isinstance(out, list) else [out]:
            print("\t".join(f"{k}={v}" for k, v in row.items()))
    return 0


def _bench(args: argparse.Namespace, spark: SparkSession, index: api.VectorIndex, embedder: api.Embedder, config: search.SearchConfig) -> dict:
    """Recall, budgets and batch latencies over ``--repeat`` runs."""
    asked = write_shared(ts.read_lines(spark, args.queries).withColumnRenamed("doc_id", "query_id"), "bench-queries")
    n = asked.count()
    took = []
    for k in range(args.warmup + args.repeat):
        began = time.perf_counter()
        found, metrics = index.search(asked, embedder, config)
        found = write_shared(found.withColumnRenamed("doc_id", "id"), "bench-results")
        if k >= args.warmup:
            took.append(1000 * (time.perf_counter() - began))
    if args.ground_truth:
        truth = ts.parse_ground_truth(ts.read_lines(spark, args.ground_truth), n, args.top_k, index.size(), args.ground_truth_word)
    else:
        own = api.embedded(asked.withColumnRenamed("query_id", "doc_id"), embedder).withColumnRenamed("id", "query_id")
        truth = neighbours.top_k(api.embedded(index.tables["documents"], embedder), own, args.top_k)
    recall = evaluate.recall(found, truth, args.top_k)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), " ")
    rows = metrics.join(recall, "query_id").join(found.groupBy("query_id").agg(ids.alias("result_ids")), "query_id", "left")
    rows = write_shared(rows.withColumnRenamed("query_id", "query_index"), "bench-rows")
    if args.csv:
        ts.observations_csv(rows.orderBy("query_index"), args.csv)
    out = rows.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"), F.avg("exact_recomputations").alias("exact_recomputations"),
        F.avg("approximate_distances").alias("approximate_distances"), F.avg("upper_layer_hops").alias("upper_layer_hops"),
    ).first().asDict()
    if args.report_k:
        out[f"recall_at_{args.report_k}"] = evaluate.recall(found, truth, args.report_k).agg(F.avg("recall")).first()[0]
    took.sort()
    rank = lambda part: took[max(0, -(-int(part * 100 * len(took)) // 100) - 1)]  # noqa: E731  nearest rank
    return out | {"batch_ms_mean": sum(took) / len(took), "batch_ms_p50": rank(0.5), "batch_ms_p95": rank(0.95), "queries_per_second": 1000 * n * len(took) / sum(took)}


if __name__ == "__main__":
    sys.exit(main())
