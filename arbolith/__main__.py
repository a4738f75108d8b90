"""python -m arbolith build|search|cluster|evaluate: the engine from a shell."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="arbolith")
    kinds = out.add_subparsers(dest="kind", required=True)
    p = kinds.add_parser("build", help="parse a JSON-lines file of theorems and encode them")
    p.add_argument("--theorems", required=True)
    p.add_argument("--rounds", type=int, default=3)
    p = kinds.add_parser("search", help="the theorems most similar to an expression")
    p.add_argument("--expr-json", help="file of an expression, or of a parsed query; without it, one is read from standard input")
    p.add_argument("-k", type=int, default=20)
    p.add_argument("--node-ratio", type=float)
    p.add_argument("--output", choices=("text", "json"), default="text")
    p = kinds.add_parser("cluster", help="cluster the encodings")
    for name, value in (("features", 5000), ("dims", 200), ("clusters", 2000)):
        p.add_argument(f"--{name}", type=int, default=value)
    p = kinds.add_parser("evaluate", help="rank stored theorems among their own results")
    p.add_argument("--names", nargs="+", required=True)
    p.add_argument("--report", required=True)
    for p in kinds.choices.values():
        p.add_argument("--store", required=True, help="folder of the store")
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from . import api
    from .operators import search

    spark = spark or SparkSession.builder.appName("arbolith").getOrCreate()
    if args.kind == "build":
        print(json.dumps(api.build(spark, spark.read.schema("name STRING, expr_json STRING, statement_str STRING").json(args.theorems), args.store, args.rounds)))
    elif args.kind == "cluster":
        print(json.dumps({"assigned": api.cluster_job(spark, args.store, args.features, args.dims, args.clusters).count()}))
    elif args.kind == "evaluate":
        print(json.dumps(api.evaluate_names(spark, args.store, args.names, args.report)))
    else:
        text = search.load_json(args.expr_json) if args.expr_json else sys.stdin.read().strip()
        if not text:
            print("No input. Stopping.", file=sys.stderr)
            return 1
        try:
            rows = api.find_similar(spark, args.store, text, args.k, args.node_ratio)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        for i, r in enumerate(rows, 1):
            print(json.dumps(r, ensure_ascii=False) if args.output == "json" else f"{i:3} {r['similarity_score']:.4f} {r['name']}: {r['statement']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
