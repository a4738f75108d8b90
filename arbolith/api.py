"""What a service or a shell calls: ingestion, encoding and search by paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import cluster, search
from .plans import evaluate
from .sources import store


def build(spark: SparkSession, theorems: DataFrame, path: str, k: int = 3) -> dict[str, int]:
    """Parse theorems (name, expr_json, statement_str), and keep the theorem table, the encodings and the search table of depth k."""
    table, errors = store.ingest(theorems, path)
    parsed = spark.read.parquet(f"{path}/parsed").where("error IS NULL").drop("error")
    store.search_table(parsed, f"{path}/search", k)
    store.encode_job(parsed, path, k)
    return {"theorems": table.count(), "errors": errors.count()}


def find_similar(spark: SparkSession, path: str, expr_json: str, k: int = 20, node_ratio: float | None = None) -> list[dict]:
    """The k theorems most similar to an expression, which is given as JSON: name, similarity_score to four decimals, statement,
    node_count. ValueError for a request out of bounds or an expression that can't be read."""
    search.check_request(k, node_ratio, expr_json or "")
    rows = search.search(spark.read.parquet(f"{path}/search"), search.Target.from_json(spark, expr_json), k, node_ratio)
    return [{**r.asDict(), "similarity_score": round(r["similarity_score"], 4)} for r in rows.collect()]


def cluster_job(spark: SparkSession, path: str, features: int = 5000, dims: int = 200, k: int = 2000) -> DataFrame:
    """Cluster the search table; the model, the ids and the table by clusters are kept."""
    table = spark.read.parquet(f"{path}/search")
    ids = cluster.job(table, f"{path}/clustering", features, dims, k)
    cluster.write_partitioned(store.with_clusters(table, ids), f"{path}/clustering/lists")
    return ids


def find_pruned(spark: SparkSession, path: str, expr_json: str, clusters: int = 5500, top: int = 1500) -> DataFrame:
    """Stage one over the clusters nearest to an expression, topped up by a sample. Only the chosen clusters' files are read, others
    for the sample alone."""
    target = search.Target.from_json(spark, expr_json)
    ids = cluster.choose(cluster.load(spark, f"{path}/clustering"), target, clusters)
    return cluster.partitioned_search(spark.read.parquet(f"{path}/clustering/lists"), target, ids, top)


def evaluate_names(spark: SparkSession, path: str, names: list[str], report: str, top: int = 1500) -> dict[str, float]:
    """Search for stored theorems by name in one job, append the report, and give the metrics."""
    corpus = spark.read.parquet(f"{path}/search")
    rows = evaluate.report_many(corpus, corpus.where(corpus.name.isin(*names)), top).persist()
    store.write_csv(rows, f"{report}/report")
    store.write_missing(evaluate.ranks(rows), f"{report}/missing")
    out = search.ir_metrics(evaluate.ranks(rows)).first().asDict()
    rows.unpersist()
    return out
