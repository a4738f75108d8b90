"""Parquet store: theorem and encoding tables, upsert, cleaning, text and CSV sinks, the JSON log, audits, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import wl
from ..operators.search import parse_trees

# Columns of the theorem table and of the evaluation CSV.
THEOREMS = "name STRING, expr_json STRING, statement_str STRING, node_count INT, simp_node_count INT"
CSV_COLUMNS = ("Target Name", "Top 10 Names", "Top 10 Edit Similarities", "Top 10 WL Scores", "Top 10 Ranks", "Target Rank", "Is Target in Top 10")


def has_json(col: str):
    """Neither SQL null nor JSON null."""
    return F.col(col).isNotNull() & (F.trim(F.col(col)) != "null")


def ingest(theorems: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Parse and write the theorem table, sorted by size within files so that range filters skip row groups.
    Returns the table and the rows that failed, with their errors."""
    parsed = parse_trees(theorems.where(has_json("expr_json")))
    parsed.write.mode("overwrite").parquet(f"{path}/parsed")
    back = theorems.sparkSession.read.parquet(f"{path}/parsed")
    back.where("error IS NULL").drop("error").repartitionByRange("simp_node_count", "name").sortWithinPartitions("simp_node_count", "name").write.mode("overwrite").parquet(f"{path}/theorems")
    return theorems.sparkSession.read.parquet(f"{path}/theorems"), back.where("error IS NOT NULL").select("name", "error")


def encode_job(trees: DataFrame, path: str, k: int) -> DataFrame:
    """Write the encodings of depth k as the partition k; other depths stay."""
    spark = trees.sparkSession
    enc = wl.encode(trees, k).select("name", "enc", "norm2", "tree_depth").withColumn("k", F.lit(k))
    enc.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k").parquet(f"{path}/wl_encodings")
    return spark.read.parquet(f"{path}/wl_encodings").where(F.col("k") == k)


def search_table(trees: DataFrame, path: str, k: int = 3) -> DataFrame:
    """Write trees with their encodings of depth k as one table, sorted by size within files, so that a range filter skips row
    groups and no search has to join or encode. Row-local but for the sort within partitions."""
    wl.encode(trees.sortWithinPartitions("simp_node_count", "name"), k).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return trees.sparkSession.read.parquet(path)


def joined(theorems: DataFrame, encodings: DataFrame) -> DataFrame:
    """Theorems with stored encodings, by name; rows without an encoding, or with an empty table on either side, go."""
    return theorems.join(encodings.drop("k"), "name")


def write_clusters(assigned: DataFrame, path: str) -> DataFrame:
    """Write (name, cluster_id), which replaces what was there."""
    assigned.select("name", "cluster_id").write.mode("overwrite").parquet(path)
    return assigned.sparkSession.read.parquet(path)


def with_clusters(table: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add cluster_id by name; null for names that have none."""
    return table.join(clusters.select("name", "cluster_id"), "name", "left")


def upsert(table: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row of each key over both; at equal versions the new one."""
    both = table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__r", last).where("__r = 1").drop("__r", "__new")


def create_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (theorem_name STRING, enc MAP<STRING, INT>, tree_depth INT) USING parquet")


def ensure_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def clean(enc: DataFrame) -> DataFrame:
    """Null or empty encodings become empty maps without a cluster."""
    bare = F.col("enc").isNull() | (F.size("enc") == 0)
    return enc.withColumn("cluster_id", F.when(~bare, F.col("cluster_id"))).withColumn("enc", F.coalesce("enc", F.expr("cast(map() as map<string,int>)")))


def write_csv(rows: DataFrame, path: str) -> None:
    """Append evaluation rows."""
    rows.select(*CSV_COLUMNS).write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_missing(ranks: DataFrame, path: str) -> None:
    ranks.where("rank IS NULL").select(F.format_string("%s not found in results", "target").alias("value")).write.mode("append").text(path)


def export(results: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "csv":
        results.select(F.col("name").alias("Name"), F.col("similarity_score").alias("Similarity Score"), F.col("statement").alias("Statement"), F.col("node_count").alias("Node Count")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        results.write.mode("overwrite").json(path)


def json_log(log: DataFrame, kind: str, id_col: str = "id", data: str = "data") -> DataFrame:
    """Benchmark queries out of a JSON log: five paths, blanks instead of line ends, one kind only, by id. A row's text is parsed once,
    to a variant of which typed paths are read. Rows without JSON, or with another kind or none, go; paths that are absent give nulls;
    an expression that is an object, not its text, is written as JSON again, its keys in order."""
    at = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    flat = lambda p: F.trim(F.replace(at(p), F.lit("\n"), F.lit(" ")))
    rows = log.select(id_col, F.try_parse_json(data).alias("v")).where(at("commandSyntaxKind") == kind)
    return rows.select(id_col, flat("appFnName").alias("name"), flat("exactStxReprint").alias("tactic"), flat("mainGoalTypeStr").alias("goal"), at("mainGoalTypeJson").alias("expr_json")).orderBy(id_col)


def audit(theorems: DataFrame, target: str, n: int, ratio: float = 1.2) -> DataFrame:
    """One row: rows in all and in the target's size range, and whether the target is among them."""
    near = F.col("node_count").between(n / ratio, n * ratio)
    here = F.col("name") == target
    return theorems.agg(F.count("*").alias("total"), F.count_if(here).alias("found"), F.max(F.when(here, F.col("node_count"))).alias("target_nodes"), F.count_if(near).alias("in_range"), F.count_if(near & here).alias("found_in_range"))


def details(results: DataFrame, theorems: DataFrame) -> DataFrame:
    """Statement and size of each result; results without either go."""
    return results.join(theorems.select("name", "statement_str", "node_count"), "name").where("statement_str IS NOT NULL AND node_count IS NOT NULL")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def health(spark: SparkSession, *paths: str) -> dict[str, bool]:
    out = {"spark": spark.range(1).count() == 1}
    for p in paths:
        try:
            out[p] = bool(spark.read.parquet(p).columns)
        except Exception:  # noqa: BLE001  any failure means unhealthy
            out[p] = False
    return out
