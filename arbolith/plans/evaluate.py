"""Batch evaluation: each target's rank among its own search results, as report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import search


def summaries(scored: DataFrame) -> DataFrame:
    """One row for each query of (query, name, wl, similarity), in the shape of the evaluation CSV: its ten best, and the rank of
    the row of its own name. Ties in score share a rank and stand in order of name; a target below the cut isn't found."""
    best = F.desc("similarity")
    rows = scored.withColumn("rank", F.rank().over(Window.partitionBy("query").orderBy(best))).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(best, "name")))
    ten = F.array_sort(F.collect_list(F.when(F.col("place") <= 10, F.struct("place", "name", "similarity", "wl", "rank"))))
    out = rows.groupBy("query").agg(ten.alias("r"), F.min(F.when(F.col("name") == F.col("query"), F.col("rank"))).alias("rank"))
    text = lambda f: F.array_join(F.transform("r", f), "; ")
    return out.select(F.col("query").alias("Target Name"), text(lambda x: x["name"]).alias("Top 10 Names"), text(lambda x: F.format_string("%.4f", x["similarity"])).alias("Top 10 Edit Similarities"),
                      text(lambda x: F.format_string("%.4f", x["wl"])).alias("Top 10 WL Scores"), text(lambda x: x["rank"].cast("string")).alias("Top 10 Ranks"),
                      F.coalesce(F.col("rank").cast("string"), F.lit("Not found")).alias("Target Rank"), F.when(F.col("rank") <= 10, "Yes").otherwise("No").alias("Is Target in Top 10"))


def report(corpus: DataFrame, target: search.Target, name: str, top: int = 1500) -> DataFrame:
    """The row of one target."""
    return summaries(search.ranked(corpus, target, top).withColumn("query", F.lit(name)))


def report_many(corpus: DataFrame, queries: DataFrame, top: int = 1500) -> DataFrame:
    """The rows of many targets in one job. Targets without any candidate give a row too."""
    rows = summaries(search.batch_ranked(corpus, queries, top))
    out = queries.select(F.col("name").alias("Target Name")).join(rows, "Target Name", "left")
    missing = {"Target Rank": "Not found", "Is Target in Top 10": "No"}
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(missing.get(c, ""))).alias(c) for c in rows.columns])


def ranks(report_rows: DataFrame) -> DataFrame:
    """(target, rank) of report rows; null where the target wasn't found. For search.ir_metrics() and store.write_missing()."""
    return report_rows.select(F.col("Target Name").alias("target"), F.expr("try_cast(`Target Rank` as int)").alias("rank"))
