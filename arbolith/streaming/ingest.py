"""Continuous ingestion: JSON expressions arrive as files, are parsed and encoded row by row, and appended."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import wl
from ..operators.search import parse_trees
from ..sources.store import has_json


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, rounds: int = 3) -> StreamingQuery:
    """Stateless, so exactly once with the file sink; rows that fail to parse go to `sink`/errors."""
    rows = spark.readStream.schema("name STRING, expr_json STRING, statement_str STRING").json(source).where(has_json("expr_json"))

    def append(batch, number):
        parsed = parse_trees(batch).withColumn("batch", F.lit(number)).persist()
        good = wl.encode(parsed.where("error IS NULL").drop("error"), rounds)
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{sink}/trees")  # a repeated batch replaces itself
        parsed.where("error IS NOT NULL").select("name", "error", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{sink}/errors")
        parsed.unpersist()

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
