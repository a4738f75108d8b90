"""A corpus pipeline: quality rules, line dedup, one document of each near-duplicate class, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame with the columns of documents, the last one
the digests of its ids. run() writes each stage's result as Parquet in the shared folder and reads it again.
SQL can't express trained trees, chosen paths or the tokenizer, so ORACLE_SQL is None; tests hold stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbolith.llm import jaccard, leaks, lines, pieces, quality
from arbolith.llm.files import tokenizer
from arbolith.sources.shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = lines.drop_boilerplate(docs)
    return out.select(*[F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else c for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one of least id stays."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the kept texts: number and digests."""
    return pieces.encode_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
