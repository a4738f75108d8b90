"""Queries of this subpackage over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention, jaccard, leaks, licenses, lines, packing, phrases, pieces, quality, quotes, runs, secrets, toxicity
from .files import tokenizer


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op3_sentencepiece(spark, sf_dir):
    return pieces.encode_pieces(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_bit_packing(spark, sf_dir):
    return packing.read_documents(packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2))


def op5_attention_scores(spark, sf_dir):
    return attention.score_documents(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return leaks.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return lines.line_dedup(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_quotation_linking(spark, sf_dir):
    return quotes.link_quotes(_read(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark, sf_dir):
    return runs.periodic_runs(_read(spark, sf_dir, "documents"), rewrite=runs.repeat_tail)


def op12_phrase_mining(spark, sf_dir):
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": lines.LINE_DEDUP_SQL, "op12_phrase_mining": phrases.COLLOCATIONS_SQL}
