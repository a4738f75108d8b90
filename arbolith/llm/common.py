"""Shared pieces: words, rows through Arrow, sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, in UTF-8: bytes.split() knows just the six blanks \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "replace").split() if text else []


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable]) -> DataFrame:
    """Apply a function of whole Arrow batches. start() runs once in each task and gives batch -> dict of columns."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; all others, clashing names too, stay out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def tree_sum(parts: DataFrame, width: int, fan: int = 16) -> np.ndarray | None:
    """Sum of arrays (k, blob of float64) of width numbers, in rounds of groups of up to `fan`, so that the driver gets four at most."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in table["blob"]:
            total += np.frombuffer(x.as_py())
        return pa.table({"k": pa.array([table["k"][0].as_py() // fan], pa.int64()), "blob": [total.tobytes()]})

    parts = written(parts, "parts")
    while parts.count() > 4:
        parts = written(parts.groupBy(F.floor(F.col("k") / fan).alias("g")).applyInArrow(add, "k long, blob binary"), "parts")
    rows = parts.collect()
    return np.sum([np.frombuffer(r["blob"]) for r in rows], axis=0) if rows else None


def slab_sum(parts: DataFrame, fan: int = 16) -> list[tuple[int, bytes]]:
    """Sums of arrays (slab, k, blob of float64) by slab, in rounds of groups of up to `fan` tasks k, so that no task and no
    message is longer than `fan` slabs. The driver gets one blob for each slab."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in table["blob"]], axis=0)
        return pa.table({"slab": table["slab"].slice(0, 1), "k": pa.array([table["k"][0].as_py() // fan], pa.int64()), "blob": [total.tobytes()]})

    parts = written(parts, "parts")
    tasks = (parts.agg(F.max("k")).first()[0] or 0) + 1
    while tasks > 1:
        parts = written(parts.groupBy("slab", F.floor(F.col("k") / fan).alias("g")).applyInArrow(add, "slab long, k long, blob binary"), "parts")
        tasks = -(-tasks // fan)
    return [(r["slab"], r["blob"]) for r in parts.toLocalIterator()]
