"""Line deduplication by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host when the share of the host's pages that hold it exceeds a ratio. Lines are compared
without blanks at their ends; lines of blanks only stay. A page counts once for a line however often it repeats it.
Lines are known by a 64-bit hash: only a clash with one of a host's few boilerplate lines could drop a wrong line.
Null text counts as empty, a null host as a host of its own. A page whose lines all go keeps its row, with empty text. Rows
that repeat count as pages of their own; a line just at the ratio stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Up to so many boilerplate lines in all, their table is broadcast (8 bytes each); beyond, it is joined by host and salt.
BROADCAST_LINES, SALTS = 1_000_000, 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """(host, lines): hashes of each host's boilerplate lines, at most the mean lines of a page / ratio of them.

    Shuffled are one row for each host and distinct line of a task, and then only lines on `least` pages.
    """
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = counts.join(totals, "host").where(F.col("n") > F.col("pages") * ratio)
    return frequent.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, least: int = 5) -> DataFrame:
    """All columns of docs with cleaned text, and __n_lines and __n_dropped. Lines on under `least` pages always stay.
    Inside, columns have names of their own, so that none of docs can clash."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0null"))
    text = F.col(text_col).cast("string")
    found = written(boilerplate(docs.select(host.alias("host"), text.alias("text")), ratio, least), "boilerplate")
    size = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], host.alias("host"), text.alias("text"))
    if size <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: F.col("lines").isNull() | (F.trim(x) == "") | ~F.array_contains(F.col("lines"), _key(x)))
    out = joined.withColumn("kept", kept).withColumn("n", F.size(lines))
    own = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return out.select(*own, F.col("n").alias("__n_lines"), (F.col("n") - F.size("kept")).alias("__n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, host, n_lines, n_dropped and the text without boilerplate lines."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    out = drop_boilerplate(rows, "host", "text", **how)
    return out.select("doc_id", "host", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_dropped").cast("long").alias("n_dropped"), "text")


LINE_DEDUP_SQL = """
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(source, chr(1)) AS h, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     each AS (SELECT r, doc_id, host, h, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM pages),
     counts AS (SELECT h, trim(line) AS line, count(DISTINCT r) AS n FROM each WHERE trim(line) <> '' GROUP BY ALL),
     totals AS (SELECT h, count(*) AS pages FROM pages GROUP BY h),
     bad AS (SELECT h, line FROM counts JOIN totals USING (h) WHERE n >= 5 AND n > pages * CAST(0.1 AS DOUBLE)),
     marked AS (SELECT e.*, b.line IS NOT NULL AS dropped FROM each e LEFT JOIN bad b ON e.h = b.h AND trim(e.line) = b.line)
SELECT any_value(doc_id) AS doc_id, any_value(host) AS host, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text
FROM marked GROUP BY r
"""
