"""Functions for SQL: register() makes them callable from spark.sql() and expr().

tree_parse(json)                 nodes of an expression after all rewrites; null if it can't be read
tree_normalize(json)             the expression with binders named and shared parts lifted, as JSON
tree_edit_distance(a, b)         between two arrays of nodes; tree_unit_distance(a, b) with unit costs, infinite beyond a ratio of sizes
tree_collapse(a, b)              share of b's nodes that match a
wl_encode(nodes)                 histogram of three rounds; wl_dot(e, f), wl_norm2(e), wl_cosine(e, f) of histograms: plain SQL
wl_ratio(dot, m, n)              the cosine of a dot product and two squared lengths that are known: plain SQL
tree_nodes(TABLE(SELECT name, json ...))  table function: a row for each node of each text (name, id, kind, label, depth, parent)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..operators import compare, expr
from ..operators.search import NODE
from .wl_batch import histograms

ROUNDS = 3


def _read(text: str | None, form):
    try:
        return form(expr.drop_binders(expr.normalize(expr.parse(text)))) if text else None
    except Exception:  # noqa: BLE001  what can't be read is null, as with try_ functions
        return None


def _nodes(text: str | None) -> list[dict] | None:
    return _read(text, expr.pack)


def _tree(nodes):
    return [n["label"] for n in nodes], [list(n["children"]) for n in nodes]


def _pairs(f):
    """A pandas function of two trees; null if either is."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or not len(x) or not len(y) else f(_tree(x), _tree(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    return of


class TreeNodes:
    """eval() gets Arrow batches of (name, json) rows: a row of output for each node of each text. Texts that can't be read give none."""

    def eval(self, rows: pa.RecordBatch):
        names, labels, kinds, depths, parents, ids = rows.column(0), [], [], [], [], []
        size, seen = np.zeros(rows.num_rows, np.int64), {}
        for at, text in enumerate(rows.column(1).to_pylist()):
            found = _read(text, lambda e: (e.kind, expr.labels(e, seen), *expr.places(e)))
            if found is None:
                continue
            kind, label, depth, parent = found
            kinds += kind
            labels += label
            depths += depth
            parents += parent
            ids += range(len(kind))
            size[at] = len(kind)
        ints = lambda x: pa.array(x, pa.int32())
        name = names.cast(pa.string()).take(pa.array(np.repeat(np.arange(len(size)), size)))
        yield pa.table({"name": name, "id": ints(ids), "kind": pa.array(kinds, pa.string()), "label": pa.array(labels, pa.string()), "depth": ints(depths), "parent": ints(parents)})


# Plain SQL: a call is put into the plan as an expression, so nothing leaves the JVM. Two maps are matched by hash, once for a cosine;
# looking up each key would search the other map from its front.
SQL = {
    "wl_dot": ("e MAP<STRING, INT>, f MAP<STRING, INT>", "BIGINT", "aggregate(map_values(map_zip_with(e, coalesce(f, CAST(map() AS MAP<STRING, INT>)), (k, x, y) -> CAST(x AS BIGINT) * y)), CAST(0 AS BIGINT), (s, x) -> s + coalesce(x, 0))"),
    "wl_norm2": ("e MAP<STRING, INT>", "BIGINT", "aggregate(map_values(e), CAST(0 AS BIGINT), (s, x) -> s + CAST(x AS BIGINT) * x)"),
    "wl_ratio": ("dot BIGINT, m BIGINT, n BIGINT", "DOUBLE", "greatest(0.0D, least(1.0D, coalesce(dot / nullif(sqrt(m) * sqrt(n), 0.0D), 0.0D)))"),
    "wl_cosine": ("e MAP<STRING, INT>, f MAP<STRING, INT>", "DOUBLE", "CASE WHEN e IS NULL OR f IS NULL THEN NULL ELSE greatest(0.0D, least(1.0D, coalesce(wl_dot(e, f) / nullif(sqrt(wl_norm2(e)) * sqrt(wl_norm2(f)), 0.0D), 0.0D))) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions of this module with a session; their names."""
    nodes = ArrayType(NODE)

    @F.pandas_udf(nodes)
    def tree_parse(text: pd.Series) -> pd.Series:
        return text.map(_nodes)

    @F.pandas_udf("string")
    def tree_normalize(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return expr.dump(expr.normalize(expr.parse(t))) if t else None
            except Exception:  # noqa: BLE001
                return None

        return text.map(one)

    @F.arrow_udf("map<string,int>")
    def wl_encode(trees: pa.Array) -> pa.Array:
        return histograms(trees, ROUNDS)

    functions = {"tree_parse": tree_parse, "tree_normalize": tree_normalize, "wl_encode": wl_encode}
    functions |= {k: F.pandas_udf(_pairs(f), "double") for k, f in (("tree_edit_distance", compare.edit_distance), ("tree_unit_distance", compare.limited_distance), ("tree_collapse", compare.collapse_score))}
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("tree_nodes", F.arrow_udtf(TreeNodes, returnType="name string, id int, kind string, label string, depth int, parent int"))
    for name, (args, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return [*functions, "tree_nodes", *SQL]
