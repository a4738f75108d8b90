"""The search cascade: size range, histogram cosine, cut, re-rank, cut, details; one lazy plan for a query."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import wl
from . import compare, expr, topk

NODE = StructType([StructField("kind", StringType()), StructField("label", StringType()), StructField("depth", IntegerType()), StructField("parent", IntegerType()), StructField("children", ArrayType(IntegerType()))])
#: Targets of more unsimplified nodes than this are ranked without edit distance; from LARGE nodes on the range is wider.
EDIT_LIMIT, LARGE = 50, 600
#: The weights of cosine, edit similarity, collapse match and Jaccard in the final score.
COSINE, EDIT, COLLAPSE, JACCARD = 0.15, 0.40, 0.30, 0.15
#: Longest expression of a request, in characters.
LONGEST = 1000


def bounds(n: float, ratio: float = 1.5, diff: float = 25) -> tuple[float, float]:
    """The looser of a relative and an absolute window of node counts."""
    return max(0, min(n / ratio, n - diff)), max(n * ratio, n + diff)


def auto_ratio(node_count: int) -> float:
    return 1.8 if node_count >= LARGE else 1.2


def parse_trees(theorems: DataFrame, json_col: str = "expr_json", normalized: bool = True, bare: bool = False) -> DataFrame:
    """Add node_count, simp_node_count, nodes (simplified) and error. Rows that fail have a null tree and say why. With bare, nodes have
    nothing but labels."""
    node = StructType([StructField("label", StringType())]) if bare else NODE

    @F.arrow_udf(StructType([StructField("node_count", IntegerType()), StructField("nodes", ArrayType(node)), StructField("error", StringType())]))
    def read(texts: pa.Array) -> pa.Array:
        trees, counts, errors = expr.Packed(bare), [], []
        for t in texts.to_pylist():
            try:
                e = expr.parse(t)
                e = e if normalized else expr.normalize(e)
                trees.add(expr.drop_binders(e))
                counts.append(len(e.kind))
                errors.append(None)
            except Exception as x:  # noqa: BLE001  a malformed row is set apart, not the query's end
                trees.skip()
                counts.append(None)
                errors.append(f"{type(x).__name__}: {x}".encode(errors="replace").decode())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), trees.array(), pa.array(errors, pa.string())], ["node_count", "nodes", "error"])

    out = theorems.withColumn("__t", read.asNondeterministic()(json_col))
    return out.select(*theorems.columns, "__t.node_count", F.when(F.col("__t.nodes").isNotNull(), F.size("__t.nodes")).alias("simp_node_count"), "__t.nodes", "__t.error")


@dataclass
class Target:
    labels: list[str]
    kids: list[list[int]]
    enc: dict[str, int]
    norm2: int
    names: list[str]
    node_count: int
    nodes: list = field(default_factory=list)

    @classmethod
    def of(cls, tree: DataFrame, rounds: int = 3) -> Target:
        """From a frame of one tree (nodes, node_count)."""
        rows = wl.encode(tree, rounds).select("nodes", "node_count", "enc", "norm2", wl.const_names(F.col("nodes")).alias("names")).limit(1).collect()
        if not rows or rows[0]["nodes"] is None:
            raise ValueError("the target has no tree")
        r = rows[0]
        return cls([n["label"] for n in r["nodes"]], [list(n["children"]) for n in r["nodes"]], dict(r["enc"]), int(r["norm2"]), list(r["names"]), int(r["node_count"]), list(r["nodes"]))

    @classmethod
    def from_json(cls, spark, text: str, rounds: int = 3) -> Target:
        row = parse_trees(spark.createDataFrame([(text,)], "expr_json string"), normalized=False)
        return cls.of(row, rounds)

    @property
    def tree(self):
        return self.labels, self.kids


def in_range(corpus: DataFrame, target: Target, ratio: float | None = None, diff: float = 25) -> DataFrame:
    lo, hi = bounds(len(target.labels), ratio or auto_ratio(target.node_count), diff)
    return corpus.where(F.col("simp_node_count").between(lo, hi))


def with_cosine(corpus: DataFrame, target: Target) -> DataFrame:
    """Add dot, unless it is there, and wl."""
    d = corpus if "dot" in corpus.columns else corpus.withColumn("dot", wl.dot("enc", target.enc))
    return d.withColumn("wl", wl.cosine(F.col("dot"), F.col("norm2"), target.norm2))


def stage1(corpus: DataFrame, target: Target, top: int = 1500, ratio: float | None = None) -> DataFrame:
    return with_cosine(in_range(corpus, target, ratio), target).orderBy(F.desc("wl"), F.asc("name")).limit(top)


def dealt(rows: DataFrame, least: int = 16) -> DataFrame:
    """Deal out the few rows that a cut leaves in one partition, so that costly work on them runs in all tasks."""
    return rows.repartition(max(least, rows.sparkSession.sparkContext.defaultParallelism))


def pair_scores(corpus: DataFrame, target: Target, edit: bool) -> DataFrame:
    """Add collapse, collapse_match, jaccard and, if asked, ted."""
    t = target.tree

    @F.pandas_udf("collapse double, collapse_match boolean, ted double")
    def judge(labels: pd.Series, kids: pd.Series) -> pd.DataFrame:
        rows = []
        for a, k in zip(labels, kids, strict=True):
            c = (list(a), [list(x) for x in k])
            rows.append((compare.collapse_score(t, c), compare.collapse_match(t, c), compare.edit_distance(t, c) if edit else None))
        return pd.DataFrame(rows, columns=["collapse", "collapse_match", "ted"]).astype({"ted": float})

    out = dealt(corpus).withColumn("__s", judge.asNondeterministic()(F.expr("transform(nodes, n -> n.label)"), F.expr("transform(nodes, n -> n.children)")))
    names = F.array(*map(F.lit, target.names)) if target.names else F.expr("cast(array() as array<string>)")
    return out.select(*corpus.columns, "__s.*", wl.jaccard(names, wl.const_names(F.col("nodes"))).alias("jaccard"))


def legacy_distances(corpus: DataFrame, target: Target) -> DataFrame:
    """Add distance: the unit-cost edit distance, infinite beyond the size ratio."""

    @F.pandas_udf("double")
    def far(labels: pd.Series, kids: pd.Series) -> pd.Series:
        return pd.Series([compare.limited_distance(target.tree, (list(a), [list(x) for x in k])) for a, k in zip(labels, kids, strict=True)], dtype=float)

    return dealt(corpus).withColumn("distance", far(F.expr("transform(nodes, n -> n.label)"), F.expr("transform(nodes, n -> n.children)")))


def composite(target: Target, edit: bool) -> Column:
    score = COSINE * F.col("wl")
    if edit:
        score = score + EDIT * (1 - F.col("ted") / F.greatest(F.lit(len(target.labels)), F.col("simp_node_count")))
    return score + COLLAPSE * F.col("collapse") + JACCARD * F.col("jaccard")


def ranked(corpus: DataFrame, target: Target, top: int = 1500, ratio: float | None = None) -> DataFrame:
    edit = target.node_count <= EDIT_LIMIT
    return pair_scores(stage1(corpus, target, top, ratio), target, edit).withColumn("similarity", composite(target, edit))


def with_bound(corpus: DataFrame, target: Target) -> DataFrame:
    """Add collapse, jaccard and `bound`, the best similarity that the row can have: its score with a lower bound of the edit distance."""
    t = target.tree

    @F.pandas_udf("collapse double, least double")
    def judge(labels: pd.Series, kids: pd.Series) -> pd.DataFrame:
        rows = []
        for a, k in zip(labels, kids, strict=True):
            c = (list(a), [list(x) for x in k])
            rows.append((compare.collapse_score(t, c), compare.least_distance(t, c)))
        return pd.DataFrame(rows, columns=["collapse", "least"]).astype(float)

    out = dealt(corpus).withColumn("__s", judge.asNondeterministic()(F.expr("transform(nodes, n -> n.label)"), F.expr("transform(nodes, n -> n.children)")))
    names = F.array(*map(F.lit, target.names)) if target.names else F.expr("cast(array() as array<string>)")
    both = out.select(*corpus.columns, "__s.collapse", F.col("__s.least").alias("ted"), wl.jaccard(names, wl.const_names(F.col("nodes"))).alias("jaccard"))
    return both.withColumn("bound", composite(target, True)).drop("ted")


def with_distance(corpus: DataFrame, target: Target) -> DataFrame:
    """Add ted and similarity to rows of with_bound()."""

    @F.pandas_udf("double")
    def far(labels: pd.Series, kids: pd.Series) -> pd.Series:
        return pd.Series([compare.edit_distance(target.tree, (list(a), [list(x) for x in k])) for a, k in zip(labels, kids, strict=True)], dtype=float)

    out = dealt(corpus).withColumn("ted", far.asNondeterministic()(F.expr("transform(nodes, n -> n.label)"), F.expr("transform(nodes, n -> n.children)")))
    return out.withColumn("similarity", composite(target, True))


def best_ranked(corpus: DataFrame, target: Target, k: int, top: int = 1500, ratio: float | None = None, first: int = 48) -> tuple[DataFrame, int, int]:
    """The k best rows of ranked(), and how many edit distances were computed for how many rows.

    Distances are found for the rows of greatest bound first; the k-th best score among them is a bar that all others whose bound
    lies below it can't pass, so theirs are never computed. At most `top` rows are held.
    """
    near = stage1(corpus, target, top, ratio)
    if target.node_count > EDIT_LIMIT:
        return pair_scores(near, target, False).withColumn("similarity", composite(target, False)).orderBy(F.desc("similarity"), F.asc("name")).limit(k), 0, 0
    at = F.row_number().over(Window.orderBy(F.desc("bound"), F.asc("name")))
    rows = with_bound(near, target).withColumn("__at", at).persist()
    head = with_distance(rows.where(F.col("__at") <= max(first, 2 * k)), target).persist()
    bar = head.orderBy(F.desc("similarity")).limit(k).agg(F.count("*").alias("n"), F.min("similarity").alias("s")).first()
    rest = rows.where(F.col("__at") > max(first, 2 * k)).where(F.col("bound") >= (bar["s"] - 1e-9 if bar["n"] == k else float("-inf")))
    out = head.unionByName(with_distance(rest, target)).drop("__at", "bound").orderBy(F.desc("similarity"), F.asc("name")).limit(k)
    return out, head.count() + rest.count(), rows.count()


def check_request(k: int | None, node_ratio: float | None = None, expression: str | None = None) -> None:
    """ValueError for a request out of bounds; an expression, if given, must not be empty or too long."""
    if k is None or not 1 <= k <= 100:
        raise ValueError("k must lie between 1 and 100")
    if node_ratio is not None and not 1.0 <= node_ratio <= 2.0:
        raise ValueError("node_ratio must lie between 1.0 and 2.0")
    if expression is not None and not expression.strip():
        raise ValueError("the expression is empty")
    if expression is not None and len(expression) > LONGEST:
        raise ValueError(f"the expression is longer than {LONGEST} characters")


def search(corpus: DataFrame, target: Target, k: int = 20, node_ratio: float | None = None, top: int = 1500) -> DataFrame:
    """The k most similar trees: name, similarity_score, statement, node_count. Rows without details go after the cut."""
    check_request(k, node_ratio)
    best, _, _ = best_ranked(corpus, target, k, top, node_ratio)
    return best.where("statement_str IS NOT NULL AND node_count IS NOT NULL").select("name", F.col("similarity").alias("similarity_score"), F.col("statement_str").alias("statement"), "node_count")


def batch_cosine(corpus: DataFrame, queries: DataFrame, ratio: float | None = None, diff: float = 25, top: int | None = None, zeros: bool = False, **how) -> DataFrame:
    """(query, name, wl) for many queries (columns name, simp_node_count, node_count, norm2, enc) against a whole corpus: pairs in
    range that share a feature. With `top`, the best so many rows of each query and their equals are among them, and rows that no
    bound could rule out; the cut over all of them is the caller's. With `zeros`, queries of fewer pairs get rows that share nothing."""
    ranges = topk.window(F.col("simp_node_count"), F.col("node_count"), ratio, diff, LARGE, (1.2, 1.8))
    return topk.topk_join(corpus, queries, top, ranges, zeros, **how).where("query IS NOT NULL").drop("scored")


def batch_ranked(corpus: DataFrame, queries: DataFrame, top: int = 1500, ratio: float | None = None) -> DataFrame:
    """The whole cascade for many queries in one job: query, name, wl, ted (null for long queries), collapse, jaccard, similarity
    of each query's `top` rows by cosine (ties by name). Corpus and queries need nodes too."""
    tree = lambda p: [F.expr("transform(nodes, n -> n.label)").alias(f"{p}labels"), F.expr("transform(nodes, n -> n.children)").alias(f"{p}kids"), wl.const_names(F.col("nodes")).alias(f"{p}names"), F.col("simp_node_count").alias(f"{p}size")]
    pairs = batch_cosine(corpus, queries, ratio, top=top, zeros=True)
    near = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("wl"), "name"))).where(F.col("place") <= top).drop("place")
    both = near.join(corpus.select("name", *tree("")), "name").join(queries.select(F.col("name").alias("query"), (F.col("node_count") <= EDIT_LIMIT).alias("edit"), *tree("q")), "query")

    @F.pandas_udf("collapse double, ted double")
    def judge(ql: pd.Series, qk: pd.Series, labels: pd.Series, kids: pd.Series, edit: pd.Series) -> pd.DataFrame:
        rows = []
        for a, ka, b, kb, e in zip(ql, qk, labels, kids, edit, strict=True):
            t, c = (list(a), [list(x) for x in ka]), (list(b), [list(x) for x in kb])
            rows.append((compare.collapse_score(t, c), compare.edit_distance(t, c) if e else None))
        return pd.DataFrame(rows, columns=["collapse", "ted"]).astype(float)

    n = corpus.sparkSession.sparkContext.defaultParallelism
    both = both.repartition(max(16, n), "query", "name").withColumn("s", judge.asNondeterministic()("qlabels", "qkids", "labels", "kids", "edit"))
    out = both.select("query", "name", "wl", F.when(F.col("edit"), F.col("s.ted")).alias("ted"), "s.collapse", wl.jaccard(F.col("qnames"), F.col("names")).alias("jaccard"), "size", "qsize")
    edit = F.when(F.col("ted").isNotNull(), EDIT * (1 - F.col("ted") / F.greatest("qsize", "size"))).otherwise(0.0)
    return out.withColumn("similarity", COSINE * F.col("wl") + edit + COLLAPSE * F.col("collapse") + JACCARD * F.col("jaccard")).drop("size", "qsize")


def competition_rank(scored: DataFrame, score: str = "wl", by: str = "query") -> DataFrame:
    return scored.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc(score))))


def ir_metrics(ranks: DataFrame) -> DataFrame:
    """One row of Recall, Precision, F1 and nDCG at 1, 5 and 10, and MRR; a null rank counts in the denominator only."""
    n, cols = F.count("*"), []
    for k in (1, 5, 10):
        hit = F.col("rank") <= k
        f1 = 2 * (1 / k) / (1 + 1 / k)
        for name, v in (("recall", F.lit(1.0)), ("precision", F.lit(1.0 / k)), ("f1", F.lit(f1)), ("ndcg", 1 / F.log2(F.col("rank") + 1))):
            cols.append((F.sum(F.when(hit, v).otherwise(0.0)) / n).alias(f"{name}_{k}"))
    return ranks.agg(*cols, (F.sum(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)) / n).alias("mrr"))


def display(best: DataFrame) -> DataFrame:
    """One row: names and 4-digit scores of the best ten, joined by '; '."""
    ten = best.select(F.struct((-F.col("similarity")).alias("s"), "name", "wl").alias("r")).orderBy("r.s", "r.name").limit(10)
    rows = ten.agg(F.array_sort(F.collect_list("r")).alias("r"))
    join = lambda f: F.array_join(F.transform("r", f), "; ")
    return rows.select(join(lambda x: x["name"]).alias("names"), join(lambda x: F.format_string("%.4f", -x["s"])).alias("similarities"), join(lambda x: F.format_string("%.4f", x["wl"])).alias("wl_scores"))


def load_json(path: str) -> str:
    """The expression of a parsed-query document {input_str, expr_dbg, your_expr, expr_cse_json}, or of a bare expression."""
    with open(path) as f:
        doc = json.load(f)
    found = doc.get("your_expr", doc)
    return found if isinstance(found, str) else json.dumps(found)
