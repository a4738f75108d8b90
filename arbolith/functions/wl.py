"""Weisfeiler-Leman labels, histograms and kernels as Column functions over packed trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wl_batch import NAMED, NODES, dots, histograms, slices


def initial(kind: Column, label: Column, depth: Column) -> Column:
    return F.concat(F.when(kind.isin(*NAMED), kind).otherwise(label), F.lit("_d"), depth.cast("string"))


def initial_labels(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: initial(n["kind"], n["label"], n["depth"]))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def next_labels(nodes: Column, labels: Column) -> Column:
    """One round: md5 of the own label and the sorted labels of the children."""

    def one(n: Column, i: Column) -> Column:
        below = F.array_join(F.sort_array(F.transform(n["children"], lambda c: F.get(labels, c))), ",")
        own = F.get(labels, i)
        return F.md5(F.when(F.size(n["children"]) == 0, own).otherwise(F.concat(own, F.lit("("), below, F.lit(")"))))

    return F.transform(nodes, one)


#: Labels up to which they are counted by looking each one up, which has less overhead for few than going through runs.
FEW = 128


def counted(labels: Column, prefix: str = "") -> Column:
    """Entries (label with prefix, count) of an array, from the sorted labels: the places where each label begins."""

    def entries(s: Column, d: Column, at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(s) + 1)
        return F.transform(d, lambda x, k: F.struct(F.concat(F.lit(prefix), x).alias("key"), (end(k) - F.get(at, k)).cast("int").alias("value")))

    def few(s: Column) -> Column:
        return let(F.array_distinct(s), lambda d: let(F.transform(d, lambda x: F.array_position(s, x)), lambda at: entries(s, d, at)))

    def many(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1).cast("bigint"), F.size(s).cast("bigint")), lambda i: (i == 1) | (F.get(s, i.cast("int") - 1) != F.get(s, i.cast("int") - 2)))
        return let(F.array_distinct(s), lambda d: let(first, lambda at: entries(s, d, at)))

    none = F.expr("cast(array() as array<struct<key:string,value:int>>)")
    return let(F.sort_array(labels), lambda s: F.when(F.size(s) == 0, none).when(F.size(s) <= FEW, few(s)).otherwise(many(s)))


def depth_of(nodes: Column) -> Column:
    return F.coalesce(F.array_max(nodes["depth"]), F.lit(0))


def histogram(nodes: Column, rounds: int) -> Column:
    """Entries of the hashed rounds up to the depth; raw labels don't count."""

    def step(n: Column, depth: Column, labels: Column, r: int) -> Column:
        if r == rounds:
            return F.expr("cast(array() as array<struct<key:string,value:int>>)")
        new = F.when(depth > r, next_labels(n, labels)).otherwise(F.expr("cast(array() as array<string>)"))
        return let(new, lambda x: F.concat(counted(x, f"{r}_"), step(n, depth, x, r + 1)))

    return let(nodes, lambda n: let(depth_of(n), lambda d: let(initial_labels(n), lambda x: step(n, d, x, 0))))


def encode(trees: DataFrame, rounds: int = 3, nodes: str = "nodes") -> DataFrame:
    """Add enc (map feature -> count), norm2 and tree_depth. Row-local: no shuffle. Equal to histogram(), in Arrow batches.
    Each tree is encoded once, whatever reads enc; so filters aren't moved before it, and belong there."""

    @F.arrow_udf("map<string,int>")
    def enc(batch: pa.Array) -> pa.Array:
        return pa.concat_arrays([histograms(part, rounds) for part in slices(batch)] or [histograms(batch, rounds)])

    out = trees.withColumn("tree_depth", depth_of(F.col(nodes))).withColumn("enc", enc.asNondeterministic()(F.col(nodes)))
    return out.withColumn("norm2", F.aggregate(F.map_values("enc"), F.lit(0).cast("bigint"), lambda s, v: s + v.cast("bigint") * v))


def with_dots(trees: DataFrame, target: list, rounds: int = 3, nodes: str = "nodes") -> DataFrame:
    """Add dot, with the encoding of a target (its nodes), and norm2: what encode() and dot() give, without any encoding."""
    one = pa.array([[n.asDict() for n in target]], NODES)

    @F.arrow_udf("struct<dot:bigint,norm2:bigint>")
    def score(batch: pa.Array) -> pa.Array:
        found = [dots(part, one, rounds) for part in slices(batch)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int64()) for k in (0, 1)], ["dot", "norm2"])

    return trees.withColumn("__s", score.asNondeterministic()(nodes)).select(*trees.columns, "__s.*")


def label_counts(nodes: Column, rounds: int) -> Column:
    """A map of the raw labels (as round 0) and of those of each round, whatever the depth, in Arrow batches."""

    @F.arrow_udf("map<string,int>")
    def count(batch: pa.Array) -> pa.Array:
        return histograms(batch, rounds, raw=True)

    return count.asNondeterministic()(nodes)


def dot(enc: str, target: dict[str, int]) -> Column:
    """Dot product with a fixed histogram, which stays a literal of the plan: a set of features for each count, for a map is searched
    from its front. A tree of n nodes has no more than about sqrt(2n) different counts in a round."""
    if not target:
        return F.lit(0).cast("bigint")
    by_count: dict[int, list[str]] = {}
    for feature, n in target.items():
        by_count.setdefault(n, []).append(feature)

    def times(e: Column) -> Column:
        out = F.when(F.lit(False), 0)
        for n, features in sorted(by_count.items()):
            out = out.when(e["key"].isin(*features), n)
        return out.otherwise(0)

    shared = F.filter(F.map_entries(enc), lambda e: e["key"].isin(*target)) if len(by_count) > 1 else F.map_entries(enc)
    return F.aggregate(shared, F.lit(0).cast("bigint"), lambda s, e: s + e["value"].cast("bigint") * times(e))


def cosine(dot_: Column, norm2: Column, target_norm2: int) -> Column:
    """0 where either side is empty or they share nothing; the operand order keeps exact ties."""
    value = dot_ / (F.sqrt(norm2) * F.sqrt(F.lit(float(target_norm2))))
    return F.when((dot_ == 0) | (norm2 == 0) | F.lit(target_norm2 == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def const_names(nodes: Column) -> Column:
    """Distinct first name segments of the constants, without instances."""
    labels = F.filter(F.transform(nodes, lambda n: n["label"]), lambda x: x.startswith("Const("))

    def name(x: Column) -> Column:
        seen = F.regexp_extract(x, r"^Const\(([\p{L}\p{N}_]+)", 1)
        rest = F.when(F.locate(",", x) > 0, F.trim(x.substr(F.lit(7), F.locate(",", x) - 7))).otherwise(F.lit(""))
        return F.when(seen == "", rest).when(seen.contains("inst"), F.lit("")).otherwise(seen)

    return F.sort_array(F.array_distinct(F.filter(F.transform(labels, name), lambda x: x != "")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def pretty(nodes: Column) -> Column:
    """A line for each node, indented by its depth; nodes stand in pre-order."""
    return F.array_join(F.transform(nodes, lambda n: F.concat(F.repeat(F.lit("  "), n["depth"]), n["label"])), "\n")
