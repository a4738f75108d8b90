"""Feature map, inverse frequencies, vectors, k-means on reduced vectors, cluster pruning with random top-up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import reduce, search

#: The numerator of the inverse frequency, and the frequency above which a feature has one; others weigh 1.
NUMERATOR, RARE = 330_000, 5


def document_frequency(enc: DataFrame) -> DataFrame:
    return enc.select(F.explode(F.map_keys("enc")).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))


def idf(df: DataFrame) -> DataFrame:
    return df.where(F.col("df") > RARE).withColumn("weight", F.log(F.lit(float(NUMERATOR)) / F.col("df")))


def feature_map(df: DataFrame, most: int = 5000) -> DataFrame:
    """The commonest features with index and weight; ties by name. The cut comes before the numbering, so one task sees `most` rows."""
    top = df.orderBy(F.desc("df"), F.asc("feature")).limit(most)
    at = F.row_number().over(Window.orderBy(F.desc("df"), F.asc("feature"))) - 1
    return top.withColumn("idx", at).withColumn("weight", F.when(F.col("df") > RARE, F.log(F.lit(float(NUMERATOR)) / F.col("df"))).otherwise(1.0))


def vector_entries(enc: DataFrame, features: DataFrame) -> DataFrame:
    """(name, idx, value): count times weight; features outside the map are left out."""
    return enc.select("name", F.explode("enc").alias("feature", "cnt")).join(features, "feature").select("name", "idx", (F.col("cnt") * F.col("weight")).alias("value"))


def entries_of(encs: pa.Array, known: pa.Array, absent: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place among the known features and count of each entry of an array of maps, in order."""
    at = encs.offsets.to_numpy()
    size = np.diff(at)
    if encs.null_count:
        size = np.where(encs.is_null().to_numpy(zero_copy_only=False), 0, size)
    row = np.repeat(np.arange(len(encs)), size)
    take = slice(int(at[0]), int(at[-1])) if not encs.null_count else np.arange(size.sum()) + np.repeat(at[:-1] - np.cumsum(size) + size, size)
    place = pc.index_in(encs.keys, known).fill_null(absent).to_numpy(zero_copy_only=False)[take].astype(np.int64)
    return row, place, encs.items.to_numpy(zero_copy_only=False)[take].astype(float)


def sparse_rows(enc: DataFrame, features: DataFrame) -> DataFrame:
    """reduce.sparse(vector_entries()) without moving a row: the features, a bounded number of them, go out to all tasks. Rows without
    a known feature are left out."""
    held = sorted((r["idx"], r["feature"], float(r["weight"])) for r in features.select("idx", "feature", "weight").toLocalIterator())
    known, idx, weight = pa.array([f for _, f, _ in held], pa.string()), np.array([i for i, _, _ in held], np.int32), np.array([w for _, _, w in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, value = entries_of(batch.column("enc"), known)
            row, at, value = row[at >= 0], at[at >= 0], value[at >= 0]
            order = np.lexsort((at, row))
            row, at, value = row[order], at[order], value[order]
            rows, n = np.unique(row, return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(idx[at], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value * weight[at], pa.float64()))], names=["name", "idx", "value"])

    return enc.select(F.col("name").cast("string"), "enc").where("enc IS NOT NULL").mapInArrow(run, "name string, idx array<int>, value array<double>")


@dataclass
class Model:
    """Feature map (feature, df, idx, weight), principal components of weighed counts, and centres in their space."""

    features: DataFrame
    components: reduce.Components
    centers: np.ndarray

    def reduced(self, enc: DataFrame) -> DataFrame:
        """(name, reduced) of encodings (name, enc); those without a known feature are left out."""
        return self.components.apply(sparse_rows(enc, self.features))

    def assign(self, enc: DataFrame) -> DataFrame:
        """(name, cluster_id) by the nearest centre."""
        return reduce.assigned(self.reduced(enc), self.centers).select("name", "cluster_id")


def fit(enc: DataFrame, features: int = 5000, dims: int = 200, k: int = 2000, seed: int = 42) -> tuple[Model, DataFrame]:
    """Feature map, randomised components and mini-batch k-means of encodings; and the reduced vectors, written."""
    chosen = written(feature_map(document_frequency(enc), features), "features")
    rows = written(sparse_rows(enc, chosen), "sparse")
    size = chosen.count()
    parts = reduce.components(rows, max(1, size), min(dims, max(1, size)), seed=seed)
    low = reduce.paged(parts.apply(rows), seed=seed)
    return Model(chosen, parts, reduce.mini_batch_means(low, k, seed=seed)), low


def cluster_counts(rows: DataFrame, by: str = "cluster_id") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last(by))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def nearest(centers: DataFrame, point: list[float], n: int = 5500) -> DataFrame:
    """cluster_id and distance of the n centers (cluster_id, center) nearest to a point, by distance then id."""
    far = F.sqrt(_distance(F.col("center"), F.array(*[F.lit(float(x)) for x in point])))
    return centers.select("cluster_id", far.alias("distance")).orderBy("distance", "cluster_id").limit(n)


def nearest_center(rows: DataFrame, centers: DataFrame, vector: str, block: int = 4096) -> DataFrame:
    """Add `nearest`, the id of the nearest center (cluster_id, center), of equals (to nine digits) the least id. Centers go out
    in blocks of at most `block` as one row each, so the plan is the same for any number of them up to a block."""
    blocks = max(1, -(-centers.count() // block))
    out = rows.withColumn("__best", F.lit(None).cast("struct<d:double,id:bigint>")).withColumn("__one", F.lit(0))
    at = F.pmod(F.hash("cluster_id"), F.lit(blocks))
    for b in range(blocks):
        held = centers.where(at == b).agg(F.collect_list(F.struct(F.col("cluster_id").cast("long").alias("id"), F.col("center").alias("c"))).alias("__centers")).withColumn("__one", F.lit(0))
        one = F.array_min(F.transform("__centers", lambda x: F.struct(F.round(_distance(F.col(vector), x["c"]), 9).alias("d"), x["id"].alias("id"))))
        out = out.join(F.broadcast(held), "__one").withColumn("__best", F.array_min(F.array_compact(F.array("__best", one)))).drop("__centers")
    return out.withColumn("nearest", F.col("__best.id")).drop("__best", "__one")


def pruned(corpus: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of the chosen clusters (a frame of cluster_id)."""
    return corpus.join(clusters, "cluster_id", "left_semi")


def outside(corpus: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of no cluster or of others."""
    return corpus.join(clusters, "cluster_id", "left_anti")


def sampled(rows: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """n rows in the order of a digest of seed and name: random, and the same whatever the partitions are."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("name").cast("string"))), "name").limit(n)


def with_top_up(corpus: DataFrame, clusters: DataFrame, top: int = 1500, sample: int = 5000, seed: int = 42) -> DataFrame:
    """The chosen clusters' rows, and a random sample of the others when those are under `top`."""
    chosen = pruned(corpus, clusters)
    if chosen.limit(top).count() >= top:
        return chosen
    return chosen.unionByName(sampled(outside(corpus, clusters), sample, seed))


def pruned_search(corpus: DataFrame, target: search.Target, clusters: DataFrame, top: int = 1500, sample: int = 5000, seed: int = 42, ratio: float | None = None) -> DataFrame:
    """Stage one over the chosen clusters of an encoded corpus with cluster_id. When they have under `top` rows in range, a
    random sample of the other rows in range joins them, of which only rows with a score above 0 count."""
    near = search.in_range(corpus, target, ratio)
    rows = search.with_cosine(pruned(near, clusters), target)
    if rows.limit(top).count() < top:
        rows = rows.unionByName(search.with_cosine(sampled(outside(near, clusters), sample, seed), target).where("wl > 0").select(*rows.columns))
    return rows.orderBy(F.desc("wl"), F.asc("name")).limit(top)


def samples(corpus: DataFrame, clusters: DataFrame) -> DataFrame:
    """The least row of each chosen cluster."""
    return pruned(corpus, clusters).groupBy("cluster_id").agg(F.min("name").alias("name"))


def save(model: Model, path: str) -> None:
    """Keep the feature map with its weights, the components and the centres."""
    spark = model.features.sparkSession
    model.features.write.mode("overwrite").parquet(f"{path}/features")
    model.components.save(spark, f"{path}/components")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.centers)], "cluster_id int, center array<double>").write.mode("overwrite").parquet(f"{path}/centers")


def load(spark: SparkSession, path: str) -> Model:
    centers = sorted(spark.read.parquet(f"{path}/centers").collect())
    return Model(spark.read.parquet(f"{path}/features"), reduce.Components.load(spark, f"{path}/components"), np.array([r["center"] for r in centers]))


def job(enc: DataFrame, path: str, features: int = 5000, dims: int = 200, k: int = 2000, seed: int = 42) -> DataFrame:
    """Fit, keep the model under `path`, and write (name, cluster_id), which is returned. Trees with an empty encoding are neither
    learned from nor assigned; they get a null id."""
    model, low = fit(enc.where(F.size("enc") > 0), features, dims, k, seed)
    save(model, path)
    ids = reduce.assigned(low, model.centers).select("name", "cluster_id")
    ids.join(enc.select("name"), "name", "right").write.mode("overwrite").parquet(f"{path}/clusters")
    return enc.sparkSession.read.parquet(f"{path}/clusters")


def choose(model: Model, target: search.Target, n: int = 5500) -> list[int]:
    """The ids of the n clusters nearest to a target, by distance then id."""
    one = model.features.sparkSession.createDataFrame([("", target.enc)], "name string, enc map<string,int>")
    row = model.reduced(one).first()
    point = np.array(row["reduced"]) if row else -model.components.offset
    far = np.round(((model.centers - point) ** 2).sum(1), 9)
    return [int(i) for i in np.argsort(far, kind="stable")[:n]]


def write_partitioned(rows: DataFrame, path: str, deal: bool = True) -> DataFrame:
    """Write a search table with cluster_id as inverted lists: a folder for each cluster, so that a search opens the chosen ones only,
    each sorted by size. A cluster of many rows is dealt out to several files, and small ones share a task. Without `deal`, for few clusters, no row moves
    and each task writes a file for each cluster it has."""
    even = (rows.hint("rebalance", "cluster_id") if deal else rows).sortWithinPartitions("cluster_id", "simp_node_count", "name")
    even.write.mode("overwrite").option("compression", "zstd").partitionBy("cluster_id").parquet(path)
    return rows.sparkSession.read.parquet(path)


def partitioned_search(table: DataFrame, target: search.Target, clusters: list[int], top: int = 1500, sample: int = 5000, seed: int = 42, ratio: float | None = None) -> DataFrame:
    """pruned_search() over a partitioned table: the ids are literals, so that Spark prunes the folders before it lists a file. Other
    clusters are read only when the chosen ones have under `top` rows in range."""
    near = search.in_range(table, target, ratio)
    rows = search.with_cosine(near.where(F.col("cluster_id").isin(clusters)), target)
    if sample and rows.limit(top).count() < top:
        rest = near.where(F.col("cluster_id").isNull() | ~F.col("cluster_id").isin(clusters))
        rows = rows.unionByName(search.with_cosine(sampled(rest, sample, seed), target).where("wl > 0").select(*rows.columns))
    return rows.orderBy(F.desc("wl"), F.asc("name")).limit(top)


def led(enc: DataFrame, leaders: DataFrame) -> DataFrame:
    """Add cluster_id, that of the leader (name, cluster_id and an encoding's columns) of greatest cosine, to nine digits, of equals the
    least name; null for trees that share nothing with any. Leaders go out to all tasks (they are few), and rows stay where they are."""
    held = sorted(((r["name"], r["cluster_id"], r["norm2"], dict(r["enc"])) for r in leaders.where("enc IS NOT NULL").select("name", "cluster_id", "norm2", "enc").toLocalIterator()), key=lambda r: r[0])
    if not held:
        return enc.withColumn("cluster_id", F.lit(None).cast("int"))
    features = list(dict.fromkeys(f for r in held for f in r[3]))
    place = {f: i for i, f in enumerate(features)}
    counts = np.zeros((len(features) + 1, len(held)))  # the last row is for features that no leader has
    for k, r in enumerate(held):
        counts[[place[f] for f in r[3]], k] = list(r[3].values())
    norms, known = np.sqrt([float(r[2]) for r in held]), pa.array(features, pa.string())

    @F.arrow_udf("array<double>")
    def cosines(encs: pa.Array, norm2: pa.Array) -> pa.Array:
        row, at, value = entries_of(encs, known, len(features))
        dots = np.zeros((len(encs), len(held)))
        begins = np.flatnonzero(np.r_[True, np.diff(row) > 0]) if len(row) else row
        if len(row):
            dots[row[begins]] = np.add.reduceat(value[:, None] * counts[at], begins, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            wl = np.clip(dots / (norms * np.sqrt(norm2.fill_null(0).to_numpy(zero_copy_only=False).astype(float))[:, None]), 0.0, 1.0)
        flat = pa.array(wl.ravel(), mask=dots.ravel() <= 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, wl.size + 1, len(held)), pa.int32()), flat)

    best = F.array_min(F.transform("__wl", lambda w, i: F.when(w.isNotNull(), F.struct((-F.round(w, 9)).alias("d"), i.alias("i")))))
    ids = F.array(*[F.lit(r[1]) for r in held])
    return enc.withColumn("__wl", cosines.asNondeterministic()("enc", "norm2")).withColumn("cluster_id", F.get(ids, best["i"])).drop("__wl")


def lead(enc: DataFrame, leaders: DataFrame) -> DataFrame:
    """(name, cluster_id) of led()."""
    return led(enc.select("name", "enc", "norm2"), leaders).select("name", "cluster_id")
