"""Randomised components and mini-batch k-means against numpy and the library's k-means."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbolith.operators import reduce


def low_rank(rng, n=1200, features=90, rank=6):
    x = rng.standard_normal((n, rank)) * (10.0 / 2.0 ** np.arange(rank)) @ np.linalg.qr(rng.standard_normal((features, rank)))[0].T
    x = x + 0.01 * rng.standard_normal((n, features)) + 1.0
    x[rng.random((n, features)) < 0.15] = 0.0
    return x


def as_rows(spark, x):
    return spark.createDataFrame([(f"n{i:05d}", np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)], "name string, idx array<int>, value array<double>").repartition(5)


def test_components(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(reduce, "SLAB", 128)
    monkeypatch.setattr(reduce, "FAN", 2)
    monkeypatch.setattr(reduce, "BLOCK", 100)
    x = low_rank(np.random.default_rng(1))
    rows = as_rows(spark, x)
    got = reduce.components(rows, 90, 4, passes=5)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    want = vectors[:, ::-1][:, :4]
    assert np.allclose(got.mean, x.mean(0)) and np.allclose(got.variance, values[::-1][:4], rtol=1e-2)
    assert np.linalg.svd(want.T @ got.directions)[1].min() > 0.99
    reduced = {r["name"]: r["reduced"] for r in got.apply(rows).collect()}
    assert np.allclose(np.array([reduced[f"n{i:05d}"] for i in range(len(x))]), centred @ got.directions)
    got.save(spark, str(tmp_path / "c"))
    again = reduce.Components.load(spark, str(tmp_path / "c"))
    assert np.allclose(again.directions, got.directions) and np.allclose(again.variance, got.variance)


def test_sparse(spark):
    df = spark.createDataFrame([("a", 5, 2.0), ("a", 1, 1.0), ("b", 0, 3.0)], "name string, idx int, value double")
    assert {r["name"]: (r["idx"], r["value"]) for r in reduce.sparse(df).collect()} == {"a": ([1, 5], [1.0, 2.0]), "b": ([0], [3.0])}


def test_mini_batch_means(spark):
    """The objective is within 2 % of full k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    middles = rng.standard_normal((25, 6)) * 6
    x = middles[rng.integers(25, size=3000)] + rng.standard_normal((3000, 6))
    df = spark.createDataFrame([(f"n{i:05d}", r.tolist()) for i, r in enumerate(x)], "name string, reduced array<double>").repartition(6).cache()
    centers = reduce.mini_batch_means(df, 25, pages=4, rounds=4)
    rows = reduce.assigned(df, centers).toPandas()
    mine = rows["distance2"].sum()
    best = min(KMeans(k=25, seed=s, maxIter=30).fit(df.select(array_to_vector("reduced").alias("features"))).summary.trainingCost for s in (1, 2, 3))
    assert len(centers) == 25 and mine < 1.02 * best
    full = ((x[:, None] - centers[None]) ** 2).sum(2)
    at = rows.sort_values("name")["cluster_id"].to_numpy()
    assert (at == full.argmin(1)).all()
    assert np.allclose(reduce.mini_batch_means(df.repartition(3), 25, pages=4, rounds=4), centers)


def test_edges(spark):
    none = spark.createDataFrame([], "name string, reduced array<double>")
    assert reduce.mini_batch_means(none, 3).shape == (0, 0)
    same = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(9)], "name string, reduced array<double>")
    centers = reduce.mini_batch_means(same, 4, pages=2)
    assert centers.tolist() == [[1.0, 2.0]] and set(reduce.assigned(same, centers).toPandas()["cluster_id"]) == {0}
    empty = spark.createDataFrame([], "name string, idx array<int>, value array<double>")
    assert reduce.components(empty, 5, 2).directions.shape == (5, 2)
    assert reduce.summed(same.where(F.lit(False)), lambda b: iter(()), 3).tolist() == [0, 0, 0]
    assert pytest.approx(0) == reduce.nearest(np.ones((1, 2)), np.ones((3, 2)))[1][0]


def test_columns(monkeypatch):
    """Features that always occur together are one column of the work; products are those of the whole matrix."""
    rng = np.random.default_rng(5)
    m = np.where(rng.random((300, 40)) < 0.05, rng.random((300, 40)), 0.0)
    m[:, :4], m[:, 10:14], m[7] = rng.random((300, 4)), m[:, 14:15], 0.0
    rows = [np.flatnonzero(r) for r in m]
    lists = [pa.array([x.tolist() for x in rows], pa.list_(pa.int32())), pa.array([r[x].tolist() for r, x in zip(m, rows, strict=True)], pa.list_(pa.float64()))]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(300)]), *lists], names=["name", "idx", "value"]).slice(3, 290)
    q, m = rng.random((40, 6)), m[3:293]
    for entries in (7, 256):
        monkeypatch.setattr(reduce, "ENTRIES", entries)
        c = reduce.Columns(batch)
        assert len(c.dense) == len(c.features) - 4 and 4 <= c.dense.sum() < 36
        assert np.allclose(c.times(q), m @ q)
        assert np.allclose(c.back(m @ q), (m.T @ (m @ q))[c.features])


def test_nearest_in_single_precision():
    """Centres that only double precision tells apart, equal ones, and numbers too great for single precision."""
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((50, 20))
    centers[9], centers[20] = centers[3], centers[30] + 1e-9
    x = np.r_[centers, centers + 1e-6 * rng.standard_normal((50, 20)), rng.standard_normal((500, 20))]
    for scale in (1.0, 1e25):
        far = ((x[:, None] - centers) ** 2).sum(2)
        at, d = reduce.nearest(x * scale, centers * scale)
        assert np.allclose(np.sqrt(d) / scale, np.sqrt(far.min(1)), atol=1e-6) and 9 not in at
        assert (at[100:] == far[100:].argmin(1)).all()
