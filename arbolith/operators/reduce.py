"""Randomised principal components of sparse rows, and mini-batch k-means: both as sums over blocks of rows.

Rows are (name, idx array<int>, value array<double>). A task holds one batch of rows at a time, restricted to the features in it;
what tasks make are sums of a size that follows from the model (features x directions, centres x directions), not from the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, fresh, written
from .topk import leads

#: Rows of a block of matrix work; numbers of a slab in which sums meet; slabs that are summed at once.
BLOCK, SLAB, FAN = 1024, 1 << 16, 32
#: The part of a batch's rows above which a column is dense; entries of other columns that are added at once.
DENSE, ENTRIES = 1 / 32, 256


def sparse(entries: DataFrame) -> DataFrame:
    """(name, idx, value) arrays out of (name, idx, value) rows."""
    own = entries.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("e"))
    return own.select("name", F.col("e.idx").cast("array<int>").alias("idx"), F.col("e.value").cast("array<double>").alias("value"))


def summed(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int) -> np.ndarray:
    """The sum of arrays of `width` numbers that `work` makes of batches. Tasks add up their own; slabs of their sums meet in
    rounds of groups of at most FAN tasks, and the driver gets each slab once. Addition goes in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for b in batches:
            for part in work(b):
                total += part.ravel()
        task = TaskContext.get().partitionId()
        for k in range(0, width, SLAB):
            yield pa.RecordBatch.from_pydict({"slab": pa.array([k // SLAB], pa.int64()), "task": pa.array([task], pa.int64()), "blob": [total[k : k + SLAB].tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total = np.sum([np.frombuffer(x.as_py()) for x in table["blob"]], axis=0)
        return pa.table({"slab": table["slab"].slice(0, 1), "task": pa.array([table["task"][0].as_py() // FAN], pa.int64()), "blob": [total.tobytes()]})

    made = [written(rows.mapInArrow(run, "slab long, task long, blob binary"), "sums")]
    tasks = (made[0].agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        made.append(written(made[-1].groupBy("slab", F.floor(F.col("task") / FAN).alias("g")).applyInArrow(add, "slab long, task long, blob binary"), "sums"))
        tasks = -(-tasks // FAN)
    out = np.zeros(width)
    for r in made[-1].toLocalIterator():
        out[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = np.frombuffer(r["blob"])
    for m in made:
        forget(m)
    return out


class Columns:
    """A batch of sparse rows by columns. Features with the same values in the same rows are one column; columns of more than a DENSE
    part of the rows are a matrix, and the others entries."""

    def __init__(self, batch: pa.RecordBatch):
        size = np.fromiter((len(x) if x.is_valid else 0 for x in batch.column("idx")), np.int64, batch.num_rows) if batch.column("idx").null_count else np.diff(batch.column("idx").offsets.to_numpy())
        idx, value = batch.column("idx").flatten().to_numpy(zero_copy_only=False), batch.column("value").flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(idx, kind="stable")
        row, value = np.repeat(np.arange(batch.num_rows), size)[order], value[order]
        features, begins = np.unique(idx[order], return_index=True)
        begins = np.r_[begins, len(row)]
        columns, column = np.unique(leads(begins, row, value), return_inverse=True)
        n = (begins[1:] - begins[:-1])[columns]
        self.dense = n > DENSE * batch.num_rows
        self.matrix = np.zeros((batch.num_rows, int(self.dense.sum())))
        for i, c in enumerate(columns[self.dense].tolist()):
            span = slice(begins[c], begins[c + 1])
            self.matrix[row[span], i] = value[span]
        n = n[~self.dense]
        at = np.arange(n.sum()) + np.repeat(begins[columns[~self.dense]] - np.cumsum(n) + n, n)
        self.features, self.column = features.astype(np.int64), column.ravel()
        self.row, self.value, self.entry = row[at], value[at], np.repeat(np.flatnonzero(~self.dense), n)
        self.by_row = np.argsort(self.row, kind="stable")

    def _added(self, out: np.ndarray, to: np.ndarray, of: np.ndarray, value: np.ndarray, rows: np.ndarray) -> None:
        """Add rows[of] times value to out at `to`, which ascends, some entries at once."""
        for k in range(0, len(to), ENTRIES):
            part = slice(k, k + ENTRIES)
            begins = np.flatnonzero(np.r_[True, to[part][1:] != to[part][:-1]])
            out[to[part][begins]] += np.add.reduceat(rows[of[part]] * value[part][:, None], begins, axis=0)

    def times(self, q: np.ndarray) -> np.ndarray:
        """The rows times the features' rows of q."""
        order = np.argsort(self.column, kind="stable")
        own = np.add.reduceat(q[self.features[order]], np.searchsorted(self.column[order], np.arange(len(self.dense))), axis=0) if len(order) else np.zeros((0, q.shape[1]))
        out = self.matrix @ own[self.dense]
        self._added(out, self.row[self.by_row], self.entry[self.by_row], self.value[self.by_row], own)
        return out

    def back(self, y: np.ndarray) -> np.ndarray:
        """The transposed rows times y: a row for each of `features`."""
        out = np.zeros((len(self.dense), y.shape[1]))
        out[self.dense] = self.matrix.T @ y
        self._added(out, self.entry, self.row, self.value, y)
        return out[self.column]


class Components:
    """The mean of rows and the directions of greatest variance, as columns."""

    def __init__(self, mean: np.ndarray, directions: np.ndarray, variance: np.ndarray):
        self.mean, self.directions, self.variance = mean, directions, variance
        self.offset = mean @ directions

    def apply(self, rows: DataFrame) -> DataFrame:
        """(name, reduced array<double>)."""
        directions, offset = self.directions, self.offset

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y = Columns(b).times(directions) - offset
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("name"), lists], names=["name", "reduced"])

        return rows.select("name", "idx", "value").mapInArrow(run, "name string, reduced array<double>")

    def save(self, spark, path: str) -> None:
        """A row for each feature: its mean and its part of all directions; and the variances under index -1."""
        rows = [(-1, 0.0, self.variance.tolist())] + [(i, float(self.mean[i]), d.tolist()) for i, d in enumerate(self.directions)]
        spark.createDataFrame(rows, "idx int, mean double, direction array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Components:
        rows = sorted(spark.read.parquet(path).collect())
        return cls(np.array([r["mean"] for r in rows[1:]]), np.array([r["direction"] for r in rows[1:]]), np.array(rows[0]["direction"]))


def components(rows: DataFrame, features: int, dims: int, over: int = 10, passes: int = 3, seed: int = 42) -> Components:
    """Randomised subspace iteration: random directions go through the covariance `passes` times, orthonormal in between, and
    one pass more gives the covariance within their space. The driver holds features x (dims + over) numbers."""
    n = rows.count()
    wide = min(dims + over, features)
    mean = summed(rows, lambda b: [np.bincount(b.column("idx").flatten().to_numpy(), b.column("value").flatten().to_numpy(), features)], features) / max(1, n)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, wide)))[0]

    def covered(q: np.ndarray) -> np.ndarray:
        """The centred covariance times q."""

        def work(b: pa.RecordBatch) -> Iterator[np.ndarray]:
            if b.num_rows:
                c = Columns(b)
                out = np.zeros((features, wide))
                out[c.features] = c.back(c.times(q))
                yield out

        return summed(rows, work, features * wide).reshape(features, wide) / max(1, n) - np.outer(mean, mean @ q)

    for _ in range(passes):
        basis = np.linalg.qr(covered(basis))[0]
    small = basis.T @ covered(basis)
    variance, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-variance)[:dims]
    directions = basis @ turn[:, order]
    directions = directions * np.where(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])] < 0, -1.0, 1.0)
    return Components(mean, directions, np.maximum(variance[order], 0.0))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("reduced")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, of equals the first, and the squared distance, by matrix blocks. Single precision tells most
    rows' centre; rows for which another one is within its error are looked at in double precision."""
    half, norm = 0.5 * (centers**2).sum(1), (x**2).sum(1)
    single = np.ascontiguousarray(np.c_[-centers, half].T, np.float32)
    # Twice the most that rounding can move a sum of so many products.
    error = 4 * (x.shape[1] + 4) * 2.0**-24 * (np.sqrt(norm) * np.sqrt(2 * half.max()) + half.max())
    at = np.zeros(len(x), np.int64)
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        d = np.c_[part, np.ones(len(part))].astype(np.float32) @ single
        own = d.argmin(1)
        least = d[np.arange(len(part)), own] + error[i : i + BLOCK]
        # Where single precision has no number or no room for it, nothing is told.
        open_ = np.flatnonzero(~(np.count_nonzero(d <= least.astype(np.float32)[:, None], axis=1) == 1))
        if len(open_):
            own[open_] = (half - part[open_] @ centers.T).argmin(1)
        at[i : i + BLOCK] = own
    return at, np.maximum(norm - 2 * np.einsum("ij,ij->i", x, centers[at]) + 2 * half[at], 0.0)


def seeds(x: np.ndarray, k: int, rng: np.random.Generator, tries: int = 4, rounds: int = 3) -> np.ndarray:
    """Greedy k-means++ on a sample (of some draws the one that lowers the objective most), and a few rounds of k-means on it. Fewer
    than k if the sample has fewer distinct rows."""
    norm = (x**2).sum(1)
    out = [x[rng.integers(len(x))]]
    far = np.maximum(norm - 2 * x @ out[0] + (out[0] ** 2).sum(), 0.0)
    while len(out) < k and far.sum() > 1e-9 * max(1.0, norm.sum()):
        drawn = rng.choice(len(x), size=tries, p=far / far.sum())
        near = np.minimum(far, np.maximum(norm - 2 * x[drawn] @ x.T + norm[drawn, None], 0.0))
        best = int(near.sum(1).argmin())
        out.append(x[drawn[best]])
        far = near[best]
    centers = np.array(out)
    for _ in range(rounds):
        at, _ = nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def page_of(pages: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(pages))


def paged(reduced: DataFrame, pages: int = 10, seed: int = 42) -> DataFrame:
    """Write reduced rows in a folder for each page, so that a step of mini_batch_means() with the same pages and seed reads its own."""
    path = fresh(reduced.sparkSession, "reduced")
    reduced.withColumn("page", page_of(pages, seed).cast("int")).write.option("compression", "zstd").partitionBy("page").parquet(path)
    return reduced.sparkSession.read.schema("name string, reduced array<double>, page int").parquet(path)


def mini_batch_means(reduced: DataFrame, k: int, pages: int = 10, rounds: int = 3, sample: int | None = None, starts: int | None = None, seed: int = 42) -> np.ndarray:
    """k centres: seeded on a bounded sample (10 k rows, by a digest of the name; the best of some starts, 1000 / k of them up to
    8 unless told otherwise, for many centres differ less between starts and cost more), then moved by page after page of the rows. A page's
    rows are assigned in parallel; each centre moves to the running mean of the rows it has had in this round over the pages, so
    that every round ends with means of whole assignments."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("name")))
    chosen = reduced.select("name", digest.alias("digest")).orderBy("digest", "name").limit(sample or 10 * k)
    start = np.array([r["reduced"] for r in reduced.join(F.broadcast(chosen), "name").orderBy("digest", "name").limit(sample or 10 * k).select("reduced").toLocalIterator()], float)
    if not len(start):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centers = min((seeds(start, k, rng) for _ in range(starts or max(1, min(8, 1000 // k)))), key=lambda c: nearest(start, c)[1].sum())
    k, dims = centers.shape
    page = F.col("page") if "page" in reduced.columns else page_of(pages, seed)

    def step(part: DataFrame, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(b: pa.RecordBatch) -> Iterator[np.ndarray]:
            if b.num_rows:
                x = _vectors(b)
                at, _ = nearest(x, held)
                order = np.argsort(at, kind="stable")
                begins = np.searchsorted(at[order], np.arange(k))
                n = np.diff(np.append(begins, len(at)))
                out = np.zeros((k, dims + 1))
                seen = n > 0
                out[seen, :dims] = np.add.reduceat(x[order], begins[seen], axis=0)
                out[:, dims] = n
                yield out

        got = summed(part, work, k * (dims + 1)).reshape(k, dims + 1)
        return got[:, :dims], got[:, dims]

    for _ in range(rounds):
        counts = np.zeros(k)
        for p in range(pages):
            sums, n = step(reduced.where(page == p).select("reduced"), centers)
            counts += n
            moved = n > 0
            centers = centers.copy()
            centers[moved] += (sums[moved] - n[moved, None] * centers[moved]) / counts[moved, None]
    return centers


def assigned(reduced: DataFrame, centers: np.ndarray) -> DataFrame:
    """(name, cluster_id, distance2) by the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, far = nearest(_vectors(b), centers)
                yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(at, pa.int32()), pa.array(far)], names=["name", "cluster_id", "distance2"])

    return reduced.select("name", "reduced").mapInArrow(run, "name string, cluster_id int, distance2 double")
