"""N-gram Jaccard join by chosen paths.

A document is the set of its 5-word shingles (lower case; a shorter text is one shingle). Documents of equal sets form
a node. In each run the nodes are split recursively: at each level by a token that all members sample with shared
randomness (the shingle of least hash on a lane of the sketch; each run has its own draw of lanes), so that similar sets
sample the same token with probability equal to their similarity. A small bucket is compared by brute force; one that a
token hardly splits consists of similar sets, and is compared by brute force too, in pairs of blocks if it is large.
Runs are repeated until a pair at the threshold is met with the target recall. The chance to meet in a run falls with the
level at which a node's bucket is small, so a node goes on until the chance to have missed a partner, over the levels it
has seen in all its runs, is below 1 - recall; there is no cap on runs.
Brute force is in two steps: sketches name candidates, and exact sets of the candidates decide. A pair counts only in
the first run that it meets in, so link counts need no table of pairs. Classes are connected components of the links.

Result: one row per input row: doc_id, class_id (least doc_id of its class), n_links (rows linked to it, copies too).
Null and empty texts, and texts of blanks, link to nothing. Rows with a null id come back with null class and no links.
Rows that repeat an id are linked as copies where their sets agree. Ties don't arise. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .common import id_text, map_rows, words

LANES, DEPTH = 64, 6
#: Nodes of a bucket up to which it is compared as it is; of a block of a larger bucket that isn't split further.
SMALL, BLOCK = 256, 8192
#: A bucket stays whole if a token leaves more than this share of it together.
DENSE = 0.5
#: Keys up to which a table of keys is broadcast, 16 bytes each; beyond, it is joined by shuffling.
BROADCAST_IDS = 1_000_000
#: A node of more than one in so many rows is hot: there are fewer than that many, and their table is broadcast.
HOT = 10_000

_MIX = np.random.default_rng(20).integers(1, 1 << 32, size=(2, LANES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def bar(threshold: float) -> float:
    """Share of equal lanes that makes a candidate: four standard errors below the threshold, which 1 pair in 10,000 misses."""
    return max(1 / LANES, threshold - 4 * math.sqrt(threshold * (1 - threshold) / LANES))


def _misses(threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs that agree on k = 0..LANES lanes: the chance of k at the threshold, and by level d the log of the chance
    that d lanes of a run hold one on which they differ."""
    k = np.arange(LANES + 1)
    log = np.cumsum(np.log(np.maximum(k, 1)))
    chance = np.exp(log[-1] - log - log[::-1] + k * math.log(threshold) + k[::-1] * math.log1p(-threshold)) if threshold < 1 else (k == LANES).astype(float)
    met = np.ones(LANES + 1)
    out = []
    for d in range(DEPTH):
        met = met * np.maximum(k - d, 0) / (LANES - d)
        out.append(np.log(np.maximum(1 - met, 1e-300)))
    return chance, np.array(out)


def missed(levels: np.ndarray, threshold: float) -> np.ndarray:
    """The chance that a partner at the threshold was in none of a node's buckets, from its numbers of runs by level."""
    chance, logs = _misses(threshold)
    return np.exp(levels @ logs) @ chance


def runs_for(recall: float, threshold: float, depth: int = 2) -> int:
    """Runs that end at this level and reach the recall."""
    runs = 1
    while missed(np.eye(DEPTH)[depth - 1] * runs, threshold) > 1 - recall:
        runs += 1
    return runs


class Shingler:
    """Text -> sorted distinct 64-bit hashes of its shingles."""

    def __init__(self, n: int):
        self.n, self.table = n, {}

    def word(self, w: bytes) -> int:
        if len(self.table) > 1_000_000:
            self.table.clear()
        h = self.table[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str) -> np.ndarray:
        found, get = words(text.lower()), self.table.get
        if not found:
            return np.zeros(0, np.uint64)
        w = np.array([get(x) or self.word(x) for x in found], np.uint64)
        size = min(self.n, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h = (h ^ w[i : len(w) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash on each lane, as int32."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        y = x[i : i + 4096, None] * _MIX[0] + _MIX[1]
        least = np.minimum(least, (y ^ (y >> np.uint32(15))).min(0))
    return least.view(np.int32)


def nodes_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, node (digest of the set, null without words), sketch."""

    def start():
        shingler = Shingler(n)

        def step(batch):
            out: dict[str, list] = {"node": [], "sketch": []}
            for t in batch.column(1):
                s = shingler(t.as_py())
                out["node"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["sketch"].append(sketch(s) if len(s) else None)
            return out | {"doc_id": batch.column(0), "text_key": batch.column(2)}

        return step

    return map_rows(docs, "doc_id long, text_key long, node binary, sketch array<int>", start)


def _lanes(run: int) -> list[int]:
    return np.random.default_rng([7, run]).permutation(LANES)[:DEPTH].tolist()


def buckets(nodes: DataFrame, runs: range) -> tuple[DataFrame, DataFrame | None]:
    """node, run, path, n of the bucket that holds the node at the end of each run's recursion (single nodes are left out),
    and (node, run, level) of the nodes whose buckets were split to that level."""
    lanes = {r: _lanes(r) for r in runs}
    first = nodes.select("node", F.posexplode(F.array(*[F.xxhash64(F.lit(r), F.get("sketch", F.lit(lanes[r][0]))) for r in runs])).alias("run", "path")).withColumn("run", F.col("run") + runs.start)
    done, deep, level = [], [], 1
    rows = first
    while True:
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        rows = written(rows.join(sizes, "path"), "paths")
        large = rows.where(F.col("n") > SMALL)
        if level >= DEPTH or large.isEmpty():
            done.append(rows)
            break
        done.append(rows.where(F.col("n") <= SMALL))
        token = F.get("sketch", F.get(F.array(*[F.lit(lanes[r][level]) for r in runs]), F.col("run") - runs.start))
        split = written(large.join(nodes.select("node", "sketch"), "node").select("node", "run", "path", "n", F.xxhash64("path", token).alias("child")), "split")
        most = split.groupBy("path", "n", "child").agg(F.count("*").alias("m")).groupBy("path", "n").agg(F.max("m").alias("m"))
        dense = most.where(F.col("m") > F.col("n") * DENSE).select("path")
        done.append(split.join(dense, "path", "left_semi").select("path", "node", "run", "n"))
        level += 1
        rows = split.join(dense, "path", "left_anti").select("node", "run", F.col("child").alias("path"))
        deep.append(rows.select("node", "run", F.lit(level).alias("level")))
    out = done[0].select("node", "run", "path", "n")
    for d in done[1:]:
        out = out.unionByName(d.select("node", "run", "path", "n"))
    return out, functools.reduce(DataFrame.unionByName, deep) if deep else None


def all_buckets(nodes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """The buckets of as many runs as each node needs, and the number of runs."""
    runs, active, out, deep = range(runs_for(recall, threshold)), nodes, None, None

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = np.stack([batch.column(f"l{d}").to_numpy() for d in range(1, DEPTH + 1)], 1)
            yield batch.select(["node", "deepest"]).filter(pa.array(missed(levels, threshold) > 1 - recall))

    while True:
        rows, more = buckets(active, runs)
        out = rows if out is None else out.unionByName(rows)
        if more is None:  # no bucket was split, so these runs were more than enough for all that were active
            return out, runs.stop
        deep = more if deep is None else deep.unionByName(more)
        last = deep.groupBy("node", "run").agg(F.max("level").alias("level"))
        counts = [F.count_if(F.col("level") == d).alias(f"l{d}") for d in range(2, DEPTH + 1)]
        each = active.select("node").join(last.groupBy("node").agg(*counts, F.max("level").alias("deepest")), "node")
        each = each.withColumn("l1", F.lit(runs.stop) - sum((F.col(f"l{d}") for d in range(2, DEPTH + 1)), F.lit(0)))
        go = written(each.select("node", "deepest", *[F.col(f"l{d}").cast("double").alias(f"l{d}") for d in range(1, DEPTH + 1)]).mapInArrow(left, "node binary, deepest int"), "active")
        deepest = go.agg(F.max("deepest")).first()[0]
        if deepest is None:
            return out, runs.stop
        active = nodes.join(go.select("node"), "node", "left_semi")
        runs = range(runs.stop, max(runs.stop + 1, runs_for(recall, threshold, deepest)))


def dealt(rows: DataFrame, runs: int) -> DataFrame:
    """Each node's paths in all runs beside each of its buckets, and buckets of over BLOCK nodes dealt out in pairs of blocks."""
    own = rows.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("run", "path"))).alias("all"), F.collect_list(F.struct("run", "path", "n")).alias("each"))
    paths = F.array(*[F.coalesce(F.try_element_at("all", F.lit(r)), F.lit(0)) for r in range(runs)])
    out = own.select("node", paths.alias("paths"), F.explode("each").alias("e")).select("node", "paths", "e.*")
    out = out.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    out = out.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select("node", "paths", "run", "path", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))


def _first_met(paths: np.ndarray, run: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs in a bucket of this run, those that no earlier run has put together."""
    met = np.zeros(len(a), bool)
    for r in range(run):
        p = paths[:, r]
        met |= (p[a] == p[b]) & (p[a] != 0)
    return ~met


def _pairs(hit: np.ndarray, at: int, b: np.ndarray, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.nonzero(hit)
    x += at
    ok = (x < y) & (b[x] != b[y] if crossed else True)
    return x[ok], y[ok]


def _column(table: pa.Table, name: str, kind, width: int) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def candidates(rows: DataFrame, runs: int, least: float) -> DataFrame:
    """Of the rows dealt out, with sketches, those with a partner of similar sketch that they haven't met before."""

    def flag(table: pa.Table) -> pa.Table:
        lanes = _column(table, "sketch", np.int32, LANES).astype(np.uint8)
        paths, b = _column(table, "paths", np.int64, runs), table["b"].to_numpy()
        run, crossed = table["run"][0].as_py(), table["i"][0] != table["j"][0]
        keep = np.zeros(len(b), bool)
        wide = max(1, (1 << 24) // (len(b) * LANES))
        for at in range(0, len(b), wide):
            same = (lanes[at : at + wide, None, :] == lanes[None]).sum(2, dtype=np.uint8)
            x, y = _pairs(same >= least * LANES, at, b, crossed)
            new = _first_met(paths, run, x, y)
            keep[x[new]] = keep[y[new]] = True
        own = pa.ListArray.from_arrays(np.arange(0, keep.sum() * runs + 1, runs, dtype=np.int32), paths[keep].ravel())
        out = table.drop_columns(["sketch"]).filter(pa.array(keep))
        return out.set_column(out.column_names.index("paths"), "paths", own)

    schema = "node binary, paths array<long>, run int, path long, b int, i int, j int, doc_id long, copies long"
    return rows.select("node", "paths", "run", "path", "b", "i", "j", "doc_id", "copies", "sketch").groupBy("path", "i", "j").applyInArrow(flag, schema)


def join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the classes of the pairs (x, y); root holds the least member of each one's class."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def decided(rows: DataFrame, runs: int, threshold: float) -> DataFrame:
    """doc_id, root, links: each node's links within its bucket, by exact sets, and the least doc_id that they lead to."""

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")  # so that a root is the least id
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        paths, b, ids, copies = _column(table, "paths", np.int64, runs), table["b"].to_numpy(), table["doc_id"].to_numpy(), table["copies"].to_numpy()
        run, crossed, n = table["run"][0].as_py(), table["i"][0] != table["j"][0], len(sets)
        size = np.array([len(s) for s in sets])
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # only shingles of two or more sets are compared
        row = np.repeat(np.arange(n), size)
        use = times[column] > 1
        row, column = row[use], shared[column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        links, root, wide, most = np.zeros(n), np.arange(n), 512, max(64, (1 << 23) // max(n, 1))
        steps = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + most, most))

        for at in range(0, n, wide):
            inter = np.zeros((min(wide, n - at), n), np.float32)
            for k, (lo, hi) in enumerate(zip(steps, steps[1:], strict=False)):
                if lo < hi:
                    dense = np.zeros((n, most), np.float32)
                    dense[row[lo:hi], column[lo:hi] - k * most] = 1
                    inter += dense[at : at + wide] @ dense.T
            union = size[at : at + wide, None] + size[None] - inter
            x, y = _pairs(inter >= threshold * union - 1e-6, at, b, crossed)
            new = _first_met(paths, run, x, y)
            x, y = x[new], y[new]
            links += np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
            join(root, x, y)
        least = ids[root]
        on = links > 0
        return pa.table({"node": table["node"].filter(pa.array(on)), "doc_id": ids[on], "root": least[on], "links": links[on].astype(np.int64)})

    return rows.groupBy("path", "i", "j").applyInArrow(decide, "node binary, doc_id long, root long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for edges (u, v): alternating large and small stars until nothing moves. Only counts reach the driver."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = print_of(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = print_of(edges)
        forget(large)
        if now == last:
            break
        last = now
    return edges.groupBy("u").agg(F.min("v").alias("root"))


def among(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows by a table of keys, which is broadcast while they are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, on, how)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The join's result as the module states it; at most one row per input row moves with each run, never a pair."""
    return _classes(id_text(docs, id_col, text_col), shingle, threshold, recall).drop("text_key")


def _classes(texts: DataFrame, shingle: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, text_key (hash of the text), class_id, n_links."""
    members = written(nodes_of(texts.withColumn("text_key", F.xxhash64("text")), shingle), "members")
    nodes = written(members.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "nodes")
    found, runs = all_buckets(nodes, threshold, recall)
    met = dealt(found, runs).join(nodes, "node")
    flagged = written(candidates(met, runs, bar(threshold)), "candidates")

    def start():
        shingler = Shingler(shingle)

        def step(batch):
            sets = [shingler(t.as_py()).tobytes() for t in batch.column(1)]
            return {"node": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "shingles": sets}

        return step

    wanted = among(texts.where("doc_id IS NOT NULL"), flagged.select("doc_id").distinct(), ["doc_id"])
    sets = map_rows(wanted, "node binary, shingles binary", start).dropDuplicates(["node"])
    linked = written(decided(flagged.join(sets, "node"), runs, threshold), "links")
    roots = components(linked.select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
    of = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "doc_id", "copies").join(of, "node", "left").where("copies > 1 OR links IS NOT NULL")
    known = known.join(roots.select(F.col("u").alias("doc_id"), "root"), "doc_id", "left")
    known = written(known.select("node", F.coalesce("root", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "known")
    # A group of copies is one node, which may hold a third of all rows: its few like go out by broadcast, apart from the rest.
    total = members.count()
    hot = F.broadcast(known.where(F.col("copies") * HOT > total).drop("copies"))
    rows = members.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    alone = rows.where("node IS NULL").withColumn("class_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
    rows = rows.where("node IS NOT NULL")
    rest = rows.join(hot, "node", "left_anti").join(known.where(F.col("copies") * HOT <= total).drop("copies"), "node", "left")
    out = rows.join(hot, "node").unionByName(rest).unionByName(alone)
    return out.select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of docs, with all columns, of each class: one of its least id, of several with that id the one whose text has the
    least hash. Rows with a null id stay."""
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"))
    classes = written(_classes(id_text(docs, id_col, text_col), **how).where("doc_id IS NOT NULL"), "classes")
    # Of a class, rows of its least id whose text hashes least stay; texts that link to nothing are a class of their own.
    heads = classes.where("doc_id = class_id").groupBy("doc_id").agg(F.min("text_key").alias("head"), F.count("*").alias("n"), F.max("n_links").alias("links"))
    twice = written(heads.where("n > 1"), "twice")
    gone = classes.where("doc_id <> class_id").select("doc_id", "text_key")
    gone = gone.unionByName(classes.where("doc_id = class_id").join(twice.where("links > 0"), "doc_id").where("text_key <> head AND n_links > 0").select("doc_id", "text_key"))
    out = among(rows, written(gone.distinct(), "gone"), ["doc_id", "text_key"], "left_anti")
    if not twice.isEmpty():
        again = twice.select("doc_id")
        out = among(out, again, ["doc_id"], "left_anti").unionByName(among(out, again, ["doc_id"]).dropDuplicates(["doc_id", "text_key"]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
