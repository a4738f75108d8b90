"""Exact top-k cosine join of many queries with a corpus of histograms: a distributed inverted index, pruned by bounds.

Rows are dealt into blocks of like size, queries too; a pair of blocks meets only if a query's range of sizes reaches the block.
In a pair of blocks features that always occur together are one term, and rows that are alike in the common terms one group; the
rare terms have postings. The group says how much postings must add to reach the score of a query's k-th row, so only rows that
get so much are looked at. That bar comes from a first join of each query block with the blocks of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows and queries of a block; queries of a block at most, where there are PAIRS pairs of blocks even so; up to so many distinct sizes their table is broadcast (16 bytes each).
ROWS, QUERIES, MOST, BROADCAST = 20_000, 2_048, 16_384, 1_000_000
SLACK, PAIRS = 1e-9, 64
#: The part of a block's rows above which a term has no postings; queries whose common parts are found at once; tasks of a join.
DENSE, AT_ONCE, TASKS = 0.25, 256, 1024


def block_size(row_blocks: int, queries: int) -> int:
    """Queries of a block. Rows are sent once for each block of queries, so blocks grow as long as there is work for PAIRS tasks."""
    return int(min(MOST, max(QUERIES, queries * row_blocks // PAIRS)))

SCHEMA = "query string, name string, wl double, scored long"


def window(size: Column, nodes: Column, ratio: float | None, diff: float, large: int, wide: tuple[float, float]) -> tuple[Column, Column]:
    """The looser of a relative and an absolute range of sizes; the ratio follows the node count if none is given."""
    r = F.lit(float(ratio)) if ratio else F.when(nodes >= large, wide[1]).otherwise(wide[0])
    return F.greatest(F.lit(0.0), F.least(size / r, size - F.lit(float(diff)))), F.greatest(size * r, size + F.lit(float(diff)))


def bands(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(size, band, blocks) of (size, rows) in order: bands of about `most` rows; a size of more has a band of several blocks."""
    out, held, band = [], 0, 0
    for size, n in sizes:
        if held and held + n > most:
            band, held = band + 1, 0
        held += n
        out.append((size, band, max(1, -(-n // most))))
    return out


def leads(begins: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each list of postings a list with the same rows and counts, one for all that are alike. Lists that look alike by a random
    sum are compared whole."""
    n = np.diff(begins)
    known = np.random.default_rng(7).integers(1, 1 << 62, int(rows.max(initial=0)) + 1)
    sums = np.diff(np.r_[0, np.cumsum(known[rows] * counts.view(np.int64))][begins])  # wraps, for all alike
    order = np.lexsort((sums, n))
    new = np.r_[True, (np.diff(n[order]) != 0) | (np.diff(sums[order]) != 0)]
    lead = np.empty(len(n), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))]
    of = np.repeat(np.arange(len(n)), n)
    twin = np.arange(len(rows)) + (begins[lead] - begins[:-1])[of]
    other = np.unique(of[(rows != rows[twin]) | (counts != counts[twin])])
    lead[other] = other
    return lead


class Index:
    """A block of rows (name, size, norm2, keys, values) over the features of some queries.

    Features that are in the same rows with the same counts are one term. Terms of a DENSE part of the rows are no postings: rows that are alike in
    them, in size and in length are one group, whose common part of a dot product is found once. Groups lie side by side, by size."""

    def __init__(self, rows: pa.Table, queries: pa.Table):
        many = rows.num_rows
        keys = pc.list_flatten(queries["keys"]).combine_chunks().dictionary_encode()
        feature = pc.index_in(pc.list_flatten(rows["keys"]).combine_chunks(), keys.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(many), pc.list_value_length(rows["keys"]).fill_null(0).to_numpy())
        count = pc.list_flatten(rows["values"]).to_numpy().astype(float)
        order = np.argsort(feature, kind="stable")[np.count_nonzero(feature < 0) :]
        row, count = row[order], count[order]
        begins = np.searchsorted(feature[order], np.arange(len(keys.dictionary) + 1))
        lead = leads(begins, row, count)
        terms = np.unique(lead[np.diff(begins) > 0])
        n = begins[terms + 1] - begins[terms]
        dense = n > DENSE * many
        # Groups of rows.
        matrix = np.zeros((many, int(dense.sum())))
        for i, f in enumerate(terms[dense].tolist()):
            matrix[row[begins[f] : begins[f + 1]], i] = count[begins[f] : begins[f + 1]]
        self.shapes, shape = np.unique(matrix, axis=0, return_inverse=True) if matrix.shape[1] else (np.zeros((1, 0)), np.zeros(many, np.int64))
        own = np.c_[rows["size"].to_numpy(), shape.ravel(), rows["norm2"].to_numpy()].astype(np.int64)
        groups, group = np.unique(own, axis=0, return_inverse=True)
        place = np.argsort(group.ravel(), kind="stable")
        self.group = group.ravel()[place]
        self.group_size, self.group_shape, self.group_norm = groups[:, 0], groups[:, 1], np.sqrt(groups[:, 2].astype(float))
        self.group_begins = np.searchsorted(self.group, np.arange(len(groups) + 1))
        self.names, self.norm = rows["name"].combine_chunks().take(pa.array(place)), self.group_norm[self.group]
        # Postings of the other terms.
        at, whose = _stretches(begins[terms[~dense]], n[~dense])
        now = np.empty(many, np.int64)
        now[place] = np.arange(many)
        self.post_row, self.post_count = now[row[at]], count[at]
        self.begins = np.r_[0, np.cumsum(n[~dense])]
        # What queries weigh in terms: of dense ones, and of others in a row of (term, weight) for each query.
        number = np.full(len(keys.dictionary) + 1, -1)
        number[terms[dense]], number[terms[~dense]] = np.arange(dense.sum()), np.arange((~dense).sum()) + int(dense.sum())
        number[:-1] = np.where(np.diff(begins) > 0, number[lead], -1)
        term = number[keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        query = np.repeat(np.arange(queries.num_rows), pc.list_value_length(queries["keys"]).fill_null(0).to_numpy())[term >= 0]
        weight, term = pc.list_flatten(queries["values"]).to_numpy().astype(float)[term >= 0], term[term >= 0]
        of, which = np.unique(query * (len(terms) + 1) + term, return_inverse=True)
        self.weight = np.bincount(which.ravel(), weight, len(of))
        self.query, self.term = of // (len(terms) + 1), of % (len(terms) + 1)
        self.query_begins = np.searchsorted(self.query, np.arange(queries.num_rows + 1))
        self.dense = int(dense.sum())

    def common(self, first: int, last: int) -> np.ndarray:
        """What dense terms add to the dot products of some queries with each shape."""
        span = slice(int(self.query_begins[first]), int(self.query_begins[last]))
        own = self.term[span] < self.dense
        q = np.zeros((last - first, self.dense))
        q[self.query[span][own] - first, self.term[span][own]] = self.weight[span][own]
        return q @ self.shapes.T

    def sums(self, query: int) -> np.ndarray:
        """What the other terms add to a query's dot product with each row."""
        span = slice(int(self.query_begins[query]), int(self.query_begins[query + 1]))
        own = self.term[span] >= self.dense
        term, weight = self.term[span][own] - self.dense, self.weight[span][own]
        n = self.begins[term + 1] - self.begins[term]
        at, whose = _stretches(self.begins[term], n)
        return np.bincount(self.post_row[at], self.post_count[at] * weight[whose], len(self.group))


def _stretches(begins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of stretches of n places each, and whose they are."""
    whose = np.repeat(np.arange(len(n)), n)
    return np.arange(len(whose)) + (begins - np.cumsum(n) + n)[whose], whose


def scored(rows: pa.Table, queries: pa.Table, top: int | None, zeros: bool, bars: bool = False) -> pa.Table:
    """(query, name, wl) of a pair of blocks: of each query the rows in its range that can be among its `top`, with their equals.
    One row without a query says for how many pairs a cosine was found. With bars, only the `top` best cosines of each query."""
    index = Index(rows, queries) if rows.num_rows and queries.num_rows else None
    met, found, cosines, total = [], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    columns = [queries[c].to_pylist() for c in ("low", "high", "norm2", "bar")] if index else []
    many = np.zeros(queries.num_rows if index else 0, np.int64)
    for i, (low, high, norm2, bar) in enumerate(zip(*columns, strict=True)):
        if i % AT_ONCE == 0:
            common = index.common(i, min(i + AT_ONCE, queries.num_rows))
        norm = float(norm2) ** 0.5
        first, last = np.searchsorted(index.group_size, low, "left"), np.searchsorted(index.group_size, high, "right")
        if first == last:
            continue
        lo, hi = int(index.group_begins[first]), int(index.group_begins[last])
        base, sums = common[i % AT_ONCE][index.group_shape], index.sums(i)
        if bar is None or bar <= 0:
            at = np.arange(lo, hi)
        else:
            # A group's rows pass the bar if postings add so much to what the group has.
            need = (bar - SLACK) * norm * index.group_norm[first:last] - base[first:last]
            easy, least = need <= 0, need.min(initial=np.inf, where=need > 0)
            at = np.flatnonzero(sums[lo:hi] >= least) + lo
            if easy.any():
                easy = np.flatnonzero(easy) + first
                whole, _ = _stretches(index.group_begins[easy], index.group_begins[easy + 1] - index.group_begins[easy])
                at = np.union1d(at, whole)
        dots, total = sums[at] + base[index.group[at]], total + len(at)
        at, dots = at[dots > 0], dots[dots > 0]
        wl = np.clip(dots / (index.norm[at] * norm), 0.0, 1.0)
        least = max(bar or 0.0, float(np.partition(wl, -top)[-top]) if top and len(wl) >= top else 0.0)
        keep = wl >= least - SLACK
        at, wl = at[keep], wl[keep]
        if bars:
            at, wl = at[:top], np.sort(wl)[::-1][:top]
        elif zeros and top and len(at) < top and (bar is None or bar <= 0):
            none = np.setdiff1d(np.arange(lo, hi), at)
            none = none[np.argsort(index.names.take(pa.array(none)).to_numpy(zero_copy_only=False), kind="stable")[: top - len(at)]]
            at, wl = np.concatenate([at, none]), np.concatenate([wl, np.zeros(len(none))])
        many[i] = len(at)
        found.append(at)
        cosines.append(wl)
    out = [pa.table({"query": pa.nulls(1, pa.string()), "name": pa.nulls(1, pa.string()), "wl": pa.nulls(1, pa.float64()), "scored": pa.array([total], pa.int64())})]
    if many.sum():
        at, n = pa.array(np.concatenate(found)), int(many.sum())
        query = queries["name"].combine_chunks().take(pa.array(np.repeat(np.arange(len(many)), many)))
        out.append(pa.table({"query": query, "name": pa.nulls(n, pa.string()) if bars else index.names.take(at), "wl": np.concatenate(cosines), "scored": pa.nulls(n, pa.int64())}))
    return pa.concat_tables(out)


def _sizes(df: DataFrame) -> list[tuple[int, int]]:
    return [(r["size"], r["n"]) for r in df.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").toLocalIterator()]


def _placed(df: DataFrame, table: list[tuple[int, int, int]], band: str) -> DataFrame:
    """Add the band of each row's size, its number of blocks, and the row's own block."""
    small = df.sparkSession.createDataFrame(table or [(0, 0, 1)], "size int, band int, blocks int")
    joined = df.join(F.broadcast(small) if len(table) <= BROADCAST else small, "size")
    return joined.withColumnRenamed("band", band).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))


def topk_join(corpus: DataFrame, queries: DataFrame, top: int | None, ranges: tuple[Column, Column], zeros: bool = False, rows: int = ROWS, block: int | None = None) -> DataFrame:
    """(query, name, wl, scored) of the pairs in range that share a feature. With `top`, of each query its so many best rows are among
    them, with their equals, and more that single blocks couldn't rule out: the cut over all is the caller's. With `zeros`, queries
    of fewer pairs also get rows that share nothing, the least names first. Rows without a query count scored pairs.

    corpus and queries have name, simp_node_count, norm2 and enc; `ranges` are least and greatest size as columns of queries.
    The driver gets the distinct sizes of trees and their counts, and one row for each block of queries. No task gets more than a
    block of rows and a block of queries.
    """
    own = [F.col("simp_node_count").cast("int").alias("size"), F.col("norm2").cast("long").alias("norm2"), F.map_keys("enc").alias("keys"), F.map_values("enc").alias("values")]
    left = corpus.where("enc IS NOT NULL AND simp_node_count IS NOT NULL").select("name", *own)
    right = queries.where("enc IS NOT NULL AND simp_node_count IS NOT NULL").select("name", *own, ranges[0].cast("double").alias("low"), ranges[1].cast("double").alias("high"))
    row_bands, query_sizes = bands(_sizes(left), rows), _sizes(right)
    row_blocks = sum({b: k for _, b, k in row_bands}.values())
    query_bands = bands(query_sizes, block or block_size(row_blocks, sum(n for _, n in query_sizes)))
    left = _placed(left, row_bands, "band").drop("blocks")
    right = written(_placed(right, query_bands, "q").drop("blocks").withColumn("bar", F.lit(None).cast("double")), "queries")
    # The bands that each block of queries reaches lie side by side.
    sizes, of = np.array([s for s, _, _ in row_bands] or [0]), np.array([b for _, b, _ in row_bands] or [0])
    blocks = dict.fromkeys(of.tolist(), 1) | {b: n for _, b, n in row_bands if n > 1}
    reach = []
    for r in right.groupBy("q", "block").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
        lo, hi = np.searchsorted(sizes, r["low"], "left"), np.searchsorted(sizes, r["high"], "right")
        if lo < hi:
            reach += [(r["q"], r["block"], b, s) for b in range(int(of[lo]), int(of[hi - 1]) + 1) for s in range(blocks[b])]
    # Each query's own size has a band, where its bar comes from.
    near = [(s, int(of[min(int(np.searchsorted(sizes, s)), len(of) - 1)])) for s, _ in query_sizes]
    home = sorted({(q, i, b, s) for (_, q, k), (_, b) in zip(query_bands, near, strict=True) for i in range(k) for s in range(blocks[b])})
    spark = corpus.sparkSession

    def joined(pairs: list[tuple[int, int, int, int]], q: DataFrame, bars: bool = False) -> DataFrame:
        p = spark.createDataFrame(pairs, "q int, qblock int, band int, block int")
        p = F.broadcast(p) if len(pairs) <= BROADCAST else p
        keys, tasks = ["q", "qblock", "band", "block"], max(1, min(len(pairs), TASKS))
        a = left.join(p, ["band", "block"]).select(*keys, "name", "size", "norm2", "keys", "values")
        b = q.withColumnRenamed("block", "qblock").join(p, ["q", "qblock", "band"] if bars else ["q", "qblock"]).select(*keys, "name", "norm2", "keys", "values", "low", "high", "bar")
        a, b = (x.repartition(tasks, *keys) for x in (a, b))
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: scored(x, y, top, zeros, bars), SCHEMA)

    if top and row_blocks > 1:
        own = spark.createDataFrame(near or [(0, 0)], "size int, band int")
        first = joined(home, right.join(F.broadcast(own) if len(near) <= BROADCAST else own, "size"), True).where("query IS NOT NULL")
        bars = first.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("wl")))).where(F.col("r") == top).select(F.col("query").alias("name"), F.col("wl").alias("bar"))
        right = written(right.drop("bar").join(bars, "name", "left"), "queries")
    return joined(reach, right)


def pairs_scored(joined: DataFrame) -> int:
    """How many pairs a join scored exactly."""
    return joined.agg(F.sum("scored")).first()[0] or 0
