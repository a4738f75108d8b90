"""The top-k join against all pairs."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbolith.operators import search, topk


def rows_of(rng, n, hot=False):
    """Histograms of few common and many rare features, in families of alike ones; hot: half of one size."""
    out = []
    for i in range(n):
        family = rng.randrange(12)
        enc = {f"c{k}": rng.randrange(1, 4) for k in range(3)} | {f"f{family}_{k}": rng.randrange(1, 3) for k in range(8) if rng.random() < 0.8} | {f"r{rng.randrange(400)}": 1 for _ in range(rng.randrange(6))}
        if i % 17 == 0:
            enc = {f"alone{i}": 2}
        size = 40 if hot and i % 2 else rng.randrange(1, 200)
        out.append((f"n{i:04d}", size, size + 3, sum(v * v for v in enc.values()), enc))
    return out


SCHEMA = "name string, simp_node_count int, node_count int, norm2 long, enc map<string,int>"


def brute(rows, queries, zeros=False):
    out = {}
    for q, size, nodes, n2, enc in queries:
        lo, hi = search.bounds(size, search.auto_ratio(nodes))
        for name, s, _, m2, other in rows:
            if lo <= s <= hi:
                dot = sum(v * other.get(f, 0) for f, v in enc.items())
                if dot or zeros:
                    out.setdefault(q, []).append((-min(1.0, dot / (math.sqrt(m2) * math.sqrt(n2))), name))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("hot,block_rows,block", [(False, 60, 20), (True, 50, 7), (False, 20_000, 2048)])
@pytest.mark.parametrize("zeros", [False, True])
def test_join(spark, hot, block_rows, block, zeros):
    rng = random.Random(block)
    rows = rows_of(rng, 400, hot)
    queries = [r for r in rows if int(r[0][1:]) % 5 == 0]
    want = brute(rows, queries, zeros)
    df, q = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(queries, SCHEMA)
    for top in (1, 5, 300):
        got = {}
        for r in search.batch_cosine(df, q, top=top, zeros=zeros, rows=block_rows, block=block).collect():
            got.setdefault(r["query"], []).append((-r["wl"], r["name"]))
        assert set(got) == set(want)
        for name, all_ in want.items():
            bar = all_[min(top, len(all_)) - 1][0] + 1e-9
            best = [x for x in all_ if x[0] <= bar] if not zeros or bar < -1e-6 else all_[:top]
            mine = sorted(got[name])
            assert len(set(mine)) == len(mine) and {n for _, n in best} <= {n for _, n in mine}
            assert all(dict((n, s) for s, n in all_)[n] == pytest.approx(s) for s, n in mine)


def test_pruning(spark):
    """Bounds spare most pairs, and change nothing."""
    rng = random.Random(3)
    rows = rows_of(rng, 1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    q = df.where("cast(substr(name, 2) as int) % 20 = 0")
    ranges = topk.window(F.col("simp_node_count"), F.col("node_count"), None, 25, search.LARGE, (1.2, 1.8))
    pairs = sum(len(v) for v in brute(rows, [r for r in rows if int(r[0][1:]) % 20 == 0], True).values())
    out = topk.topk_join(df, q, 3, ranges, rows=100, block=30).cache()
    assert topk.pairs_scored(out) < 0.5 * pairs
    assert topk.topk_join(df, q, None, ranges).where("query IS NOT NULL").count() == sum(len(v) for v in brute(rows, [r for r in rows if int(r[0][1:]) % 20 == 0]).values())


def test_bars_of_own_size(spark):
    """A query's bar comes from all blocks of its own size, whatever other sizes are in its block of queries: only its best rows are left."""
    rows = [(f"n{size}_{i:03d}", size, size, 100 * 100 + i * i, {"c": 100, "x": i}) for size in (10, 60) for i in range(1, 301)]
    df = spark.createDataFrame(rows, SCHEMA)
    q = df.where("name LIKE '%50'")
    ranges = topk.window(F.col("simp_node_count"), F.col("node_count"), None, 24, search.LARGE, (1.2, 1.8))
    out = topk.topk_join(df, q, 3, ranges, rows=100, block=100).where("query IS NOT NULL").collect()
    assert len(out) == 3 * q.count() and {r["query"] for r in out} == {r["name"] for r in out if r["wl"] > 1 - 1e-9}


def test_terms_and_groups():
    """Features that always occur together are one list of postings; those of all rows none, and rows that differ in nothing else one group."""
    enc = [{"a": 2, "b": 1, **{f"{k}{i % 10}": 1 for k in "xyz"}} for i in range(100)]
    table = pa.table({"name": [f"n{i}" for i in range(100)], "size": [5] * 100, "norm2": [8] * 100, "keys": [list(e) for e in enc], "values": [list(e.values()) for e in enc]})
    index = topk.Index(table, table.slice(0, 10))
    assert len(index.begins) == 11 and len(index.post_row) == 100 and len(index.group_size) == 1
    dots = index.common(0, 10)[3][index.group_shape][index.group] + index.sums(3)
    got = dict(zip(index.names.to_pylist(), dots.tolist(), strict=True))
    assert got == {f"n{i}": 8.0 if i % 10 == 3 else 5.0 for i in range(100)}


def test_blocks_are_bounded():
    sizes = [(s, 10) for s in range(50)] + [(50, 1000), (51, 1), (52, 1)]
    got = topk.bands(sizes, 100)
    rows = {}
    for (s, n), (_, b, _) in zip(sizes, got, strict=True):
        rows[b] = rows.get(b, 0) + n
    assert got[50][2] == 10 and all(n <= 100 for b, n in rows.items() if b != got[50][1]) and got[49][1] != got[50][1] != got[51][1]


def test_edges(spark):
    one = [("a", 3, 3, 4, {"x": 2}), ("b", 3, 3, 0, {}), ("c", None, None, 1, {"x": 1}), ("d", 4, 4, 1, None), ("e", 9000, 9000, 1, {"x": 1})]
    df = spark.createDataFrame(one, SCHEMA)
    got = {(r["query"], r["name"]): r["wl"] for r in search.batch_cosine(df, df, top=2).collect()}
    assert got == {("a", "a"): 1.0, ("e", "e"): 1.0}
    assert search.batch_cosine(df, df.limit(0), top=2).count() == search.batch_cosine(df.limit(0), df, top=2).count() == 0
