"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from arbolith.llm import registry, runs
from arbolith.llm.common import words

from test_llm import ODD, key


def brute(ws):
    """All runs by looking at every period."""
    n, out = len(ws), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(d, t):
    ws = words(t)
    n, h = len(ws), zlib.crc32(str(d).encode())
    if d is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = brute(ws)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(ws) if i not in gone)))


def some(rng):
    """Random words of few kinds, with repetitions inside repetitions."""
    ws = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
    for _ in range(rng.randrange(4)):
        p = ws[: rng.randrange(1, 9)] or ["x"]
        at = rng.randrange(len(ws) + 1)
        ws[at:at] = (p * rng.randrange(2, 9))[: rng.randrange(1, 60)]
    return ws


@pytest.mark.parametrize("pairs", [1, 50, 1_000_000])
def test_find(monkeypatch, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    rng = random.Random(pairs)
    texts = [some(rng) for _ in range(300)] + [["a"] * 5, ["a"] * 6, [], list("ababab"), list("abababab"), list("xaaaaaay"), ["a"] * 1000]
    ids = np.array([ord(w) for t in texts for w in t], np.int64)
    got = runs.find_runs(ids, np.cumsum([0, *map(len, texts)]))
    assert got == [brute(t) for t in texts] and sum(map(len, got)) > 100


def test_lying_hashes(monkeypatch):
    """With hashes that are equal for all words, words decide."""
    rng = random.Random(5)
    texts = [some(rng) for _ in range(100)]
    ids = np.array([ord(w) for t in texts for w in t], np.int64)
    monkeypatch.setattr(runs.Prefixes, "equal", lambda self, at, apart, size: np.ones(len(at), bool))
    assert runs.find_runs(ids, np.cumsum([0, *map(len, texts)])) == [brute(t) for t in texts]


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = registry.op11_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, got.collect()), key=key)
    assert got == sorted((brute_row(d, t) for d, t in rows), key=key) and sum(r[1] > 0 for r in got) > 10


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHARACTERS", 300)
    texts = [*ODD, "la " * 200_000, " ".join(str(i % 70_001) for i in range(290_000)), "a b " * 3 + "a", "a b " * 4, "x " * 6 + "y " * 6]
    rows = [(i, t, "n", 7) for i, t in enumerate(texts)] + [(None, "na " * 8, None, 1), (3, "again", "s", None), (3, "again", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int").repartition(3)
    out = runs.periodic_runs(df, rewrite=runs.repeat_tail, with_runs=True)
    got = out.collect()
    long = {len(ODD), len(ODD) + 1}
    plain = lambda r: tuple(r)[:8]
    assert sorted((plain(r) for r in got if r["doc_id"] not in long), key=key) == sorted((brute_row(d, t) for d, t, *_ in rows if d not in long), key=key)
    one = {r["doc_id"]: r for r in got if r["doc_id"] in long}
    if zlib.crc32(str(len(ODD)).encode()) % 10:
        assert plain(one[len(ODD)])[1:6] == (1, 0, 200_000, 1, 200_000_000) and one[len(ODD)]["collapsed"] == "la"
    if zlib.crc32(str(len(ODD) + 1).encode()) % 10:
        assert plain(one[len(ODD) + 1])[1:6] == (1, 0, 290_000, 70_001, 4142)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    assert runs.periodic_runs(df).where("doc_id IS NULL AND n_runs = 1 AND length = 8").count() == 1
