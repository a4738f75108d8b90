"""Phrase mining against brute force and its SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from arbolith.llm import phrases, registry

from test_llm import ODD, key


def brute(rows, least, top, share=100):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    many = {x: n for x, n in f.items() if n >= least and len(x[1]) > 1}
    dropped = {(lang, w[i : i + m]) for (lang, w), n in many.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * n >= share * f[lang, w[i : i + m]]}
    out = {}
    for (lang, w), a in many.items():
        if (lang, w) not in dropped:
            score, _, l, r = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r, total[lang]))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, own in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(own)[:top], 1))


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(phrases.COLLOCATIONS_SQL)
    got = registry.op12_phrase_mining(spark, sf)
    assert got.columns == want.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got, want = sorted(map(tuple, got.collect())), sorted(want.fetchall())
    assert got == want and len(got) > 20
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got == brute(rows, 100, 2000)


@pytest.mark.parametrize("least,top,share,bits,held", [(3, 5, 100, 27, 2_000_000), (2, 10_000, 60, 16, 50), (4, 10_000, 90, 20, 1)])
def test_brute(spark, sf, monkeypatch, least, top, share, bits, held):
    """Small bitmaps let more through and change nothing; nor do held words, vocabularies or partitions."""
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "VOCABULARY", 10_000 if held > 1 else 500)
    monkeypatch.setattr(phrases, "FAN", 2)
    odd = [*ODD, "a\tb  c, a b c! A B c\x0ba b", "İ É a\x85b a\x85b", "x " * 3000, "of the of the of the"]
    rows = [(lang, t) for t in odd for lang in ("en", None, "und", "xx")]
    rows += [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").where("n_chars < 1500").limit(60).collect()]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    got = phrases.collocations(df, least=least, top=top, share=share)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top, share)


def test_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", "..."), (None, "a b")], "lang string, text string")).collect() == []
    with pytest.raises(ValueError):
        phrases.frequent_phrases(empty, least=300)


def test_exact_arithmetic(spark):
    """Products beyond 64 bits stay exact."""
    row = spark.createDataFrame([(4 * 10**12, 9 * 10**12, 7 * 10**12 + 1, 5 * 10**12)], "a long, total long, l long, r long")
    got = row.selectExpr("(cast(1000 AS decimal(4, 0)) * cast(a AS decimal(19, 0)) * cast(total AS decimal(15, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0))) AS s").first()["s"]
    assert got == 1000 * 4 * 10**12 * 9 * 10**12 // ((7 * 10**12 + 1) * 5 * 10**12)


def test_bitmap():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)
    b = phrases.Buckets(18)
    for part in np.array_split(h, 7):
        b.add(part)
    packed = np.packbits(b.counts >= 1, bitorder="little")
    m = phrases.Bitmap(18, packed)
    assert m.has(h).all() and m.has(~h).mean() < 0.05
