"""Toxicity: the label model on votes of known rates, held-out accuracy, what labels are looked at, edges."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolith.llm import registry, toxicity

from test_llm import ODD


def test_label_model():
    """Rates come back from votes alone; a voter that repeats another is found to be correlated and counts half."""
    rng = np.random.default_rng(4)
    n, prior = 200_000, 0.15
    y = rng.random(n) < prior
    toxic, clean = np.array([0.6, 0.4, 0.5, 0.3, 0.55, 0.2]), np.array([0.01, 0.02, 0.005, 0.03, 0.1, 0.2])
    v = (rng.random((n, 6)) < np.where(y[:, None], toxic, clean)).astype(int)
    v = np.column_stack([v, np.where(rng.random(n) < 0.9, v[:, 0], rng.random(n) < 0.1), v[:, :4].sum(1) == 0])
    m = toxicity.LabelModel(v.sum(0).astype(float), (v.T @ v).astype(float), n, prior)
    assert np.abs(m.toxic[:6] - toxic).max() < 0.08 and np.abs(m.clean[:6] - clean).max() < 0.03
    assert m.correlated[0, 6] > 0.2 and m.weight[-1] < 0 and abs(m.weight[5]) < 0.2
    assert ((m.log_odds(v) > 0) == y).mean() > 0.93
    one, both = np.zeros((1, 8)), np.zeros((1, 8))
    one[0, 0] = both[0, 0] = both[0, 6] = 1
    assert m.log_odds(both)[0] - m.log_odds(one)[0] < 0.8 * m.weight[6]


def test_with_labels():
    post = toxicity.with_labels(np.array([4.0] * 50 + [-4.0] * 50 + [0.0, 0.0]), np.array([1.0] * 50 + [0.0] * 50 + [1.0, 0.0]))
    assert post[-2] > 0.9 > 0.1 > post[-1]


def test_disguises():
    hidden = lambda t: toxicity.Lexicon([]).counts(t)[2]
    assert all(map(hidden, ("you 1d10t", "so $tupid", "what a m o r o n!", "M.O.R.O.N", "a l0ser"))) and not any(map(hidden, ("plain text of 12 words", "a b c d e", "idiot", "", "$5 @ 3")))


def corpus(spark, n=1500, seed=1):
    """Invented words; toxic rows hold marked words of two stems, some labels are wrong, copies repeat."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randrange(30, 300))]
        y = rng.random() < 0.15
        if y:
            for _ in range(rng.randrange(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(["zorvek", "quilbra"]) + rng.choice(syllables))
        rows.append((i, " ".join(text), int(y)))
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "x", None) for d, t, _ in rows], "doc_id long, text string, y string, entries int")
    labels = spark.createDataFrame([(d, y if rng.random() > 0.02 else 1 - y) for d, _, y in rows if d % 2], "doc_id long, toxic int")
    return docs, labels, {d: y for d, _, y in rows}


def test_corpus(spark):
    docs, labels, truth = corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert np.mean([r["predicted"] == truth[d] for d, r in got.items()]) > 0.99
    # Neither held-out labels nor the layout matter.
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.repartition(7), flipped.repartition(5)).collect()}
    assert max(abs(again[d] - r["score"]) for d, r in got.items()) < 1e-6
    same = [r["score"] for d, r in got.items() if d == 0 or d >= 1500]
    assert len(set(same)) == 1


def test_bounded_sample(spark):
    docs, labels, truth = corpus(spark, seed=2)
    got = toxicity.score_toxicity(docs, labels, max_labelled=300).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.97


def test_edges(spark):
    rows = [(i, t, "a") for i, t in enumerate(ODD)] + [(None, "you stupid moron", "a"), (None, None, None), (1, "again", "b"), (900, "the quiet sea", "c"), (901, "la " * 400_000 + "moron", "c"), (902, "YOU IDIOT !!!!", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    none = spark.createDataFrame([(0, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, none)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["score"] is not None for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["predicted"] == 0 and by[902]["predicted"] == 1 and sorted(r["predicted"] for r in got if r["doc_id"] is None) == [0, 1]
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None)
    few = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (3, 1), (3, 1), (14, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, few).count() == len(rows)
    assert toxicity.score_toxicity(docs.limit(0), few).count() == 0
    assert toxicity.score_toxicity(docs, none.limit(0)).count() == len(rows)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no such tables here")
def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = registry.op13_toxicity(spark, d).where("held_out").join(labels, "doc_id").toPandas()
    hit = int((got["toxic"] & got["predicted"]).sum())
    assert hit / got["predicted"].sum() > 0.93 and hit / got["toxic"].sum() > 0.88
