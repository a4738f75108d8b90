"""The pipeline stage by stage against brute force, over the documents of the test tables and odd rows."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from arbolith.llm import leaks, lines, quality
from arbolith.llm.files import tokenizer

from test_llm import ODD, brute_links, key


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The tables, with odd documents, rows that repeat and a column that clashes with names inside the operators."""
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(30))
    rows = [(10_000_000 + i, t, "en", "odd", len(t or "")) for i, t in enumerate([*ODD, long, long, long + " end", None])] + [(None, long + " other", "en", None, 1), (10_000_000, long.upper(), None, "odd", None)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more).selectExpr("*", "doc_id AS node", "source AS host", "lang AS term").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def row_of(r):
    return (r["doc_id"], r["text"], r["source"], r["n_chars"], r["host"], r["term"])


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    # Quality: what quality_rules() rejects goes, each row by its own text.
    verdict = {t: k for t, k in ((r["text"], r["kept"]) for r in docs.select("text", quality.quality_column(quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))("text").alias("q")).select("text", "q.kept").collect())}
    before = docs.collect()
    docs = corpus_pipeline.written(stages["quality_rules"](spark, docs, folder), "t")
    assert docs.columns == columns
    want = [row_of(r) for r in before if verdict[r["text"]]]
    assert sorted(map(row_of, docs.collect()), key=key) == sorted(want, key=key) and 0 < len(want) < len(before)

    # Lines: as the SQL says.
    table = docs.toArrow()
    con = duckdb.connect()
    con.register("documents", table)
    clean = sorted(((r[0], r[4]) for r in con.sql(lines.LINE_DEDUP_SQL).fetchall()), key=key)
    docs = corpus_pipeline.written(stages["line_dedup"](spark, docs, folder), "t")
    after = docs.collect()
    assert docs.columns == columns and sorted(((r["doc_id"], r["text"]) for r in after), key=key) == clean
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["doc_id"] is not None and r["doc_id"] < 10_000_000)

    # Near duplicates: of each class the least id.
    links = {d: c for d, c, _ in brute_links([(r["doc_id"], r["text"]) for r in after])}
    docs = corpus_pipeline.written(stages["ngram_jaccard_join"](spark, docs, folder), "t")
    kept = docs.collect()
    assert docs.columns == columns and sorted((r["doc_id"] for r in kept), key=lambda x: (x is None, x)) == sorted((r["doc_id"] for r in {(r["doc_id"], r["text"]): r for r in after}.values() if r["doc_id"] is None or links[r["doc_id"]] == r["doc_id"]), key=lambda x: (x is None, x))

    # Decontamination: verbatim copies go, documents that share no five words in a row with any item stay.
    items = [leaks.terms_of(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 5]) for w in items for i in range(len(w) - 4)}
    docs = corpus_pipeline.written(stages["decontamination"](spark, docs, folder), "t")
    left = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert docs.columns == columns
    for r in kept:
        w = leaks.terms_of(r["text"])
        joined = " " + " ".join(w) + " "
        if any(" " + " ".join(i) + " " in joined for i in items if i):
            assert (r["doc_id"], r["text"]) not in left
        elif grams.isdisjoint(tuple(w[i : i + 5]) for i in range(len(w) - 4)):
            assert (r["doc_id"], r["text"]) in left

    # Encoding: as the library.
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((d, len(i := sp.encode(t)), sha(",".join(map(str, i))), sha(sp.decode(i))) for d, t in left), key=key)
    got = stages["sentencepiece"](spark, docs, folder)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=key) == want


def test_run_is_its_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "sentencepiece"]
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
