"""Operators against brute force, the libraries themselves, and edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from arbolith.llm import attention, jaccard, leaks, licenses, lines, packing, pieces, quality, quotes, registry, secrets
from arbolith.llm.common import words
from arbolith.llm.files import tokenizer

ODD = [None, "", " ", "\n\n", "  a  b ", "▁a ▁▁ b▁", "x\x00y", "日本 語\tA b　c", "ﬁ é é", "<|endoftext|> a <| b", "a\x1c!\x1d!", "Σας ΟΔΟΣ", "İstanbul ſecret K",
       "w" * 5000, "one two three four", "one two three four", "tab\x0bvt\x0cff"]


def docs_of(spark, sf, extra=True):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    if extra:
        rows = [(10_000_000 + i, t, "odd") for i, t in enumerate(ODD)] + [(10_000_003, "again", None), (None, "no id", "odd")]
        df = df.unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    return df.repartition(5)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return docs_of(spark, sf).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_secrets(docs, rows):
    got = sorted((tuple(r) for r in secrets.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=key)
    want = []
    for d, t in rows:
        s = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = [sum(x[1] == k for x in s) for k in range(3)]
        want.append((d, *n, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s)))))
    assert got == sorted(want, key=key) and sum(w[1] + w[3] for w in want) > 0


def test_secrets_model(spark):
    model = secrets.MarkovPair(secrets.labelled_samples(seed=1))
    held = [(s, y) for s, y in secrets.labelled_samples(2000, seed=99) if len(s) >= 20]
    right = np.mean([(model.score(s) >= 10) == y for s, y in held])
    assert right > 0.97
    df = spark.createDataFrame([(1, "key is Zq8fT2xLw9RmB4vNcY7pKs1d end"), (2, "get_user_account_information_handler"), (3, 'password = "hunter2hunter2" then TOKEN:abc, token=token=abcdefghijkl')], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(df).collect()}
    assert got == {1: "markov:7:31", 2: "", 3: "assign:0:26,assign:44:68"}


def test_pieces(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = sorted((tuple(r) for r in pieces.encode_pieces(docs, tokenizer("piece_bpe_32k.model")).collect()), key=key)
    want = []
    for d, t in rows:
        ids = sp.encode(t)
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert got == sorted(want, key=key)


def test_packing(docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    segments = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 2)
    got = [tuple(r) for r in packing.read_documents(segments, with_ids=True).orderBy("start").collect()]
    at = 0
    for (d, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())), got, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert r == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    files = packing.export(segments, str(tmp_path))
    assert sum(packing.Segment(open(f, "rb").read()).n_ids for f in files) == at


@pytest.mark.parametrize("bits", [16, 17])
def test_packing_random_access(spark, docs, rows, bits, monkeypatch):
    """Widths that aren't whole bytes through the query's path, and ranges of ids out of the blocks that hold them."""
    monkeypatch.setattr(packing, "BLOCK", 512)
    monkeypatch.setattr(packing, "SEGMENT", 20_000)
    segments = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 2, bits=bits)
    got = {r["doc_id"]: r for r in packing.read_documents(segments, with_ids=True).collect()}
    assert segments.where("block = -1").count() > 3
    sizes = segments.where("block >= 0 AND n_ids = 512").selectExpr("max(length(data))").first()[0]
    assert sizes == 512 * bits // 8
    for d in sorted(k for k in got if k is not None and k != 10_000_003)[::40]:
        ids = got[d]["ids"]
        assert packing.read_ids(segments, d).tolist() == ids
        for i, j in ((0, 1), (3, 700), (max(0, len(ids) - 2), None), (600, 601), (len(ids), None), (5, 5)):
            assert packing.read_ids(segments, d, i, j).tolist() == ids[i:j]
    with pytest.raises(KeyError):
        packing.read_ids(segments, -5)
    plan = segments.where("block BETWEEN 2 AND 3")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(block,2)" in plan[plan.index("PushedFilters") :]


def test_queries_without_the_package_on_executors(sf, tmp_path):
    """Workers get all code by value: a session in another folder, whose workers can't import the package, runs every query."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.executorEnv.PYTHONPATH", "").getOrCreate()
from pyspark.sql import functions as F
from arbolith.llm import registry
import corpus_pipeline
def absent(it):
    import importlib.util
    yield from [importlib.util.find_spec("arbolith") is None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect() == [True]
for name, f in [*registry.queries().items(), ("pipeline", corpus_pipeline.run)]:
    assert f(spark, {sf!r}).count() > 0, name
    print(name)
"""
    import os

    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=900, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0 and len(out.stdout.split()) == 14, out.stderr[-3000:]


def test_word_table(monkeypatch):
    import random

    monkeypatch.setattr(packing, "TABLE_SIZE", 300)
    table = packing.WordTable(tokenizer("word_bpe_49k.json"))
    bits = ["a", "B", "é", "e\u0301", "Σ", "ß", "İ", "'s", "''", ",", ".", "!?", "1", "22", "½", "<", "|", "_", " ", "\n", "\t", "\xa0", "日", "\u200d", "😀", "</w>", "ĳ", "ª", "\x1c", "<|endoftext|>", "The", "x" * 70]
    draw = random.Random(1)
    texts = ["".join(draw.choices(bits, k=draw.randrange(40))) for _ in range(3000)]
    got = [x for at in range(0, len(texts), 100) for x in table.code(texts[at : at + 100])]
    assert got == table.whole(texts)


def test_packing_widths():
    rng = np.random.default_rng(0)
    for bits in (1, 3, 7, 8, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
        blocks = packing.packed(ids, bits)
        seg = packing.Segment(packing.image(*packing.head(bits, len(ids), len(blocks), [5, None], [4000, 6001]), blocks))
        assert (seg.ids() == ids).all() and (seg.ids(4090, 8200) == ids[4090:8200]).all() and (seg.doc(1) == ids[4000:]).all() and seg.doc_ids == [5, None]
    assert packing.width(49408) == 16 and packing.width(2) == 1 and packing.width(65537) == 17


def test_line_dedup(spark, sf, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.sql(lines.LINE_DEDUP_SQL).fetchall())
    got = sorted(tuple(r) for r in registry.op8_line_dedup(spark, sf).collect())
    assert got == [tuple(w) for w in want]
    rows = [(i, f"common line \nown {i}\n\n", "h") for i in range(20)] + [(20, None, None), (21, "", "h2"), (22, "common line", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in lines.line_dedup(df).collect()}
    assert out[3]["text"] == "own 3\n\n" and out[3]["n_dropped"] == 1 and out[20]["text"] == "" and out[22]["text"] == "" and out[21]["n_dropped"] == 0
    old, lines.BROADCAST_LINES = lines.BROADCAST_LINES, -1
    salted = {r["doc_id"]: r for r in lines.line_dedup(df).collect()}
    lines.BROADCAST_LINES = old
    assert salted == out


def test_quality(spark, sf, docs, rows):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = sorted((tuple(r) for r in quality.quality_rules(docs, labels).select("doc_id", *quality.BASE, "base_failed").collect()), key=key)
    want = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = list(zip(w, w[1:], w[2:]))
        cover = {k for i, x in enumerate(g) if g.count(x) > 1 for k in (i, i + 1, i + 2)} if len(w) < 700 else None
        n = len(cover) if cover is not None else quality.repeated_words(w)[0]
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, n, len(w) < 50 or 100 * n > 50 * len(w)))
    assert got == sorted(want, key=key)


def test_quality_held_out(spark, sf):
    from pyspark.sql import functions as F

    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.quality_rules(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").where(~F.col("base_failed")).collect()
    good = [r["kept"] for r in out if r["quality"] == 1]
    assert np.mean(good) > 0.97 and np.mean([r["kept"] == (r["quality"] == 1) for r in out]) > 0.95
    assert quality.train(docs, labels.where("quality = 1")) is None and quality.train(docs, labels.limit(0)) is None
    kept = quality.keep_quality(docs.withColumn("__x", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "__x"]


def test_trees_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 2))
    y = (x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) + 0.2 * rng.standard_normal(2000) < 0.5).astype(float)
    model = quality.BoostedTrees(falling=(0,)).fit(x, y)
    grid = np.c_[np.linspace(0, 1, 200), np.full(200, 0.4)]
    assert (np.diff(model.probability(grid)) <= 1e-12).all()
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85


def brute_links(rows, n=5, least=0.8):
    sets = []
    for _, t in rows:
        w = t.lower().encode().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None or not s:
            continue
        count = {}
        for x in s:
            for j in where[x]:
                if j < i and rows[j][0] is not None:
                    count[j] = count.get(j, 0) + 1
        for j, c in count.items():
            if c >= least * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
                root[b] = a
    return sorted(((d, None if d is None else rows[top(i)][0], links[i]) for i, (d, _) in enumerate(rows)), key=key)


def test_jaccard(docs, rows):
    got = sorted((tuple(r) for r in jaccard.jaccard_classes(docs).collect()), key=key)
    assert got == brute_links(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_jaccard_thresholds(spark, threshold, monkeypatch):
    """Recall of pairs about the threshold, in buckets that are split again and again."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    rng = np.random.default_rng(3)
    shared = [f"b{i}" for i in range(30)]  # a passage that all texts hold keeps them together for some levels
    rows = []
    for i in range(150):
        own = [f"u{i}_{j}" for j in range(90)]
        rows.append((2 * i, " ".join(shared + own)))
        cut = int(len(own) * (1 - threshold) / (1 + threshold) * rng.uniform(0.5, 1.2))
        rows.append((2 * i + 1, " ".join(shared + own[: 90 - cut] + [f"v{i}_{j}" for j in range(cut)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_classes(df, threshold=threshold, recall=0.999).collect()}
    want = {d: n for d, _, n in brute_links(rows, least=threshold)}
    assert sum(want.values()) >= 100 and all(got[d] <= want[d] for d in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_jaccard_runs():
    for t in (0.5, 0.8, 0.9):
        levels = np.zeros((3, jaccard.DEPTH))
        levels[0, 0], levels[1, 1], levels[2, 5] = 4, 7, 7
        k = np.random.default_rng(0).binomial(jaccard.LANES, t, 4000)
        lanes = [jaccard._lanes(r) for r in range(7)]
        for row, (runs, depth) in zip(jaccard.missed(levels, t), ((4, 1), (7, 2), (7, 6)), strict=True):
            rng = np.random.default_rng(1)
            misses = 0
            for n in k:
                equal = np.zeros(jaccard.LANES, bool)
                equal[rng.permutation(jaccard.LANES)[:n]] = True
                misses += not any(equal[x[:depth]].all() for x in lanes[:runs])
            assert abs(misses / 4000 - row) < 0.03
    assert jaccard.bar(0.8) == pytest.approx(0.6) and jaccard.missed(np.eye(jaccard.DEPTH)[1] * jaccard.runs_for(0.999, 0.8), 0.8) <= 0.001


def test_jaccard_edges(spark):
    """Clashing columns, null ids, empty texts, ids that repeat with the same and with another text."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a.upper()), (2, a), (3, b), (3, b), (4, None), (5, ""), (6, " "), (None, a), (None, None), (7, b + " tail"), (8, "x y"), (8, "z z z")]
    df = spark.createDataFrame([(d, t, 0, "q") for d, t in rows], "k long, text string, doc_id int, text_key string")
    got = sorted(((r["k"], r["text"]) for r in jaccard.keep_one(df, "k").collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (4, None), (5, ""), (6, " "), (None, a), (None, None), (8, "x y"), (8, "z z z")], key=repr)
    assert jaccard.keep_one(df, "k").columns == df.columns
    assert jaccard.keep_one(df.limit(0), "k").count() == 0


def test_jaccard_large_groups(spark, monkeypatch):
    """Buckets that can't be split, dealt out in blocks, lose and double no link."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        w[int(rng.integers(120))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, "the same text that is copied here") for i in range(30)] + [(300 + i, " ".join(f"u{i}_{j}" for j in range(40))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_classes(df).collect())
    assert got == [tuple(x) for x in brute_links(rows)]
    kept = jaccard.keep_one(df.unionByName(df.limit(0)))
    assert kept.count() == 22 and kept.columns == ["doc_id", "text"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (200, 150), (7, 7)]
    got = {r["u"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[103] == 100 and got[101] == 100 and got[200] == 150


def test_leaks(spark, sf, docs, rows):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], leaks.terms_of(r["text"])) for r in bench.collect()]
    got = {r["doc_id"]: r["items"] for r in leaks.find_leaks(docs, bench).collect()}
    want = {}
    for d, t in rows:
        joined = " " + " ".join(leaks.terms_of(t)) + " "
        want[d] = sorted({i for i, w in items if w and " " + " ".join(w) + " " in joined})
    assert sum(map(bool, want.values())) > 0
    assert [d for d in want if not set(want[d]) <= set(got[d])] == []
    assert sum(bool(got[d]) and not want[d] for d in want) <= 0.01 * len(want)


def test_leaks_paraphrase(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"term{i}" for i in range(3000)]
    text = lambda n: [vocabulary[i] for i in rng.integers(3000, size=n)]
    items = [text(40) for _ in range(30)]
    rows = [(i, " ".join(text(300))) for i in range(150)]
    for i, it in enumerate(items):
        changed = [f"other{k}" if k % 5 == 0 and k < 28 else w for k, w in enumerate(it)]
        rows.append((1000 + i, " ".join([*text(150), *changed, *text(90)])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, ""), (98, None)], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in leaks.find_leaks(df, bench).collect()}
    assert np.mean([got[1000 + i] == [i] for i in range(30)]) >= 0.9 and not any(got[i] for i in range(150))
    assert leaks.find_leaks(df, bench.limit(0)).where("contaminated").count() == 0 and leaks.find_leaks(df.limit(0), bench).count() == 0
    assert leaks.keep_clean(df.withColumn("extra", df.doc_id), bench).columns == ["doc_id", "text", "extra"]


def leaks_text(rng, n, size=8000):
    """Words with the frequencies of a language: the k-th is met 1/k as often."""
    return [f"term{int(x)}" for x in np.exp(rng.random(n) * np.log(size))]


def found_leaks(spark, texts, items, **bars):
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    return {r["doc_id"]: set(r["items"]) for r in leaks.find_leaks(df, bench, **bars).collect()}


@pytest.mark.parametrize("n", [300, 1500, 5000])
def test_leaks_many_items(spark, n):
    """Verbatim copies are all found, paraphrases nearly all, however many items there are."""
    rng = np.random.default_rng(6)
    texts = [leaks_text(rng, 200) for _ in range(n)]
    begin, size = rng.integers(140, size=n), rng.integers(15, 61, size=n)
    items = [t[a : a + k] for t, a, k in zip(texts, begin, size, strict=True)]
    for i in range(0, n, 2):  # each fourth word of the first three quarters is another one
        a, k = int(begin[i]), len(items[i])
        texts[i] = [f"other{j}" if a <= j < a + 3 * k // 4 and (j - a) % 4 == 1 else w for j, w in enumerate(texts[i])]
    got = found_leaks(spark, texts, items)
    assert [i for i in range(1, n, 2) if i not in got[i]] == []
    assert np.mean([i in got[i] for i in range(0, n, 2)]) >= 0.9
    assert np.mean([got[i] <= {i} for i in range(n)]) > 0.98


def test_leaks_latent(spark, monkeypatch):
    """Words that only the corpus shows to be alike lead to paraphrases without the item's rare words; at random directions they don't, at a bar of 0.7."""
    rng = np.random.default_rng(9)

    def text(topic, n, names="ab"):
        plain = [f"t{topic}w{k}" for k in rng.integers(150, size=n)]
        return [f"{names[int(rng.integers(len(names)))]}{topic}n{int(rng.integers(1000))}" if x < 0.25 else w for x, w in zip(rng.random(n), plain, strict=True)]

    items, texts = [], [text(i % 4, 200) for i in range(500)]
    for i in range(60):
        names = set(rng.choice(30, 14, replace=False).tolist())
        items.append([f"a{i % 4}n{int(rng.integers(1000))}" if k in names else f"t{i % 4}w{int(rng.integers(150))}" for k in range(40)])
        texts.append([*text(i % 4, 80), *(f"b{w[1:]}" if w[0] == "a" else w for w in items[i]), *text(i % 4, 60)])
    got = found_leaks(spark, texts, items, latent=0.7)
    assert np.mean([i in got[500 + i] for i in range(60)]) >= 0.9 and not any(got[i] for i in range(500))
    monkeypatch.setattr(leaks, "factor", lambda z, gauss: (np.linalg.qr(np.random.default_rng(1).standard_normal(z.shape))[0], np.ones(z.shape[1])))
    got = found_leaks(spark, texts, items, latent=0.7)
    assert np.mean([i in got[500 + i] for i in range(60)]) <= 0.6


@pytest.mark.parametrize("floor", [0.0, 0.2, 0.5])
def test_leaks_index(floor):
    """The pruned search finds the pairs of a dense table, with short, long, repeated and common parts among them."""
    rng = np.random.default_rng(4)
    draw = lambda n: np.minimum(rng.zipf(1.3, n), 900) - 1
    bench = leaks.Benchmark([(i, [f"w{x}" for x in draw(int(rng.integers(1, 150)))]) for i in range(300)])
    idf = np.where(rng.random(bench.size) < 0.1, 0.0, rng.random(bench.size) * 8)
    index = leaks.Index(bench, idf, np.zeros((bench.size, 0), np.float32), 2.0, floor, floor)
    term = np.minimum(draw(3000), bench.size)
    block, n = np.arange(3000) // leaks.STEP, 94
    got = {(p, i) for p, parts, _ in index.candidates(block, term, n) for i in parts.tolist()}
    square, dot = np.append(idf, 0.0) ** 2, np.zeros((n, len(bench.parts)))
    length = np.array([np.sqrt((np.bincount(t, minlength=bench.size) ** 2 * idf**2).sum()) for t in bench.parts])
    size = np.zeros(n)
    for p in range(n):
        words = np.bincount(term[(block == p) | (block == p + 1)], minlength=bench.size + 1)
        size[p] = np.sqrt((words * square).sum())
        dot[p] = [(words[:-1] * np.bincount(t, minlength=bench.size) * idf**2).sum() for t in bench.parts] / np.maximum(length, 1e-15)
    share = dot / np.maximum(np.minimum.outer(size, length), 1e-15)
    want = {(int(p), int(i)) for p, i in zip(*np.nonzero((share >= floor) & (dot > 1e-9)), strict=True)}
    assert want and want <= got and all(share[x] >= floor - 2e-4 for x in got)


def test_leaks_rare_words_replaced(spark, docs):
    """Parts of real texts, 13 of the rarest of whose first 30 words are replaced by common ones: what the rule accepts is found."""
    rng, texts = np.random.default_rng(3), [(r["doc_id"], leaks.terms_of(r["text"])) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    df = Counter(w for _, t in texts for w in set(t))
    common, pool, items, home = [w for w, _ in df.most_common(2000)], [(d, t) for d, t in texts if len(t) >= 60], [], []
    while len(items) < 100:
        d, t = pool[rng.integers(len(pool))]
        at = int(rng.integers(0, len(t) - 40))
        item = list(t[at : at + 40])
        for j in sorted(range(30), key=lambda j, item=tuple(item): df[item[j]])[:13]:
            item[j] = common[rng.integers(len(common))]
        items.append(item)
        home.append(d)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: set(r["items"]) for r in leaks.find_leaks(docs, bench).collect()}
    assert sum(i in got[d] for i, d in enumerate(home)) >= 95


def plain_leaks(texts, items):
    """Each item is held against all of each text."""
    out = []
    for t in texts:
        found = {}
        for i, w in items:
            for at in range(len(t) - len(w) + 1):
                if t[at : at + len(w)] == w:
                    found[i] = 1.0
                    break
        out.append(found)
    return out


def test_leaks_groups_and_edges(spark, monkeypatch):
    """A benchmark in groups gives what one pass gives; null ids, repeated rows and items, clashing columns, long texts."""
    rng = np.random.default_rng(11)
    words = [leaks_text(rng, 150) for _ in range(80)]
    words[7] = leaks_text(rng, 200_000)
    items = [(k, words[k][20:50]) for k in range(0, 60)] + [(60, words[3][20:50]), (3, words[3][20:50]), (61, words[7][150_000:150_040]), (62, ["the"])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, "x y z"), (70, None), (71, ""), (72, "...")], "item_id long, text string")
    rows = [(i, " ".join(w), i) for i, w in enumerate(words)] + [(None, " ".join(words[5]), 0), (5, " ".join(words[5]), 0), (200, None, 0), (201, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, term long").repartition(3)
    read = lambda: sorted(((r["doc_id"], r["items"]) for r in leaks.find_leaks(df, bench).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    one = read()
    want = plain_leaks([leaks.terms_of(r[1]) for r in rows], items)
    assert one == sorted(((r[0], sorted(w)) for r, w in zip(rows, want, strict=True)), key=lambda x: (x[0] is None, x[0] or 0))
    monkeypatch.setattr(leaks, "GROUP_TERMS", 500)
    assert read() == one
    kept = leaks.keep_clean(df.withColumn("c0", df.doc_id).withColumn("items", df.term), bench)
    assert kept.columns == ["doc_id", "text", "term", "c0", "items"] and kept.count() == sum(not w for w in want)


def test_leaks_hot_copies(spark):
    rng = np.random.default_rng(7)
    texts = [leaks_text(rng, int(rng.integers(40, 151))) for _ in range(400)]
    texts[0] = leaks_text(rng, 60)
    items = [t[5:35] for t in texts[:50]]
    texts[200:] = [texts[0]] * 200
    got = found_leaks(spark, texts, items)
    assert [i for i in range(50) if i not in got[i]] == [] and [i for i in range(200, 400) if 0 not in got[i]] == []


def test_leaks_long_items(spark):
    rng = np.random.default_rng(8)
    texts = [leaks_text(rng, 900) for _ in range(200)]
    items = [t[100 : 100 + (300, 500)[i % 2]] for i, t in enumerate(texts)]
    for i in range(100, 200):  # every third word changed, every sixth in the answer
        n = len(items[i])
        texts[i] = [f"other{k}" if 100 <= k < 100 + n and k % (3 if k < 100 + n * 3 // 4 else 6) == 0 else w for k, w in enumerate(texts[i])]
    got = found_leaks(spark, texts, items)
    assert [i for i in range(200) if got[i] != {i}] == []


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nI use a list."), (1, 1, "bot", "> How do I sort?\nCall sorted()."), (1, 2, "user", "On Monday bot wrote:\n> > how do  I sort?\n> Call sorted().\n\nThanks."),
        (1, 3, "user", "Another thing."), (1, 4, "bot", "> I use a list.\nUse a heap."), (2, 0, "user", "> never said\nhm"), (2, 1, None, None), (None, 5, "user", "x"), (2, None, "user", "y"), (3, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", quotes.F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    assert len(got) == len(rows)
    at = lambda *k: (got[k]["parent_turn"], got[k]["thread_turn"], got[k]["depth"], got[k]["position"])
    assert at(1, 1) == (0, 0, 1, 1) and at(1, 2) == (1, 0, 2, 2) and at(1, 4) == (0, 0, 1, 3) and at(1, 3) == (None, 3, 0, 4)
    assert got[1, 2]["text"] == "Thanks." and got[1, 2]["n_quotes"] > 0 and got[2, 0]["parent_turn"] is None and got[2, 1]["position"] == 1
    assert got[None, 5]["position"] is None and got[2, None]["position"] is None
    whole = {r["conv_id"]: [m["text"] for m in r["messages"]] for r in quotes.conversations(quotes.link_quotes(df)).collect()}
    assert whole[1] == ["How do I sort?\nI use a list.", "Call sorted().", "Thanks.", "Use a heap.", "Another thing."]


def test_quotes_positions(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = []
    for t in range(60):
        rows.append((1, t, "u", f"message number {t}" if t % 3 == 0 or t < 5 else f"> message number {int(rng.integers(0, t))}\nmessage number {t}"))
    got = [tuple(r) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("thread_turn", "turn", "position", "parent_turn", "depth").collect()]
    assert [g[2] for g in sorted(got)] == list(range(60))
    for th, t, _, p, depth in got:
        said = re.match(r"> message number (\d+)", rows[t][3])
        assert p == (int(said[1]) if said else None) and (depth == 0) == (p is None) and (th == t) == (p is None)


def plain_key(text):
    return " ".join(text.split()).lower()


def plain_links(messages):
    """For each text of one conversation, the turn it answers: a reading of the rules without hashes, joins or sets."""
    said, asked = [], []
    for text in messages:
        rows = []
        for line in text.split("\n"):
            m = re.match(r"[ \t]*((?:>[ \t]*)+)(.*)$", line, re.S)
            rows.append((m[1].count(">"), m[2]) if m else (0, line))
        runs = []
        for d, x in rows:
            if runs and runs[-1][0] == d:
                runs[-1][1].append(x)
            else:
                runs.append((d, [x]))
        own = [" ".join(xs) for d, xs in runs if d == 0] + [x for d, xs in runs if d == 0 for x in xs] + [" ".join(x for d, x in rows if d == 0)]
        said.append([plain_key(x) for x in own if plain_key(x)])
        asked.append([(-d, 1, len(xs), plain_key(" ".join(xs))) for d, xs in runs if d] + [(-d, 0, 1, plain_key(x)) for d, xs in runs if d for x in xs])
    out = []
    for t, quotes_ in enumerate(asked):
        found = []
        for outer, whole, n, k in quotes_:
            first = next((u for u in range(len(messages)) if k and k in said[u]), None)
            if first is not None and first < t:
                found.append((outer, whole, n, first))
        out.append(max(found)[3] if found else None)
    return out


def test_quotes_nested_only(spark):
    """A quote two deep links where no outer one does, and yields to one that does; rows without a turn are spread and unlinked."""
    rows = [(1, 0, "u", "How do I sort a list?"), (1, 1, "a", ">> How do I sort a list?"), (1, 2, "u", "other words"), (1, 3, "a", "> other words\n>> How do I sort a list?\nso"), (1, 4, "a", "> unknown\n>> other words")]
    rows += [(None, None, "u", "same")] * 300 + [(1, None, "u", "> other words")] * 3
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert [r["parent_turn"] for r in sorted((r for r in got if r["turn"] is not None), key=lambda r: r["turn"])] == [None, 0, None, 2, 2]
    assert len(got) == len(rows) and all(r["position"] is None and r["parent_turn"] is None for r in got if r["turn"] is None)


def test_quotes_brute_force(spark):
    """Random conversations whose messages quote whole messages, single lines, and quotes in quotes."""
    rng = np.random.default_rng(12)
    talks = []
    for c in range(12):
        texts = []
        for t in range(40):
            own = [f"line {int(rng.integers(30))} of talk {c}" if rng.random() < 0.2 else f"talk {c} turn {t} line {k}" for k in range(int(rng.integers(1, 4)))]
            if texts and rng.random() < 0.7:
                old = texts[int(rng.integers(len(texts)))].split("\n")
                if rng.random() < 0.4:
                    old = [old[int(rng.integers(len(old)))]]
                marks = [">", " > ", ">> ", "> > >"][int(rng.integers(4))]  # some are nested only
                quoted = [marks + (x.upper() if rng.random() < 0.1 else x) for x in old]
                own = quoted + own if rng.random() < 0.8 else own + quoted + [f"tail {c} {t}"]
            texts.append("\n".join(own))
        talks.append(texts)
    df = spark.createDataFrame([(c, t, "u", x) for c, texts in enumerate(talks) for t, x in enumerate(texts)], "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    links = 0
    for c, texts in enumerate(talks):
        parents = plain_links(texts)
        thread, depth = [], []
        for t, p in enumerate(parents):
            thread.append(t if p is None else thread[p])
            depth.append(0 if p is None else depth[p] + 1)
            r = got[c, t]
            assert (r["parent_turn"], r["thread_turn"], r["depth"]) == (p, thread[t], depth[t])
            links += p is not None
        order = sorted(range(len(texts)), key=lambda t: (thread[t], t))
        assert [got[c, t]["position"] for t in order] == list(range(len(texts)))
    assert links > 100


def plain_patience(a, b):
    """Patience alignment by its definition: common ends, unique common words, the longest rising run by trying all, gaps again."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    pairs = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not pairs:
        return n + (lcs(a, b) if a and b else 0)
    best = []
    for k, (i, j) in enumerate(pairs):
        length, back = max(((best[m][0], m) for m in range(k) if pairs[m][1] < j), default=(0, -1))
        best.append((length + 1, back))
    k = max(range(len(best)), key=lambda m: best[m][0])
    most, runs = best[k][0], []
    while k >= 0:
        runs.append(pairs[k])
        k = best[k][1]
    i = j = 0
    for x, y in runs[::-1]:
        n += 1 + plain_patience(a[i:x], b[j:y])
        i, j = x + 1, y + 1
    return n + plain_patience(a[i:], b[j:]) if most else n


def test_patience():
    rng = np.random.default_rng(7)
    same = 0
    for _ in range(300):
        b = list(map(str, rng.integers(60, size=rng.integers(1, 40))))
        a = [w for w in b if rng.random() > 0.2]
        a[len(a) // 2 : len(a) // 2] = list(map(str, rng.integers(60, size=rng.integers(0, 12))))
        got, want = licenses.aligned(a, b), plain_patience(a, b)
        same += got == want  # of equally long runs of anchors, either may be taken, and gaps differ then
        assert got <= lcs(a, b) and abs(got - want) <= 3
    assert same >= 280


def test_licenses_brute_force(rows):
    """The scanner's regions against plain alignments with windows all over each text."""
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    rng = np.random.default_rng(1)
    texts = [t for _, t in rows if len(t) < 3000][:60]
    for name, t in licenses.TEMPLATES.items():
        w = t.split()
        for share in (0.0, 0.1, 0.3):
            changed = [x if rng.random() >= share else f"zz{int(rng.integers(99))}" for x in w]
            texts.append(" ".join([*(texts[0].split()[:50]), *changed, *(texts[1].split()[:50])]))
    for text in texts:
        found = licenses.tokens(text)
        got = {x[0]: x[1] for x in scanner.scan(text)}
        for name, t in scanner.templates.items():
            n = len(t)
            best = max((plain_patience(found[s : s + 4 * n], t) / n for s in range(0, max(1, len(found) - n), 2 * n) if len(set(t) & set(found[s : s + 4 * n])) >= 0.7 * len(set(t))), default=0.0)
            if best >= 0.83:
                assert name in got, (name, best)
            if name in got:
                assert best >= got[name] - 0.05


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (list(map(str, rng.integers(6, size=rng.integers(1, 40)))) for _ in range(2))
        assert licenses.common_subsequence(a, b) == lcs(a, b) >= licenses.aligned(b, a)


def test_licenses(spark, docs, rows):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    short = {k: licenses.tokens(v) for k, v in licenses.TEMPLATES.items() if k.endswith("notice")}
    n = 0
    for d, t in rows:
        found = " " + " ".join(licenses.tokens(t)) + " "
        want = {k for k, w in short.items() if " " + " ".join(w) + " " in found}
        n += len(want)
        assert want <= set(got[d]["licenses"].split(","))
    assert n > 0
    scan = licenses.Scanner(licenses.TEMPLATES, 0.8).scan
    filler = " ".join(f"lorem{i} the of" for i in range(400))
    changed = licenses.TEMPLATES["MIT"].replace("merge, ", "").replace("Software", "Program").replace("granted", "given")
    assert [x[0] for x in scan(filler + " " + changed + "\n" + filler)] == ["MIT"]
    twice = (licenses.TEMPLATES["Apache-2.0-header"] + " ") * 3
    assert ("Apache-2.0-header", 1.0) in [x[:2] for x in scan(twice)]
    assert scan(filler) == [] and scan("") == []


def test_licenses_whole(spark):
    two, three, mit, isc = (licenses.TEMPLATES[k] for k in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"))
    half = mit[: mit.index("THE SOFTWARE IS")]
    df = spark.createDataFrame(list(enumerate([two, three, mit, isc, half, isc[: isc.index("THE SOFTWARE IS")]])), "doc_id long, text string")
    got = {r["doc_id"]: (r["best_license"], r["best_coverage"]) for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(6)] == [("BSD-2-Clause", 1.0), ("BSD-3-Clause", 1.0), ("MIT", 1.0), ("ISC", 1.0), (None, 0.0), (None, 0.0)]
    assert "endorse" in three and "endorse" not in two


def test_attention_base(spark, sf, docs, rows):
    import math
    from collections import Counter

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    tokens = [[*words((t or "").translate(lower)), None] for _, t in rows]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    got = sorted((tuple(r) for r in attention.score_documents(docs).collect()), key=key)
    want = sorted(((d, h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (d, _), h, t in zip(rows, held, tokens, strict=True)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] < 0 for g in got)


def held_out_means(spark, sf):
    from pyspark.sql import functions as F

    got = attention.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out")
    return got.agg(F.sum("base_score") / F.sum("n_tokens"), F.sum("score") / F.sum("n_tokens")).first()


def test_attention_beats_base(spark, sf):
    base, own = held_out_means(spark, sf.replace("0.001", "0.01"))
    assert own > base + 0.05


@pytest.mark.skipif("not config.getoption('--large', default=False)")
def test_attention_beats_base_large(spark, sf):
    base, own = held_out_means(spark, sf.replace("0.001", "0.1"))
    assert own > base + 0.2


def test_attention_layout(spark, sf, monkeypatch):
    """The model follows from the rows, however many partitions they are in, with one shard and with several."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for tokens in (attention.SHARD, 8_000):
        monkeypatch.setattr(attention, "fit", lambda *a, fit=FIT, tokens=tokens: fit(*a, tokens=tokens))
        of = lambda n: {r["doc_id"]: r["score"] for r in attention.score_documents(df.repartition(n, "doc_id")).collect()}
        one, some, many = of(1), of(8), of(64)
        assert all(abs(one[d] - s) <= 1e-3 * max(1, abs(s)) for other in (some, many) for d, s in other.items())


FIT = attention.fit


def test_attention_chosen(spark):
    """Of each text one window at least and about one in `every`; each in one round, one shard and whole."""
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 50, 400).astype(float)
    classes = attention.Classes(counts, rng.integers(0, 3, (400, 2 * attention.NEAR)).astype(np.float32))
    texts = [rng.integers(0, 400, n).astype("<u2").tobytes() for n in (1, 5, 16, 17, 400, 9_000)]
    df = spark.createDataFrame([(i, True, bytearray(t), bytearray(t)) for i, t in enumerate(texts)], "doc_id long, train boolean, first binary, last binary")
    windows = sum(-(-len(t) // 2 // attention.FRESH) for t in texts)
    for every, n in ((1, windows), (4, None)):
        got = [r for k in range(3) for r in attention.chosen(df, classes, "<u2", every, 3, k, 5).collect()]
        assert len({(r["place"], bytes(r["blob"])) for r in got}) == len(got) and {r["shard"] for r in got} == set(range(5))
        assert len(got) == n if n else abs(len(got) - windows / 4) < 8


def test_attention_windows(spark, monkeypatch):
    """The rounds train on each window of each training text once."""
    rows = [(i, " ".join(f"w{k}" for k in range(i % 300))) for i in range(600)]
    seen = []
    symbols = np.arange(40_000) % attention.OWN
    classes = type("C", (), {"symbol": symbols, "of": np.zeros(40_000, int)})()
    texts = [np.arange(i % 300 + 1, dtype="<u2") for i in range(600)]
    x, l, y, begin, pad, owner = attention.cut([symbols[t] for t in texts], [symbols[t] for t in texts], [classes.of[t] for t in texts], 7)
    assert (y[(begin[:, None] + np.arange(attention.WINDOW - attention.FRESH, attention.WINDOW)).ravel()] >= 0).sum() == sum(map(len, texts))
    for r in range(attention.ROUNDS):
        seen += np.flatnonzero(np.arange(len(begin)) % attention.ROUNDS == r).tolist()
    assert sorted(seen) == list(range(len(begin))) and len(rows) == len(texts)


def test_attention_sums_to_one(spark):
    """Over all known words, unknown spellings and the end, probabilities after a context sum to 1."""
    vocabulary = 50
    rng = np.random.default_rng(0)
    spelled = {tuple(rng.integers(vocabulary, size=rng.integers(1, 3)).tolist()) for _ in range(40)}
    words_ = [(bytes([i]), int(rng.integers(0, 5)), w) for i, w in enumerate(sorted(spelled))]
    df = spark.createDataFrame([(w, n, i[0], i[-1], np.array(i, "<u4").tobytes()) for w, n, i in words_], "word binary, n long, first int, last int, ids binary").selectExpr("*", "true as lead")
    pairs = {(r["a"], r["b"]): r["n"] for r in attention.id_pairs(df, vocabulary).collect()}
    got = {r["word"]: r for r in attention.with_spelling(df, vocabulary).collect()}
    kinds, seen, low = np.zeros(vocabulary + 2), np.zeros(vocabulary + 2), np.zeros(vocabulary + 2)
    for (a, b), n in pairs.items():
        kinds[a], seen[a], low[b] = kinds[a] + 1, seen[a] + n, low[b] + 1
    low = (low + 0.05) / (low.sum() + 0.05 * (vocabulary + 1))
    after = np.array([[(pairs.get((a, b), 0) + (kinds[a] + 0.5) * low[b]) / (seen[a] + kinds[a] + 0.5) for b in range(vocabulary + 1)] for a in range(vocabulary)])
    assert np.allclose(after.sum(1), 1)
    for w, n, i in words_:
        want = sum(np.log10(after[a, b]) for a, b in zip(i, [*i[1:], vocabulary], strict=True))
        assert got[w]["q"] == pytest.approx(want)
    for first in {i[0] for _, _, i in words_}:
        own = [(n, i) for _, n, i in words_ if i[0] == first]
        of, many = sum(n for n, _ in own), sum(n > 0 for n, _ in own)
        if of:
            known = sum(n / (of + many) for n, _ in own)
            assert known + many / (of + many) == pytest.approx(1)  # spellings from one first id have q = 1 in all, as each row of `after` sums to 1
    counts = rng.integers(0, 50, vocabulary + 1).astype(float)
    classes = attention.Classes(counts, rng.integers(0, 3, (vocabulary + 1, 2 * attention.NEAR)).astype(np.float32))
    assert np.allclose(np.bincount(classes.of, 10**classes.within, attention.CLASSES)[np.unique(classes.of)], 1)


def test_attention_words_over_batches(spark):
    """A word's rows may span batches of sorted rows."""
    import pyarrow as pa

    words_ = [b"a"] * 3 + [b"b"] * 700 + [b"c", b"d"] + [b"e"] * 5
    batches = [pa.RecordBatch.from_pydict({"word": pa.array(words_[i : i + 100], pa.binary()), "n": pa.array(range(i, i + len(words_[i : i + 100])))}) for i in range(0, len(words_), 100)]
    got = list(attention.runs_of(iter(batches)))
    assert [n for t in got for n in t["n"].to_pylist()] == list(range(len(words_)))
    sets = [set(t["word"].to_pylist()) for t in got]
    assert all(a.isdisjoint(b) for i, a in enumerate(sets) for b in sets[:i])
    assert list(attention.runs_of(iter([]))) == []


def test_attention_spelling_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(str(k).encode(), int(rng.integers(0, 3)), rng.integers(300, size=rng.integers(1, 6))) for k in range(400)]
    df = spark.createDataFrame([(w, n, int(i[0]), int(i[-1]), i.astype("<u4").tobytes()) for w, n, i in rows], "word binary, n long, first int, last int, ids binary").selectExpr("*", "true as lead")
    read = lambda: {r["word"]: r["q"] for r in attention.with_spelling(df, 300).collect()}
    whole = read()
    monkeypatch.setattr(attention, "PAIRS", 200)
    assert all(v == pytest.approx(whole[k]) for k, v in read().items())


def test_attention_model():
    rng = np.random.default_rng(0)
    net = attention.Net.new(20, np.full(12, 1 / 12), rng)
    net.w["u"] = rng.standard_normal(net.w["u"].shape).astype(np.float32) * 0.3
    x = rng.integers(0, 20, size=(7, attention.WINDOW, 2))
    y = rng.integers(0, 12, size=(7, attention.FRESH))
    pad = np.array([0, 3, 16, 0, 1, 15, 9])
    loss, grads = net.loss(x, y, pad)
    for k, w in net.w.items():
        w64 = w.astype(np.float64)
        at = tuple(int(rng.integers(s)) for s in w.shape)
        old = w64[at]
        ends = []
        for e in (1e-2, -1e-2):
            w[at] = old + e
            ends.append(net.loss(x, y, pad)[0])
        w[at] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - grads[k][at]) < 2e-3 + 0.05 * abs(grads[k][at]), k
    # Windows give each token the same score as a plain loop over its context.
    first, last = rng.integers(0, 20, size=(2, 45))
    classes = rng.integers(0, 12, size=45)
    for scale in (1, 30):  # sums of exponentials hold for large values too
        net.w["q"] *= scale
        net.tables = None
        whole = net.scores([first, first[:1]], [last, last[:1]], [classes, classes[:1]])
        plain, inputs, ends = 0.0, np.r_[20, first[:-1]], np.r_[20, last[:-1]]
        for i in range(45):
            begin = i // attention.FRESH * attention.FRESH - (attention.WINDOW - attention.FRESH)
            lo = max(0, begin)
            plain += net.plain(inputs[lo : i + 1].astype(int), ends[lo : i + 1].astype(int), max(0, -begin), classes[i])
        assert abs(whole[0] - plain) < 2e-3


def test_long_texts(spark, sf):
    """A text of over a megabyte beside short ones, through every operator of documents."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = np.random.default_rng(21)
    words_ = leaks_text(rng, 160_000)
    words_[100_000:100_000] = licenses.TEMPLATES["MIT"].split() + ["password=abcdefghijkl12"]
    long = "\n".join(" ".join(words_[i : i + 25]) for i in range(0, len(words_), 25))
    assert len(long) > 1_000_000
    rows_ = [(1, long, "h"), (2, long + " tail", "h"), (3, "short text", "h"), (4, long, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(2)
    of = lambda out: {r["doc_id"]: r for r in out.collect()}
    assert of(licenses.scan_licenses(df))[1]["best_license"] == "MIT" and of(secrets.scan_secrets(df))[1]["n_assign"] == 1
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    assert of(pieces.encode_pieces(df, tokenizer("piece_bpe_32k.model")))[1]["ids_sha256"] == sha(",".join(map(str, sp.encode(long))))
    ids = [*Tokenizer.from_file(tokenizer("word_bpe_49k.json")).encode(long, add_special_tokens=False).ids, 2]
    assert of(packing.read_documents(packing.pack_documents(df, tokenizer("word_bpe_49k.json"), 2)))[1]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    scored = of(attention.score_documents(df))
    assert scored[1]["n_tokens"] == len(long.split()) + 1 and scored[1]["score"] == pytest.approx(scored[4]["score"], rel=1e-3)
    assert {d: r["class_id"] for d, r in of(jaccard.jaccard_classes(df)).items()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert of(lines.line_dedup(df))[1]["text"] == long
    assert of(quality.quality_rules(df, spark.read.parquet(f"{sf}/labels.parquet")))[1]["n_words"] == len(long.split())
    bench = spark.createDataFrame([(0, " ".join(words_[150_000:150_030]))], "item_id long, text string")
    assert {d for d, r in of(leaks.find_leaks(df, bench)).items() if r["contaminated"]} == {1, 2, 4}


def test_conflicting_labels(spark, sf):
    """Labels of one id count as their mean, at a tie as the lower class, in whatever order they come."""
    docs_, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    tie = labels.unionByName(labels.selectExpr("doc_id", *[f"1 - {c} AS {c}" if c == "quality" else c for c in labels.columns if c != "doc_id"]))
    assert quality.train(docs_, tie) is None  # all are of the lower class
    most = tie.unionByName(labels)
    one, two = quality.train(docs_, most), quality.train(docs_, most.orderBy("quality").repartition(7))
    assert (one.value == two.value).all() and (one.value == quality.train(docs_, labels).value).all()


def test_empty(spark, sf):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for out in (secrets.scan_secrets(none), pieces.encode_pieces(none, tokenizer("piece_bpe_32k.model")), packing.read_documents(packing.pack_documents(none, tokenizer("word_bpe_49k.json"), 2)), lines.line_dedup(none),
                quality.quality_rules(none, labels), jaccard.jaccard_classes(none), licenses.scan_licenses(none), attention.score_documents(none)):
        assert out.count() == 0
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_masked_inputs_have_no_part():
    """What no position may look at gets no gradient, not even a tiny one; one window alone is a batch too, and batches of binary values come
    back as they went."""
    rng = np.random.default_rng(2)
    net = attention.Net.new(20, np.full(12, 1 / 12), rng)
    net.w["u"] = rng.standard_normal(net.w["u"].shape).astype(np.float32)
    back = attention.WINDOW - attention.FRESH
    x = rng.integers(0, 19, size=(5, attention.WINDOW, 2))
    y, pad = rng.integers(0, 12, size=(5, attention.FRESH)), np.array([back, 0, 3, 0, 0])
    x[0, :back] = 19  # a symbol that nothing else holds
    _, grad = net.loss(x, y, pad)
    assert not grad["e"][19].any() and not grad["l"][19].any() and grad["e"][:19].any()
    alone, g = net.loss(x[:1], y[:1], pad[:1])
    assert alone > 0 and all(np.isfinite(v).all() and v.shape == net.w[k].shape for k, v in g.items())
    rows = rng.integers(0, 99, (7, 5)).astype("<i2")
    assert (attention.table_of(attention.binaries(rows).slice(2, 4), "<i2") == rows[2:6]).all()


def test_terms_of_plain_chunks(monkeypatch):
    """Chunks that are one word are coded without a search, and as a search would; others too."""
    chunks = ["word", "word.", "wörd,", "x_y", "_", "a-b", "--", "3٣²", "é", "word_", "_word", "ab..", "(ab)", "ß", "", "."]
    vocabulary = {w: i for i, w in enumerate(sorted({w for c in chunks[:9] for w in leaks.TERM.findall(c)}))}
    want = {c: [vocabulary.get(w, len(vocabulary)) for w in leaks.TERM.findall(c)] for c in chunks}
    terms = leaks.Terms(vocabulary)
    assert {c: np.frombuffer(terms[c], "<u4").tolist() for c in chunks} == want
    monkeypatch.setattr(leaks, "TERM", None)
    assert [len(leaks.Terms(vocabulary)[c]) for c in ("word", "wörd,", "unknown")] == [4, 4, 4]


def test_terms_of_many_texts():
    """Texts coded together, whatever blanks, marks and letters are in them, have the terms of each alone."""
    import random

    import pyarrow as pa

    rnd, pool = random.Random(1), [*" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000", *"abcXYZ019__..--(),;'\"", *"ΣσςΑÉßİıǅ٣²½漢字\xad\u200b\u0301ﬁ"]
    texts = [None, "", " ", "\x1c", "--", *("".join(rnd.choices(pool, k=rnd.randint(0, 60))) for _ in range(3000))]
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts[::3] for w in leaks.terms_of(t)}))}
    code, want = leaks.Coder(vocabulary), [[vocabulary.get(w, len(vocabulary)) for w in leaks.terms_of(t)] for t in texts]
    column = pa.array(texts, pa.string())
    got = [np.frombuffer(t, "<u4").tolist() for at in range(0, len(texts), 512) for t in code(column.slice(at, 512)).to_pylist()]
    assert got == want and code(column.slice(0, 0)).to_pylist() == []


def test_leaks_judged_on_terms(spark, monkeypatch):
    """The last pass takes no texts along, and candidates are judged by their terms: no text is cut into words again, and order is looked
    for only where enough of the item's words are; what is found is what the whole comparison of words finds."""
    rng = np.random.default_rng(12)
    items = [(i, leaks_text(rng, 20 + i % 60, 300)) for i in range(80)]
    bench = leaks.Benchmark(items)
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert leaks.coded(df, bench).columns == ["doc_id", "term"]
    assert leaks.coded(df, leaks.Benchmark(items, last=False)).columns == ["doc_id", "text", "term"]
    want, got, calls = [], [], []
    for k in range(60):
        item = items[k % len(items)][1]
        kept = [w for j, w in enumerate(item) if j % (k % 5 + 2)]
        found = [*leaks_text(rng, 40 + k, 300), *(item if k % 3 else kept), *leaks_text(rng, 70, 300)]
        near = {i: list(range(0, len(found) // leaks.STEP)) for i in (k % len(items), (7 * k + 3) % len(items))}
        out: dict[int, float] = {}
        for i, at in near.items():
            w = items[i][1]
            for p in at:
                region = found[max(0, p * leaks.STEP - len(w)) : (p + 2) * leaks.STEP + len(w)]
                share, answer = leaks.common_subsequence(w, region) / len(w), w[-max(1, len(w) // 4) :]
                if share >= leaks.COPY or share >= leaks.PARAPHRASE and leaks.common_subsequence(answer, region) >= leaks.ANSWER * len(answer):
                    out[i] = max(out.get(i, 0.0), share)
        want.append(out)
        with monkeypatch.context() as m:
            m.setattr(leaks, "terms_of", None)
            m.setattr(leaks, "common_subsequence", lambda a, b, plain=leaks.common_subsequence: calls.append(1) or plain(a, b))
            got.append(leaks.held(bench, np.array([bench.vocabulary.get(w, bench.size) for w in found]), near))
    assert got == want and sum(map(len, want)) > 40 and len(calls) < sum(len(at) for at in near.values()) * 60 and (bench.spot == -1).all()


def test_attention_texts_in_blocks(spark, monkeypatch):
    """Texts of a block are coded together as each alone would be, over slices and blocks; a distinct word is one row, with its blocks; blocks
    get back what is known of their words in few rows."""
    from collections import Counter

    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("aAbÀ Z\t\n\x0b\x1c\x85\u2003"), rng.integers(0, 40))) for _ in range(700)]
    texts[300:300] = [""] * 400 + [" "] * 200  # slices without words
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(attention, "BLOCK_BYTES", 3000)
    got = attention.gather(df).toPandas()
    lower = lambda t: t.encode().lower().split()
    blank = df.where("doc_id BETWEEN 310 AND 340").repartition(1)
    assert attention.gather(blank).selectExpr("sum(kind)", "count(*)").first() == (0, blank.count())
    table = {b: g.set_index("k")["blob"].to_dict() for b, g in got[got.kind == 1].groupby("block")}
    back = Counter((None if np.isnan(r.k) else int(r.k), tuple(bytes(table[r.block][i]) for i in np.frombuffer(r.blob, "<u4"))) for r in got[got.kind == 0].itertuples() if len(r.blob) or r.block is not None)
    assert len(table) > 3 and back == Counter((i if i % 50 else None, tuple(lower(t))) for i, t in enumerate(texts))
    words_ = Counter(w for i, t in enumerate(texts) if not attention.held_out(i if i % 50 else None) for w in lower(t))
    want = Counter()
    for r in got[got.kind == 1].itertuples():
        want[bytes(r.blob)] += r.n
    assert +want == words_ and all(list(t) == list(range(len(t))) for t in table.values())
    path = tokenizer("word_bpe_49k.json")
    rows_ = spark.createDataFrame(got[got.kind == 1].rename(columns={"block": "at", "k": "i", "blob": "word"})[["at", "i", "n", "word"]].astype({"i": "int64"}), "at long, i long, n long, word binary")
    vocab = attention.coded(rows_, path, attention.WordTable(path).vocabulary)
    assert vocab.count() == len(want)
    schema = "at long, i binary, n binary, first binary, last binary, q binary"
    blocks = attention.with_spelling(vocab, attention.WordTable(path).vocabulary, attention.by_block, schema).collect()
    plain = attention.with_spelling(vocab, attention.WordTable(path).vocabulary).collect()
    known = {(a, i): (r["n"], r["first"], r["last"], r["q"]) for r in plain for a, i in zip(np.frombuffer(r["at"], "<i8").tolist(), np.frombuffer(r["i"], "<u4").tolist(), strict=True)}
    found = {(r["at"], k[0]): k[1:] for r in blocks for k in zip(*(np.frombuffer(r[c], t).tolist() for c, t in (("i", "<u4"), ("n", "<i8"), ("first", "<i4"), ("last", "<i4"), ("q", "<f8"))), strict=True)}
    assert found == known and set(known) == {(b, i) for b, t in table.items() for i in t}
