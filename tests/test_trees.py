"""Golden micro-cases of the tree operators."""

import json
import random

import pytest

from arbolith.operators import cluster, compare, expr, search
from arbolith.plans import registry
from arbolith.sources import store


def C(x, *us):
    return {"const": {"declName": x, "us": list(us)}}


def A(f, *xs):
    for x in xs:
        f = {"app": {"fn": f, "arg": x}}
    return f


def V(x):
    return {"fvar": {"fvarId": x}}


def E(op, a, b):
    return A(C("Eq", "u"), a, b)


add = lambda a, b: A(C("Nat.add"), a, b)
mul = lambda a, b: A(C("Nat.mul"), a, b)
v0, v1, v2 = V("v0"), V("v1"), V("v2")
T = {
    "T1": E("", add(v0, v1), add(v1, v0)), "T2": E("", mul(v0, v1), mul(v1, v0)), "T3": E("", add(add(v0, v1), v2), add(v0, add(v1, v2))),
    "T5": A(C("Not"), {"lit": {"literal": "Lean.Literal.natVal 1"}}), "T6": C("True"),
    "T7": A(C("instHAdd"), C("«term».x"), {"lam": {"binderName": "a", "binderType": C("Nat"), "body": {"bvar": {"deBruijnIndex": "a"}}, "binderInfo": "default"}}),
}
T["T4"] = {"forallE": {"binderName": "x", "binderType": A(C("Group", "u"), v0), "body": T["T1"], "binderInfo": "default"}}
PAIRS = [("T1", "T1", 1.0, 0.0, 1.0, 1.0, 1.0), ("T1", "T2", 1.0, 2.4, 1.0, 1.0, 0.926154), ("T1", "T3", 0.726870, 5.6, 0.523810, 1.0, 0.709507), ("T3", "T1", 0.726870, 5.6, 1.0, 1.0, 0.852364),
         ("T1", "T4", 0.592349, 2.4, 0.0, 0.666667, 0.532382), ("T1", "T5", 0.0, 5.2, 1.0, 0.0, 0.54), ("T5", "T1", 0.0, 5.2, 0.076923, 0.0, 0.263077), ("T6", "T6", 0.0, 0.0, 1.0, 1.0, 0.85),
         ("T1", "T6", 0.0, 6.4, 1.0, 0.0, 0.503077), ("T6", "T1", 0.0, 6.4, 0.0, 0.0, 0.203077), ("T7", "T1", 0.175412, 3.2, 0.230769, 0.333333, 0.447081), ("T1", "T7", 0.175412, 3.2, 0.571429, 0.333333, 0.549279), ("T7", "T5", 0.0, 1.6, 1.0, 0.0, 0.608571)]


@pytest.fixture(scope="module")
def corpus(spark):
    from arbolith.functions import wl

    rows = spark.createDataFrame([(k, json.dumps(v), k.lower()) for k, v in T.items()], "name string, expr_json string, statement_str string")
    return wl.encode(search.parse_trees(rows).where("error IS NULL"), 3).cache()


def test_encodings(corpus):
    got = {r["name"]: (len(r["nodes"]), r["tree_depth"], len(r["enc"]), sum(r["enc"].values()), r["norm2"]) for r in corpus.collect()}
    assert got["T1"] == (13, 4, 36, 39, 45) and got["T3"] == (21, 6, 53, 63, 89) and got["T5"] == (3, 1, 3, 3, 3) and got["T6"] == (1, 0, 0, 0, 0) and got["T7"] == (7, 2, 10, 14, 26) and got["T4"][2:] == (48, 51, 57)
    t5 = corpus.where("name = 'T5'").first()["enc"]
    assert set(t5) == {"0_4cff27540050c870e96e82bc9de614e8", "0_64d8b5fa8adfaecce15cd4e059240530", "0_3a43a0159f4e9b9af43d4a8e686cb5a2"}


@pytest.mark.parametrize("name", ["T1", "T3", "T5", "T6", "T7"])
def test_pairs(corpus, name):
    t = search.Target.of(corpus.where(f"name = '{name}'").select("name", "nodes", "node_count"))
    got = {r["name"]: r for r in search.ranked(corpus, t).collect()}
    for a, b, cos, ted, collapse, jac, full in PAIRS:
        if a == name:
            r = got[b]
            assert [round(r[k], 6) for k in ("wl", "ted", "collapse", "jaccard", "similarity")] == [cos, ted, collapse, jac, full], (a, b)


def test_batch_histograms(spark):
    """The Arrow encoder equals the Column functions on random trees, wide and deep ones, and null."""
    from pyspark.sql import functions as F

    from arbolith.functions import wl

    rng = random.Random(3)
    rows = [(-1, None)]
    for i in range(120):
        labels, kids = random_tree(rng, rng.choice([1, 2, 5, 30, 150]))
        if i % 10 == 0:
            labels, kids = ["Doc", *[f"Lit({rng.randrange(9)})" for _ in range(300)]], [list(range(1, 301)), *[[] for _ in range(300)]]
        depth = [0] * len(labels)
        for k, ks in enumerate(kids):
            for c in ks:
                depth[c] = depth[k] + 1
        rows.append((i, [(x.split("(")[0], x, depth[k], 0, kids[k]) for k, x in enumerate(labels)]))
    df = spark.createDataFrame(rows, "id long, nodes array<struct<kind:string,label:string,depth:int,parent:int,children:array<int>>>").repartition(3)
    got = wl.encode(df, 3).withColumn("plain", F.map_from_entries(wl.histogram(F.col("nodes"), 3))).select("id", "enc", "plain", "tree_depth").collect()
    assert len(got) == 121 and all(r["enc"] == r["plain"] for r in got if r["id"] >= 0) and [r["enc"] for r in got if r["id"] < 0] == [None]
    assert wl.encode(df.limit(0)).count() == 0


def test_search(corpus):
    t = search.Target.of(corpus.where("name = 'T1'").select("name", "nodes", "node_count"))
    rows = search.search(corpus, t, 3).collect()
    assert [r["name"] for r in rows] == ["T1", "T2", "T3"] and rows[0]["similarity_score"] == pytest.approx(1.0)
    for bad in ({"k": 0}, {"k": 101}, {"node_ratio": 3.0}):
        with pytest.raises(ValueError):
            search.search(corpus, t, **bad)


def test_bounds():
    assert search.bounds(5, 1.2) == (0, 30) and search.bounds(150, 1.2) == (125, 180) and search.bounds(600, 1.8) == (pytest.approx(333.3333, abs=1e-3), 1080)


def lam(kind, name, t, body):
    return {kind: {"binderName": name, "binderType": t, "body": body, "binderInfo": "default"}}


def b(i):
    return {"bvar": {"deBruijnIndex": i}}


def test_rewrites():
    norm = lambda e: expr.normalize(expr.parse(json.dumps(e)))
    labels = lambda e: [n["label"] for n in expr.pack(e)]
    e = norm(lam("forallE", "a", C("Nat"), lam("forallE", "b", C("Nat"), E("", add(b(1), b(0)), add(b(0), b(1))))))
    assert len(e.kind) == 17 and labels(expr.drop_binders(e)) == labels(expr.parse(json.dumps(T["T1"])))
    p = A(C("P"), C("q"))
    assert labels(expr.drop_binders(expr.parse(json.dumps(lam("forallE", "h", lam("forallE", "a", C("Nat"), b(0)), p))))) == labels(expr.parse(json.dumps(p)))
    kept = lam("forallE", "x", {"lit": {"literal": "1"}}, p)
    assert len(expr.drop_binders(expr.parse(json.dumps(kept))).kind) == 5
    gx = A(C("g"), C("x"))
    assert labels(norm(A(C("f"), gx, gx))) == ["App", "App", "Const(f, [])", "FVar(v0)", "FVar(v0)"]
    with pytest.raises(IndexError):
        norm(lam("lam", "a", C("Nat"), b(3)))
    with pytest.raises(TypeError):
        norm(T["T7"])
    for x in (A(C("instX"), C("y")), A(C("y"), C("instX"))):
        assert labels(expr.fold_noise(expr.parse(json.dumps(x)))) == ["Const(instX, [])"]
    assert len(expr.drop_binders(expr.normalize(expr.parse(_text(3000)))).kind) == 6001
    for v in T.values():
        again = expr.parse(json.dumps(v))
        assert expr.parse(expr.dump(again)) == again


def _text(n):
    f = '{"app":{"fn":{"const":{"declName":"f","us":[]}},"arg":'
    return f * n + '{"const":{"declName":"x","us":[]}}' + "}}" * n


def random_tree(rng, n):
    kids = [[] for _ in range(n)]
    parent = [-1] + [rng.randrange(i) for i in range(1, n)]
    for i in range(1, n):
        kids[parent[i]].append(i)
    order, work = [], [0]
    while work:
        i = work.pop()
        order.append(i)
        work += reversed(kids[i])
    new = {o: k for k, o in enumerate(order)}
    return [rng.choice(["App", "Lam", "Lit(1)", "Lit(2)", "Const(a, [])"]) for _ in order], [[new[k] for k in kids[o]] for o in order]


def plain_distance(t1, t2):
    from functools import cache

    sub = lambda t, i: (t[0][i], tuple(sub(t, k) for k in t[1][i]))
    a, c = sub(t1, 0), sub(t2, 0)
    cheap = lambda x: x[0].startswith(compare.CHEAP)
    cost = lambda x: 0.2 if cheap(x) else 1.0

    @cache
    def far(f, g):
        if not f and not g:
            return 0.0
        out = []
        if f:
            out.append(far(f[:-1] + f[-1][1], g) + cost(f[-1]))
        if g:
            out.append(far(f, g[:-1] + g[-1][1]) + cost(g[-1]))
        if f and g:
            x, y = f[-1], g[-1]
            out.append(far(f[:-1], g[:-1]) + far(x[1], y[1]) + (0.0 if x == y or cheap(x) or cheap(y) else 0.4))
        return min(out)

    return far((a,), (c,))


def test_packed():
    """Flat columns of many trees are what pack() gives for each; skipped trees are null, and an empty batch is none."""
    trees = [expr.parse(json.dumps(v)) for v in T.values()] + [expr.parse(_text(300))]
    rows = expr.Packed()
    assert rows.array().to_pylist() == []
    for e in trees:
        rows.add(e)
        rows.skip()
    assert rows.array().to_pylist() == [x for e in trees for x in (expr.pack(e), None)]


def test_malformed_rows(spark):
    """Rows that can't be read, half a surrogate pair among them, are set apart and leave their batch alone."""
    bad = {"none": None, "text": "{", "kind": '{"loop": 1}', "half": '{"lit": {"literal": "\\ud800"}}', "bound": '{"bvar": {"deBruijnIndex": 0}}'}
    rows = spark.createDataFrame([("good", json.dumps(T["T1"])), *bad.items()], "name string, expr_json string").coalesce(1)
    got = {r["name"]: r for r in search.parse_trees(rows, normalized=False).collect()}
    assert got["good"]["error"] is None and got["good"]["node_count"] == got["good"]["simp_node_count"] == len(got["good"]["nodes"]) > 1
    for name in bad:
        assert got[name]["error"] and got[name]["nodes"] is None and got[name]["node_count"] is None and got[name]["simp_node_count"] is None, name


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(150):
        x, y = random_tree(rng, rng.randint(1, 10)), random_tree(rng, rng.randint(1, 10))
        assert compare.edit_distance(x, y) == pytest.approx(plain_distance(x, y))
        assert compare.edit_distance(x, x) == 0 and compare.collapse_score(x, x) == 1


def test_least_distance():
    """Never above the distance, and of use: on average a good part of it."""
    rng = random.Random(9)
    share = []
    for _ in range(400):
        x, y = random_tree(rng, rng.randint(1, 25)), random_tree(rng, rng.randint(1, 25))
        low, far = compare.least_distance(x, y), compare.edit_distance(x, y)
        assert 0 <= low <= far + 1e-9 and compare.least_distance(x, x) == 0 and low == pytest.approx(compare.least_distance(y, x))
        share.append(low / far if far else 1.0)
    assert sum(share) / len(share) > 0.5


def test_best_ranked(spark, sf, corpus):
    """The same rows and scores as with all distances, of which some are spared."""
    enc, spared = registry.encoded(spark, sf), 0
    names = [r["name"] for r in enc.where("node_count <= 50").orderBy("name").limit(3).collect()]
    for table, name, k in [(enc, n, 20) for n in names] + [(enc, names[0], 1), (corpus, "T1", 3), (corpus, "T1", 100)]:
        t = search.Target.of(table.where(f"name = '{name}'").select("name", "nodes", "node_count"))
        out, computed, held = search.best_ranked(table, t, k)
        order = lambda r: (-round(r["similarity"], 12), r["name"])
        want = sorted(search.ranked(table, t).collect(), key=order)[:k]
        got = sorted(out.collect(), key=order)
        assert [(r["name"], pytest.approx(r["similarity"]), r["ted"]) for r in want] == [(r["name"], r["similarity"], pytest.approx(r["ted"])) for r in got]
        spared += held - computed
    assert spared > 0


def test_ir_metrics(spark):
    r = search.ir_metrics(spark.createDataFrame([(1,), (3,), (None,), (7,), (20,)], "rank int")).first()
    assert [round(r[k], 6) for k in ("recall_1", "recall_5", "recall_10", "precision_5", "f1_5", "f1_10", "ndcg_5", "ndcg_10", "mrr")] == [0.2, 0.4, 0.6, 0.08, 0.133333, 0.109091, 0.3, 0.366667, 0.305238]


def test_store(spark, tmp_path, corpus):
    rows = spark.createDataFrame([(k, json.dumps(v), k) for k, v in T.items()] + [("bad", '{"what":1}', "x"), ("null", "null", "x"), ("none", None, "x")], "name string, expr_json string, statement_str string")
    table, errors = store.ingest(rows, str(tmp_path))
    assert table.count() == 7 and [r["name"] for r in errors.collect()] == ["bad"]
    assert store.encode_job(table, str(tmp_path), 1).count() == 7 and store.encode_job(table, str(tmp_path), 3).count() == 7
    assert spark.read.parquet(f"{tmp_path}/wl_encodings").select("k").distinct().count() == 2
    assert store.health(spark, f"{tmp_path}/theorems", f"{tmp_path}/nothing") == {"spark": True, f"{tmp_path}/theorems": True, f"{tmp_path}/nothing": False}
    t = search.Target.of(corpus.where("name = 'T1'").select("name", "nodes", "node_count"))
    from arbolith.plans import evaluate

    report = evaluate.report(corpus, t, "T1")
    store.write_csv(report, f"{tmp_path}/csv")
    r = report.first()
    assert r["Target Rank"] == "1" and r["Is Target in Top 10"] == "Yes" and r["Top 10 Names"].startswith("T1; T2")
    store.write_missing(spark.createDataFrame([("a", None), ("b", 2)], "target string, rank int"), f"{tmp_path}/missing")
    assert spark.read.text(f"{tmp_path}/missing").count() == 1
    store.export(search.search(corpus, t, 5), f"{tmp_path}/out", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["Name", "Similarity Score", "Statement", "Node Count"]


def test_streaming(spark, tmp_path):
    from arbolith.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"name": k, "expr_json": json.dumps(v), "statement_str": k}) for k, v in T.items()) + '\n{"name":"bad","expr_json":"{}"}\n')
    q = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/trees")).count() == 7 and spark.read.parquet(str(tmp_path / "out/errors")).count() == 1



def test_near_duplicates_of_long_documents(spark, sf, tmp_path):
    text = "\n".join(" ".join(f"w{k}" for k in range(j, j + 20)) for j in range(60))
    short = "a b c\nd e"
    rows = [(1, text, "en", len(text)), (2, text, "en", len(text)), (3, short, "en", len(short)), (4, short, "en", len(short))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["name"] for r in registry.queries()["doc_near_duplicates"](spark, str(tmp_path)).collect()}
    assert {"d000000000001", "d000000000002"} & got and "d000000000003" not in got


def test_pretty_print_is_of_all_trees(spark, sf):
    assert registry.queries()["pretty_print"](spark, sf).count() == registry.trees(spark, sf).count() > 5


def theorems(spark, more=()):
    return spark.createDataFrame([(k, json.dumps(v), k.lower()) for k, v in T.items()] + list(more), "name string, expr_json string, statement_str string")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    from arbolith import api

    path = str(tmp_path_factory.mktemp("store"))
    assert api.build(spark, theorems(spark, [("bad", "{}", "x")]), path) == {"theorems": 7, "errors": 1}
    return path


def test_api(spark, kept, capsys, tmp_path):
    from arbolith import api
    from arbolith.__main__ import main

    e = lam("forallE", "a", C("Nat"), lam("forallE", "b", C("Nat"), E("", add(b(1), b(0)), add(b(0), b(1)))))
    rows = api.find_similar(spark, kept, json.dumps(e), 3)
    assert [r["name"] for r in rows][:2] == ["T1", "T2"] and rows[0]["similarity_score"] == 1.0 and rows[1]["similarity_score"] == 0.9262 and set(rows[0]) == {"name", "similarity_score", "statement", "node_count"}
    for bad in (("", 3), ("  ", 3), ("{}", 3), (json.dumps(e), 0), (json.dumps(e), None)):
        with pytest.raises(ValueError):
            api.find_similar(spark, kept, *bad)
    with pytest.raises(ValueError):
        search.check_request(1, None, "x" * 1001)
    (tmp_path / "q.json").write_text(json.dumps({"input_str": "x", "your_expr": e}))
    assert json.loads(search.load_json(str(tmp_path / "q.json"))) == e
    assert main(["search", "--store", kept, "--expr-json", str(tmp_path / "q.json"), "-k", "2"], spark) == 0
    assert capsys.readouterr().out.split("\n")[0].endswith("1.0000 T1: t1")
    assert main(["search", "--store", kept, "--expr-json", str(tmp_path / "q.json"), "-k", "0"], spark) == 2
    assert main(["evaluate", "--store", kept, "--names", "T1", "T3", "--report", str(tmp_path / "r")], spark) == 0
    assert json.loads(capsys.readouterr().out)["recall_1"] == 1.0


def test_batch_is_single(spark, corpus):
    """Many targets in one job get what each gets alone."""
    from arbolith.plans import evaluate

    names = ["T1", "T3", "T5", "T6"]
    rows = corpus.where("name <> 'T4'")  # its tree is that of T1
    many = {(r["query"], r["name"]): r for r in search.batch_ranked(rows, rows.where(rows.name.isin(*names))).collect()}
    reports = {r["Target Name"]: r for r in evaluate.report_many(rows, rows.where(rows.name.isin(*names))).collect()}
    assert len(reports) == 4
    for n in names:
        t = search.Target.of(rows.where(f"name = '{n}'").select("name", "nodes", "node_count"))
        alone = search.ranked(rows, t).collect()
        assert len(alone) == sum(q == n for q, _ in many)
        for r in alone:
            got = many[n, r["name"]]
            assert all(got[c] == pytest.approx(r[c]) for c in ("wl", "ted", "collapse", "jaccard", "similarity"))
        assert reports[n].asDict() == evaluate.report(rows, t, n).first().asDict()
    assert search.batch_cosine(rows, rows.limit(0)).count() == 0
    few = search.batch_cosine(rows, rows, block=2, top=1, rows=3).collect()
    assert {(r["query"], r["name"]) for r in few if r["query"] in ("T1", "T3")} >= {("T1", "T1"), ("T1", "T2"), ("T3", "T3")}


def test_pruned_search(spark, corpus):
    from pyspark.sql import functions as F

    t = search.Target.of(corpus.where("name = 'T1'").select("name", "nodes", "node_count"))
    rows = corpus.withColumn("cluster_id", F.when(F.col("name").isin("T1", "T5"), 1).when(F.col("name") == "T2", 2))
    one = spark.createDataFrame([(1,)], "cluster_id int")
    assert {r["name"] for r in cluster.pruned_search(rows, t, one, top=2).collect()} == {"T1", "T5"}
    more = {r["name"] for r in cluster.pruned_search(rows, t, one, top=10).collect()}
    assert more == {"T1", "T5", "T2", "T3", "T4", "T7"}  # T6 is outside the clusters, and its score is 0
    assert {r["name"] for r in cluster.samples(rows, one).collect()} == {"T1"}
    assert cluster.sampled(rows, 3).collect() == cluster.sampled(rows.repartition(5), 3).collect()


def test_clustering_job(spark, kept, tmp_path):
    from arbolith import api

    got = {r["name"]: r["cluster_id"] for r in api.cluster_job(spark, kept, features=20, dims=3, k=3).collect()}
    assert set(got) == set(T) and got["T6"] is None and got["T1"] is not None and got["T1"] == got["T4"] == got["T2"]
    e = json.dumps(lam("forallE", "a", C("Nat"), lam("forallE", "b", C("Nat"), E("", add(b(1), b(0)), add(b(0), b(1))))))
    assert api.find_pruned(spark, kept, e, clusters=1, top=1).first()["name"] in ("T1", "T2", "T4")
    plan = spark.read.parquet(f"{kept}/clustering/lists").where("cluster_id IN (0, 1)")._jdf.queryExecution().toString()
    assert "cluster_id" in plan[plan.index("PartitionFilters") :].split("]")[0]
    with pytest.raises(ValueError):
        api.find_similar(spark, kept, "x" * 1001)
    assert store.write_clusters(spark.createDataFrame([("a", 1)], "name string, cluster_id int"), str(tmp_path / "c")).count() == 1


def test_partitioned_search(spark, sf, tmp_path):
    """Files of the chosen clusters only are read, scores are those of a full search, and few of its best rows are missed."""
    from pyspark.sql import functions as F

    enc, t = registry.encoded(spark, sf), registry.target_of(spark, sf)
    model, low = cluster.fit(enc.select("name", "enc"), 300, 12, 20)
    ids = cluster.reduce.assigned(low, model.centers).select("name", "cluster_id")
    table = cluster.write_partitioned(store.with_clusters(enc, ids), str(tmp_path / "lists"))
    chosen = cluster.choose(model, t, 5)
    assert len(chosen) == 5 and set(chosen) < set(range(20))
    rows = cluster.partitioned_search(table, t, chosen, top=20, sample=0)
    plan = rows._jdf.queryExecution().toString()
    assert "cluster_id" in plan[plan.rindex("PartitionFilters") :].split("]")[0]
    full = {r["name"]: r["wl"] for r in search.stage1(enc, t, 10_000).collect()}
    got = {r["name"]: r["wl"] for r in rows.collect()}
    assert all(full[n] == w for n, w in got.items())
    best = sorted(full.values(), reverse=True)[:20]
    assert sum(w >= best[-1] for w in got.values()) >= 14
    more = cluster.partitioned_search(table, t, chosen[:1], top=10_000, sample=10_000)
    assert {r["name"] for r in more.collect()} >= {n for n, w in full.items() if w > 0}
    cluster.save(model, str(tmp_path / "model"))
    assert cluster.choose(cluster.load(spark, str(tmp_path / "model")), t, 5) == chosen
    read = {f for r in table.where(table.cluster_id.isin(chosen)).select(F.input_file_name().alias("f")).distinct().collect() for f in [r["f"]]}
    assert 0 < len(read) < len(table.inputFiles())
    for f in (tmp_path / "lists").glob("cluster_id=*/*.parquet"):  # a search doesn't even open the other clusters' files
        if f.parent.name not in {f"cluster_id={c}" for c in chosen}:
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            f.write_bytes(b"none")
    assert {r["name"]: r["wl"] for r in cluster.partitioned_search(table, t, chosen, top=20, sample=0).collect()} == got


def test_nearest_center_in_blocks(spark):
    rng = random.Random(2)
    points = [(i, [rng.random() for _ in range(4)]) for i in range(50)]
    middles = [(i, [rng.random() for _ in range(4)]) for i in range(11)] + [(20, [0.0] * 4)]
    rows, centers = spark.createDataFrame(points, "best long, v array<double>"), spark.createDataFrame(middles, "cluster_id long, center array<double>")
    far = lambda a, c: sum((x - y) ** 2 for x, y in zip(a, c, strict=True))
    for block in (4096, 3):
        got = {r["best"]: r["nearest"] for r in cluster.nearest_center(rows, centers, "v", block).collect()}
        assert got == {i: min(middles, key=lambda m: (round(far(p, m[1]), 9), m[0]))[0] for i, p in points}
    near = cluster.nearest(centers, points[0][1], 3).collect()
    assert [r["cluster_id"] for r in near] == [i for i, _ in sorted(middles, key=lambda m: far(points[0][1], m[1]))[:3]]


def test_store_pieces(spark, kept, tmp_path, corpus):
    both = store.joined(spark.read.parquet(f"{kept}/theorems"), spark.read.parquet(f"{kept}/wl_encodings").where("k = 3"))
    assert both.count() == 7 and {"expr_json", "enc", "norm2"} <= set(both.columns)
    enc = spark.createDataFrame([("a", {"x": 1}, 3), ("b", {}, 4), ("c", None, 5)], "name string, enc map<string,int>, cluster_id int")
    assert {r["name"]: (r["enc"], r["cluster_id"]) for r in store.clean(enc).collect()} == {"a": ({"x": 1}, 3), "b": ({}, None), "c": ({}, None)}
    assert store.ensure_column(enc, "cluster_id", "int") is enc and dict(store.ensure_column(enc, "extra", "double").dtypes)["extra"] == "double"
    spark.sql("DROP TABLE IF EXISTS arbolith_encodings")
    for _ in range(2):
        store.create_table(spark, "arbolith_encodings")
    assert spark.table("arbolith_encodings").columns == ["theorem_name", "enc", "tree_depth"]
    spark.sql("DROP TABLE arbolith_encodings")
    log = spark.createDataFrame([(2, json.dumps({"commandSyntaxKind": "k", "appFnName": "f\ng ", "exactStxReprint": "s", "mainGoalTypeStr": "g", "mainGoalTypeJson": {"const": 1}})), (1, '{"commandSyntaxKind":"other"}'), (3, None), (4, "no json"), (0, '{"commandSyntaxKind":"k"}')], "id long, data string")
    assert [tuple(r) for r in store.json_log(log, "k").collect()] == [(0, None, None, None, None), (2, "f g", "s", "g", '{"const":1}')]
    t = search.Target.of(corpus.where("name = 'T1'").select("name", "nodes", "node_count"))
    store.export(search.search(corpus, t, 2), f"{tmp_path}/json")
    assert set(json.loads(spark.read.text(f"{tmp_path}/json").first()[0])) == {"name", "similarity_score", "statement", "node_count"}
    with pytest.raises(Exception):  # noqa: B017  no such driver
        store.jdbc(spark, "jdbc:none://x", "t", driver="none").count()


def test_limited_distance():
    one, two, five = (["a"], [[]]), (["a", "b"], [[1], []]), (["a"] * 5, [[1, 2, 3, 4], [], [], [], []])
    # Nodes are alike where their subtrees are, so a root whose children differ costs a change too.
    assert compare.limited_distance(one, two) == float("inf") and compare.limited_distance(one, one) == 0 and compare.limited_distance(five, (["a"] * 4, [[1, 2, 3], [], [], []])) == 2
    assert compare.edit_distance(five, one, unit=True) == 4


def plain_unit(t1, t2):
    old, compare.CHEAP = compare.CHEAP, ()
    try:
        from functools import cache

        sub = lambda t, i: (t[0][i], tuple(sub(t, k) for k in t[1][i]))

        @cache
        def far(f, g):
            if not f or not g:
                return sum(1 + far(x[1], ()) if g == () else 1 + far((), x[1]) for x in f or g) if f or g else 0
            x, y = f[-1], g[-1]
            return min(far(f[:-1] + x[1], g) + 1, far(f, g[:-1] + y[1]) + 1, far(f[:-1], g[:-1]) + far(x[1], y[1]) + (x != y))

        return far((sub(t1, 0),), (sub(t2, 0),))
    finally:
        compare.CHEAP = old


@pytest.fixture(scope="module")
def small_orders(spark, sf, tmp_path_factory):
    """Orders of one or two lines, whose distances a plain recursion can find."""
    path = str(tmp_path_factory.mktemp("orders"))
    part, line, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("part", "lineitem", "orders"))
    some = orders.orderBy("o_orderkey").limit(30)
    line.where("l_linenumber <= 1 + l_orderkey % 2").join(some.selectExpr("o_orderkey as l_orderkey"), "l_orderkey", "left_semi").write.parquet(f"{path}/lineitem.parquet")
    some.write.parquet(f"{path}/orders.parquet")
    part.write.parquet(f"{path}/part.parquet")
    return path


def test_distance_queries(spark, small_orders):
    """tree_edit_distance, legacy_edit_distance, composite_full and search_e2e against plain recursions over the same trees."""
    rows = {r["name"]: r for r in registry.encoded(spark, small_orders).collect()}
    tree = lambda r: ([n["label"] for n in r["nodes"]], [list(n["children"]) for n in r["nodes"]])
    first = rows[min(rows)]
    t = tree(first)
    ask = lambda q, c: {r["name"]: r[c] for r in registry.queries()[q](spark, small_orders).collect()}
    ted = ask("tree_edit_distance", "ted")
    assert set(ted) == set(rows) and all(v == pytest.approx(plain_distance(t, tree(rows[n]))) for n, v in ted.items())
    for n, v in ask("legacy_edit_distance", "distance").items():
        a, c = len(t[0]), len(rows[n]["nodes"])
        assert v == (float("inf") if max(a, c) / min(a, c) > 1.5 else plain_unit(t, tree(rows[n])))

    def full(r):
        dot = sum(v * r["enc"].get(k, 0) for k, v in first["enc"].items())
        cos = dot / ((first["norm2"] ** 0.5) * (r["norm2"] ** 0.5))
        names = lambda x: {m[1] for l in tree(x)[0] if (m := __import__("re").match(r"Const\((\w+)", l)) and "inst" not in m[1]}  # noqa: E731, E741
        both, either = names(first) & names(r), names(first) | names(r)
        return 0.15 * cos + 0.4 * (1 - ted[r["name"]] / max(len(t[0]), len(r["nodes"]))) + 0.3 * compare.collapse_score(t, tree(r)) + 0.15 * len(both) / len(either)

    want = {n: full(r) for n, r in rows.items()}
    got = ask("composite_full", "similarity")
    assert set(got) == set(want) and all(v == pytest.approx(want[n]) for n, v in got.items())
    best = [r["name"] for r in registry.queries()["search_e2e"](spark, small_orders).collect()]
    assert best == [n for n, _ in sorted(want.items(), key=lambda x: (-round(x[1], 12), x[0]))][:20]
