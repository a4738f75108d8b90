"""Order trees out of sorted lines, and what is done with encodings without moving a row."""

import math
import random
from collections import Counter
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arbolith.functions import sql as functions
from arbolith.functions import wl, wl_batch
from arbolith.llm import attention
from arbolith.operators import cluster, expr, reduce, relational, search, topk
from arbolith.plans import registry
from arbolith.sources import fixtures


def test_encoded_in_one_pass(spark, sf, monkeypatch):
    """Trees with encodings are what wl.encode() makes of trees, in few lines at once too, without a grouped list of lines."""
    monkeypatch.setattr(fixtures, "LINES", 7)
    rows = fixtures.order_trees(spark, sf, 3)
    plan = rows._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    flat = lambda df: {(r["name"], r["tree_depth"], r["norm2"], tuple(sorted(r["enc"].items()))) for r in df.collect()}
    assert flat(rows) == flat(wl.encode(fixtures.order_trees(spark, sf)))


def test_orders_of_one_key(spark, sf, tmp_path):
    """Two orders that share a key are two trees, each with all lines."""
    for t in ("orders", "lineitem", "part"):
        df = fixtures.read(spark, sf, t)
        (df.unionByName(df.where("o_orderkey % 2 = 0")) if t == "orders" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    size = {r["name"]: r["node_count"] for r in fixtures.order_trees(spark, sf).collect()}
    got = [(r["name"], r["node_count"]) for r in fixtures.order_trees(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(x for k, v in size.items() for x in [(k, v)] * (2 - int(k[1:]) % 2))


def test_sql_dot_by_hash(spark):
    """A map is not searched from its front for each key of the other."""
    functions.register(spark)
    df = spark.sql("SELECT wl_dot(map('a', 2, 'b', 3), map('b', 5, 'c', 1)) AS d, wl_dot(map('a', 2), CAST(NULL AS MAP<STRING, INT>)) AS z, wl_cosine(map('a', 1), map('b', 1)) AS w FROM range(1)")
    assert tuple(df.first()) == (15, 0, 0.0)
    plan = spark.sql("SELECT wl_dot(e, e) FROM (SELECT map(CAST(id AS STRING), 1) AS e FROM range(3))")._jdf.queryExecution().toString()
    assert "try_element_at" not in plan and "map_zip_with" in plan


def test_fixed_dot_by_count(spark):
    df = spark.createDataFrame([({"a": 2, "b": 3, "z": 9},), ({},), (None,)], "enc map<string,int>")
    plan = df.select(wl.dot("enc", {"a": 4, "b": 1, "c": 1}))
    assert [r[0] for r in plan.collect()] == [11, 0, None] and "try_element_at" not in plan._jdf.queryExecution().toString()


def test_led_without_shuffle(spark):
    """The nearest leader, of equals the least name; null for trees that share nothing with any."""
    leaders = spark.createDataFrame([("b", 0, 1, {"x": 1}), ("a", 1, 1, {"x": 1}), ("c", 2, 5, {"y": 1, "q": 2})], "name string, cluster_id int, norm2 long, enc map<string,int>")
    rows = spark.createDataFrame([("1", 1, {"x": 1}), ("2", 2, {"y": 1, "q": 1}), ("3", 4, {"w": 2}), ("4", None, None), ("5", 0, {})], "name string, norm2 long, enc map<string,int>")
    got = cluster.led(rows, leaders)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["name"]: r["cluster_id"] for r in got.collect()} == {"1": 1, "2": 2, "3": None, "4": None, "5": None}


def test_sparse_rows_without_shuffle(spark, sf):
    enc = fixtures.order_trees(spark, sf, 3).select("name", "enc")
    chosen = cluster.feature_map(cluster.document_frequency(enc), 40).cache()
    got = cluster.sparse_rows(enc, chosen)
    want = {r["name"]: (r["idx"], r["value"]) for r in reduce.sparse(cluster.vector_entries(enc, chosen)).collect()}
    mine = {r["name"]: (r["idx"], r["value"]) for r in got.collect()}
    assert mine.keys() == want.keys() and all(mine[k][0] == want[k][0] and all(math.isclose(a, b) for a, b in zip(mine[k][1], want[k][1], strict=True)) for k in want)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_pages_are_folders(spark):
    """A step of the page loop opens its own page's files, and the centres are those of unpaged rows."""
    df = spark.createDataFrame([(str(i), [float(i % 7), float(i % 5)]) for i in range(300)], "name string, reduced array<double>")
    held = reduce.paged(df, 4, 42)
    assert "PartitionFilters: [isnotnull(page" in held.where(F.col("page") == 1)._jdf.queryExecution().executedPlan().toString()
    assert abs(reduce.mini_batch_means(held, 5, pages=4) - reduce.mini_batch_means(df, 5, pages=4)).max() < 1e-9


def test_sql_cosine_without_a_table(spark, sf, monkeypatch):
    """The trees are scored in the pass that encodes them, with the lengths that it finds."""
    monkeypatch.setattr(registry, "encodings", None)
    found = registry.sql_wl_cosine(spark, sf)
    assert "wl_norm2" not in (plan := found._jdf.queryExecution().toString()) and plan.count("map_zip_with") and "encodings-" not in plan
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in registry.wl_cosine(spark, sf).collect()}
    row = spark.sql("SELECT wl_ratio(3L, 9L, 4L) AS w, wl_ratio(0L, 0L, 4L) AS z, wl_ratio(9L, 4L, 4L) AS o").first()
    assert tuple(row) == (0.5, 0.0, 1.0)


def test_nodes_in_one_shuffle(spark, sf, monkeypatch):
    """Trees that fit in a task are dealt out once; larger ones still give the same."""
    rows = relational.nodes_of(fixtures.order_trees(spark, sf))
    want = {(r["name"], r["key"], r["value"]) for r in fixtures.order_trees(spark, sf, 3).select("name", F.explode("enc")).collect()}
    monkeypatch.setattr(relational, "BATCH", 500)
    whole = relational.encode_nodes(rows)
    assert whole._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 2  # of order lines, and of nodes
    assert {tuple(r) for r in whole.collect()} == want
    monkeypatch.setattr(relational, "WHOLE", 30)
    assert {tuple(r) for r in relational.encode_nodes(rows).collect()} == want


def test_query_blocks_grow():
    """Rows are sent once for each block of queries; at six times sf0.1 three blocks of queries meet, not twenty-two."""
    assert topk.block_size(1, 100) == topk.QUERIES and topk.block_size(45, 44_000) == topk.MOST


def test_label_counts(spark, sf):
    """Raw labels and rounds are counted as the Column functions count them, whatever the depth."""
    df = fixtures.order_trees(spark, sf).limit(40)
    first = wl.initial_labels(F.col("nodes"))
    both = df.withColumn("a", first).withColumn("b", wl.next_labels(F.col("nodes"), F.col("a"))).withColumn("h", wl.label_counts(F.col("nodes"), 1)).collect()
    assert both and all(dict(r["h"]) == Counter([f"0_{x}" for x in r["a"]] + [f"1_{x}" for x in r["b"]]) for r in both)


def test_every_window_is_learned_from():
    """No window of a training text is left out unless a caller says so."""
    assert attention.EVERY == 1 and signature(attention.score_documents).parameters["every"].default == signature(attention.fit).parameters["every"].default == 1


def test_dots_in_numbers(spark, sf):
    """Dot products and lengths without texts are those of histograms, whatever the order and number of children."""
    rng = random.Random(5)

    def tree():
        nodes = [{"kind": "App", "label": "App", "depth": 0, "parent": -1, "children": []}]
        for i in range(1, rng.randrange(2, 30)):
            p = rng.randrange(max(0, i - 4), i)
            nodes[p]["children"].append(i)
            nodes.append({"kind": "Lit", "label": f"Lit({rng.randrange(2)})", "depth": nodes[p]["depth"] + 1, "parent": p, "children": []})
        return nodes

    trees = [*([n.asDict() for n in r["nodes"]] for r in fixtures.order_trees(spark, sf).limit(30).collect()), *(tree() for _ in range(60)), []]
    packed = pa.array(trees, wl_batch.NODES)
    encs = [dict(e) for e in wl_batch.histograms(packed, 3).to_pylist()]
    for t in (0, 40, 70):
        dot, norm2 = wl_batch.dots(packed, packed.slice(t, 1), 3)
        assert norm2.tolist() == [sum(v * v for v in e.values()) for e in encs]
        assert dot.tolist() == [sum(v * encs[t].get(k, 0) for k, v in e.items()) for e in encs]


def test_cut_before_trees(spark, sf, tmp_path, monkeypatch):
    """A search of one tree keeps no table of all trees; orders of one key that differ are each judged, and the cut is that of stage 1."""
    for t in ("orders", "lineitem", "part"):
        df = fixtures.read(spark, sf, t)
        (df.unionByName(df.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("P"))) if t == "orders" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    path = str(tmp_path)
    enc, t = fixtures.order_trees(spark, path, 3).cache(), registry.target_of(spark, path)
    monkeypatch.setattr(registry, "encoded", None)
    monkeypatch.setattr(registry, "encodings", None)
    for top in (7, 150):
        want = search.stage1(enc, t, top).collect()
        got = search.stage1(registry.nearby(spark, path, t, top), t, top)
        assert [(r["name"], r["wl"]) for r in got.collect()] == [(r["name"], r["wl"]) for r in want]
    for q in ("competition_rank", "tree_edit_distance", "composite_full", "topk_display_strings"):
        assert registry.queries()[q](spark, path).count() > 0


def test_lines_are_dealt_once(spark, sf):
    """Lines move by order once, before the join with orders, which then moves only orders."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = fixtures.order_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert plan.count("hashpartitioning(l_orderkey") == 1 and plan.count("hashpartitioning(o_orderkey") == 1


def test_least_tree_beyond_the_first_names(spark, sf, tmp_path):
    """Where none of the first names has lines, the least of all others is found."""
    for t in ("orders", "lineitem", "part"):
        df = fixtures.read(spark, sf, t)
        (df.where("l_orderkey > 40") if t == "lineitem" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    want = min(r["name"] for r in fixtures.order_trees(spark, str(tmp_path)).collect())
    assert [fixtures.least_tree(spark, str(tmp_path), many=n).first()["name"] for n in (3, 1000)] == [want] * 2


def test_table_function_sets_texts_apart(spark):
    """Half of a surrogate pair in one text costs that text alone, and what needs no rewrite isn't made anew."""
    functions.register(spark)
    text = lambda x: '{"app":{"fn":{"const":{"declName":"%s","us":[]}},"arg":{"sort":{"u":"P"}}}}' % x  # noqa: E731, UP031
    rows = spark.createDataFrame([("a", text("f")), ("b", text("\\ud800")), ("c", text("g"))], "name string, json string")
    got = spark.sql("SELECT name, label FROM tree_nodes(TABLE(SELECT name, json FROM {rows})) WHERE id = 1", rows=rows)
    assert sorted(map(tuple, got.collect())) == [("a", "Const(f, [])"), ("c", "Const(g, [])")]
    e = expr.parse(text("f"))
    assert expr.drop_binders(expr.normalize(e)) is e


def test_entries_without_encodings(spark, sf, monkeypatch):
    """Frequencies and weighed entries of batches of trees are those of encodings, which no table or explode holds."""
    monkeypatch.setattr(fixtures, "LINES", 50)
    enc = fixtures.order_trees(spark, sf, 3).select("name", "enc")
    df = registry.frequencies(spark, sf)
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in cluster.document_frequency(enc).collect()}
    chosen = cluster.feature_map(df, 40).cache()
    flat = lambda x: {(r["name"], r["idx"]): round(r["value"], 9) for r in x.collect()}
    assert flat(fixtures.order_entries(spark, sf, chosen)) == flat(cluster.vector_entries(enc, chosen))
    monkeypatch.setattr(registry, "encoded", None)
    monkeypatch.setattr(registry, "encodings", None)
    plan = registry.queries()["tfidf_vector_long"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" in plan


def test_batches_in_slices(spark, sf, monkeypatch):
    """A batch of long trees is taken in parts of bounded nodes, with the same histograms and dot products."""
    trees = fixtures.order_trees(spark, sf).limit(40).cache()
    t = trees.orderBy("name").first()["nodes"]
    packed = pa.array([[n.asDict() for n in r["nodes"]] for r in trees.collect()] + [None, []], wl_batch.NODES)
    parts = list(wl_batch.slices(packed, 60))
    assert sum(map(len, parts)) == 42 and len(parts) > 5 and all(len(p) == 1 or len(p.flatten()) <= 60 for p in parts)
    flat = lambda df: {(r["name"], r["norm2"], r["dot"]) for r in df.collect()}
    whole = flat(wl.encode(trees).withColumn("dot", wl.dot("enc", dict(wl.encode(trees).orderBy("name").first()["enc"]))))
    monkeypatch.setattr(wl_batch, "AT_ONCE", 60)
    assert flat(wl.with_dots(trees, t)) == whole


def test_report_of_one_target_makes_no_table(spark, sf, monkeypatch):
    """The report's corpus is what stage 1 keeps: trees of all orders are neither written nor shuffled."""
    monkeypatch.setattr(registry, "encoded", None)
    monkeypatch.setattr(registry, "encodings", None)
    assert registry.queries()["evaluation_report"](spark, sf).count() == 1


def test_scores_without_names(spark, sf):
    """A search of one tree counts labels in numbers, of lines that carry no names of constants, and finds what full trees would give."""
    lines = fixtures.order_lines(spark, sf, names=False)
    assert lines.columns == ["own", "key", "status", "size"]
    o = fixtures.Orders.of(lines.where("key < 400").toArrow())
    whole = fixtures.Orders.of(fixtures.order_lines(spark, sf).where("key < 400").toArrow())
    trees = fixtures.packed(whole)
    place = {k: i for i, k in enumerate(whole.key.to_pylist())}
    own = [place[k] for k in o.key.to_pylist()]
    for t in (0, 5):
        got = wl_batch.flat_dots(fixtures.flat(o), wl_batch.Flat.of(trees.slice(t, 1)), 3)
        want = wl_batch.dots(trees, trees.slice(t, 1), 3)
        assert all(g.tolist() == w[own].tolist() for g, w in zip(got, want, strict=True))


def test_renumbered():
    """Keys of a narrow and of a wide range get numbers that tell apart what differs, and nothing else."""
    rng = random.Random(3)
    for bound in (1, 50, 1 << 40):
        key = np.array([rng.randrange(bound) for _ in range(300)] * 2)
        found, number = wl_batch.renumbered(key, bound)
        assert found[number].tolist() == key.tolist() and len(set(found.tolist())) == len(found) == len(set(key.tolist()))
    assert [x.tolist() for x in wl_batch.renumbered(np.zeros(0, np.int64), 7)] == [[], []]
