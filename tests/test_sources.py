"""Keyed table, dump reader and SQL functions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from arbolith.functions import sql
from arbolith.operators import compare
from arbolith.sources import dump
from arbolith.sources.keyed import Conflict, KeyedTable, latest

from test_trees import T


def rows_of(table):
    return sorted(((r["k"], r["v"], r["x"]) for r in table.read().collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path / "data") for f in fs if f.endswith(".parquet")}


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = spark.createDataFrame([], "k string, v int, x string").schema
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = KeyedTable.create(spark, path, schema, "k", "v", buckets=16)
    assert rows_of(table) == [] and table.read().columns == ["k", "v", "x"]
    table = table.upsert(frame([(f"k{i}", 1, "a") for i in range(100)] + [(None, 1, "n"), ("k0", 0, "old"), ("k1", 2, "b")]))
    held = {f"k{i}": (1, "a") for i in range(100)} | {None: (1, "n"), "k1": (2, "b")}
    assert rows_of(table) == sorted(((k, *x) for k, x in held.items()), key=repr)
    before = files(tmp_path / "t")
    # Only the touched bucket's files are new; others keep theirs.
    table = table.upsert(frame([("k7", 1, "tie"), ("k7", 0, "late"), ("k7", 1, "tie")]), write="w1")
    held["k7"] = (1, "tie")
    assert rows_of(table) == sorted(((k, *x) for k, x in held.items()), key=repr)
    after = files(tmp_path / "t")
    assert all(after[f] == t for f, t in before.items()) and len({f.split("/")[-2] for f in set(after) - set(before)}) == 1
    # A replay changes nothing, by its id or by its rows.
    assert table.upsert(frame([("k7", 9, "again")]), write="w1") is table
    assert rows_of(table.upsert(frame([("k7", 1, "tie")]))) == rows_of(table)
    # A reopened table is the same; a write that dies before it publishes leaves it so; of two writers one fails.
    table = KeyedTable.open(spark, path)
    frame([("k8", 5, "lost")]).write.parquet(f"{path}/data/dead/__bucket=3")
    assert rows_of(KeyedTable.open(spark, path)) == rows_of(table)
    mine, other = KeyedTable.open(spark, path), KeyedTable.open(spark, path)
    mine.upsert(frame([("k9", 3, "mine")]))
    with pytest.raises(Conflict):
        other.upsert(frame([("k9", 4, "other")]))
    table = KeyedTable.open(spark, path)
    assert [tuple(r) for r in table.find(["k9", "no"]).collect()] == [("k9", 3, "mine")] and table.find([]).count() == 0
    want = rows_of(table)
    assert table.clean() > 0 and rows_of(KeyedTable.open(spark, path)) == want
    assert rows_of(table.upsert(frame([]))) == want
    assert KeyedTable.create(spark, path, schema, "k", "v").manifest["buckets"] == 16
    with pytest.raises(ValueError):
        KeyedTable.create(spark, path, schema, "x", "v")
    with pytest.raises(FileNotFoundError):
        KeyedTable.open(spark, str(tmp_path / "none"))


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "y", 1), ("b", None, "z", 0), ("b", 0, "w", 0), ("a", 1, "x", 0)], "k string, v int, x string, n int")
    assert sorted(map(tuple, latest(df, "k", "v", "n").collect())) == [("a", 1, "y"), ("b", 0, "w")]
    assert latest(df.where("k = 'b'"), "k", "v", "n").count() == 1 and latest(df.limit(0), "k", "v", "n").count() == 0


def escaped(x):
    if x is None:
        return "\\N"
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v")):
        x = x.replace(a, b)
    return x


@pytest.mark.parametrize("split", [37, 400, 1 << 20])
def test_dump(spark, tmp_path, split):
    rng = random.Random(split)
    odd = [None, "", "a\tb", "line\nend", "back\\slash", "\\N", "\\.", "é 日本 😀", "\r", "\b\f\v", "COPY public.t (a) FROM stdin;", "x" * 900, "'quoted'"]
    rows = [(str(i), rng.choice(odd), rng.choice(odd)) for i in range(150)]
    copy = lambda name, cols, rs: f"COPY {name} ({cols}) FROM stdin;\n" + "".join("\t".join(map(escaped, r)) + "\n" for r in rs) + "\\.\n"
    text = "-- dump\nSET x = 1;\nCREATE TABLE public.t (\n  a int\n);\n" + copy("public.other", "a", [("1",), ("COPY public.t (id) FROM stdin;",)]) + "\n" + copy("public.t", 'id, "expr", note', rows[:100]) + "\nSELECT 1;\n" + copy("public.t", 'id, "expr", note', rows[100:]) + copy("public.none", "a, b", []) + "-- end"
    path = str(tmp_path / "d.sql")
    with open(path, "w", newline="") as f:
        f.write(text)
    df = dump.read_dump(spark, path, "t", split)
    assert df.columns == ["id", "expr", "note"]
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0])) == rows
    assert split > 1000 or df.rdd.getNumPartitions() > 2
    assert [tuple(r) for r in dump.read_dump(spark, path, "public.other", split).collect()] == [("1",), ("COPY public.t (id) FROM stdin;",)]
    assert dump.read_dump(spark, path, "none", split).count() == 0
    with pytest.raises(ValueError):
        dump.read_dump(spark, path, "nothing", split)


def test_dump_fields(spark, tmp_path):
    assert [dump.field(x) for x in (b"\\101\\x42\\x4\\7", b"\\q\\\\", b"\\N", b"", b"\\\\N")] == ["AB\x04\x07", "q\\", None, "", "\\N"]
    (tmp_path / "bad.sql").write_text("COPY t (a, b) FROM stdin;\n1\n\\.\n")
    with pytest.raises(Exception, match="1 fields instead of 2"):
        dump.read_dump(spark, str(tmp_path / "bad.sql"), "t").collect()
    (tmp_path / "open.sql").write_text("COPY t (a, b) FROM stdin;\n1\t2\n")
    with pytest.raises(ValueError):
        dump.read_dump(spark, str(tmp_path / "open.sql"), "t")


def test_sql_functions(spark):
    names = sql.register(spark)
    assert set(names) >= {"tree_parse", "tree_normalize", "tree_edit_distance", "tree_collapse", "wl_encode", "wl_cosine", "tree_nodes"}
    spark.createDataFrame([(k, json.dumps(v)) for k, v in T.items() if k != "T7"] + [("bad", "{}"), ("null", None)], "name string, e string").createOrReplaceTempView("sql_trees")
    got = {r["name"]: r for r in spark.sql("""
        WITH t AS (SELECT name, tree_parse(e) AS nodes, tree_normalize(e) AS e FROM sql_trees), h AS (SELECT *, wl_encode(nodes) AS enc FROM t), q AS (SELECT * FROM h WHERE name = 'T1')
        SELECT h.name, size(h.nodes) AS n, h.e, tree_edit_distance(q.nodes, h.nodes) AS ted, tree_unit_distance(q.nodes, h.nodes) AS unit, tree_collapse(q.nodes, h.nodes) AS collapse, wl_cosine(q.enc, h.enc) AS wl FROM h JOIN q ON TRUE""").collect()}
    assert [got["bad"][c] for c in ("n", "e", "ted", "collapse", "wl")] == [None] * 5 == [got["null"][c] for c in ("n", "e", "ted", "collapse", "wl")]
    one = lambda n: ([x["label"] for x in nodes[n]], [list(x["children"]) for x in nodes[n]])
    nodes = {r["name"]: r["nodes"] for r in spark.sql("SELECT name, tree_parse(e) AS nodes FROM sql_trees").collect()}
    for n in T:
        if n != "T7":
            assert got[n]["ted"] == pytest.approx(compare.edit_distance(one("T1"), one(n))) and got[n]["collapse"] == pytest.approx(compare.collapse_score(one("T1"), one(n)))
    assert got["T1"]["wl"] == pytest.approx(1.0) and got["T1"]["unit"] == 0 and 0 < got["T3"]["wl"] < 1 and got["T6"]["wl"] == 0
    rows = spark.sql("SELECT name, id, label, parent FROM tree_nodes(TABLE(SELECT name, e FROM sql_trees))").collect()
    assert {(r["name"], r["id"], r["label"], r["parent"]) for r in rows} == {(k, i, x["label"], x["parent"]) for k, v in nodes.items() if v for i, x in enumerate(v)}
    assert "ArrowEval" not in spark.sql("SELECT wl_cosine(map('a', 1), map('a', 2))")._jdf.queryExecution().toString()
    assert spark.range(1).select(F.expr("wl_dot(map('a', 2, 'b', 1), map('a', 3)) AS d")).first()["d"] == 6
