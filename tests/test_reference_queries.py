"""Registered queries against their DuckDB oracles over the smallest tables, and unit cases of single functions."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.functions.text import byte_offsets, is_identifier, is_path, quoted
from brindle.operators import audit, graph, logs, structure
from brindle.plans import registry
from brindle.streaming import dashboard

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TINY}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, TINY)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(registry.oracle_sql()[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(("text", "needle"), [("aaaa", "aa"), ("éaéaé", "éaé"), ("x.y.z", "."), ("", "a"), ("abc", "abc"), ("\\E\\Q", "\\E")])
def test_byte_offsets(spark, text, needle):
    raw, n = text.encode(), needle.encode()
    assert one(spark, text, byte_offsets(F.col("x"), needle)) == [i for i in range(len(raw) - len(n) + 1) if raw[i : i + len(n)] == n]


def test_quotes(spark):
    assert one(spark, "a 'b c' \"d\" `e` it's open \"f\"", quoted(F.col("x"))) == ["b c", "d", "e"]


@pytest.mark.parametrize(("token", "path", "identifier"), [("src/a.py", True, False), ("/etc/x", False, False), ("a/../b", False, False), ("setup.cfg", True, False), ("v1.2.3", False, False), ("foo_bar", False, True), ("HttpClient", False, True), ("a::b", False, True), ("plain", False, False)])
def test_signal_predicates(spark, token, path, identifier):
    assert (one(spark, token, is_path(F.col("x"))), one(spark, token, is_identifier(F.col("x")))) == (path, identifier)


def test_greedy_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate((5, 9, 3, 2))], "doc int, i int, cost int")
    assert logs.greedy(rows, "doc", [F.col("i")], F.col("cost"), "i", 10).first().items == [0, 2, 3]


def test_outermost(spark):
    spans = spark.createDataFrame([("p", 0, 10), ("p", 2, 5), ("p", 10, 12), ("p", 4, 11)], "path string, lo int, hi int")
    assert sorted((r.lo, r.hi) for r in graph.outermost(spans).collect()) == [(0, 10), (4, 11), (10, 12)]


def test_bucket_stream_reports_changes_and_replays(spark, tmp_path):
    source, schema = tmp_path / "in", "event_id long, event_type string, value double"
    spark.createDataFrame([(1, "a", 2.5), (2, "b", 1.0)], schema).write.parquet(str(source))
    frames = dashboard.Frames(spark, f"file://{tmp_path}/frames", most_frames=2)
    assert frames.next(None) == (None, None, None)
    run = lambda: dashboard.bucket_stream(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "ck"), frames).awaitTermination(120)
    run()
    event, frame, cursor = frames.next(None)
    assert (event, frame["rows"], cursor) == ("snapshot", [["a", 1, 2], ["b", 1, 1]], 1)
    run()  # a restart without news adds nothing
    assert frames.numbers() == [1] and frames.next(1) == (None, None, 1)
    spark.createDataFrame([(3, "a", 1.0)], schema).write.mode("append").parquet(str(source))
    run()
    assert frames.next(1)[0] == "snapshot" and frames.next(1)[1]["rows"] == [["a", 2, 3], ["b", 1, 1]]
    frames.add([("c", 1, 1)])
    assert frames.numbers() == [2, 3] and frames.next(0)[0] == "reset_required" and frames.next(9)[0] == "reset_required" and frames.next(1)[2] == 2


def test_retention_keeps_a_late_new_event(spark):
    schema = "event_id int, ts timestamp"
    import datetime as d

    at = lambda day: d.datetime(2024, 1, day)
    stored, new = spark.createDataFrame([(1, at(1)), (2, at(3))], schema), spark.createDataFrame([(3, at(1))], schema)
    assert {r.event_id for r in audit.retained(stored, new, "2024-01-02", 10).collect()} == {2, 3}
    assert {r.event_id for r in audit.retained(stored, new, "2024-01-02", 1).collect()} == {2}


@pytest.mark.parametrize(("line", "name"), [("pub fn a_b(&self)", "a_b"), ("\tclass Header(Base):", "Header"), ("async final def", None), ("classy x", None), ("fn (x)", None), ("fn 9a", None), ("", None), (None, None)])
def test_declared_name(spark, line, name):
    assert spark.createDataFrame([(line,)], "x string").select(structure.declared_name(F.col("x"))).first()[0] == name


def test_resolution_prefers_the_file_then_a_scope_without_namesakes(spark):
    declared = spark.createDataFrame([("f", "a", 1), ("f", "a", 2), ("g", "b", 3), ("g", "c", 4), ("h", "c", 5)], "file string, name string, node long")
    uses = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c"), ("f", "z"), ("f", None)], "file string, name string")
    kinds = lambda local: {r.name: (r.target, r.resolution) for r in structure.resolve(uses, declared, local).collect()}
    assert kinds("first") == {"a": (1, "local"), "b": (3, "scope"), "c": (None, "ambiguous"), "z": (None, "unresolved"), None: (None, "unresolved")}
    assert kinds("only")["a"] == (None, "ambiguous")


def test_seeds_keep_three_of_a_file(spark):
    rows = spark.createDataFrame([(1, "p", i) for i in range(5)] + [(1, "q", 9)], "task int, path string, id int")
    assert sorted((r.path, r.id, r.place) for r in structure.admit_seeds(rows, "task", "path", ["id"], "id").collect()) == [("p", 0, 1), ("p", 1, 2), ("p", 2, 3), ("q", 9, 4)]


def test_seeds_lose_only_neighbours_of_one_node(spark):
    rows = spark.createDataFrame([(1, "p", 1, "n"), (1, "p", 2, "n"), (1, "q", 3, "m"), (1, "r", 4, "n")], "task int, path string, rank int, node string")
    got = structure.admit_seeds(rows, "task", "path", ["rank"], "node").collect()
    assert sorted((r.rank, r.node) for r in got) == [(1, "n"), (3, "m"), (4, "n")]
