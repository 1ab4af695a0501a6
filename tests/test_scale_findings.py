"""What held on small tables only: files in one split, limits that the SQL does not have, scopes dealt to several tasks."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import facts as X
from brindle.operators import nominate as N
from brindle.sources import workspace as W

TINY = "/root/testdata/sf0.001"


def test_shares_of_a_scope_stay_in_one_task(spark):
    # a join planned by a shuffle that turns into a broadcast while the query runs
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        files = spark.range(400_000).select((F.col("id") % 50).alias("scope"), F.col("id").alias("file"))
        demands = files.groupBy("scope", "file").agg((F.count("*") + 1).alias("demand"))
        held = X.equal_shares(demands, ["scope"], "file", 100).groupBy("scope").agg(F.sum("held").alias("held")).collect()
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert len(held) == 50 and {r.held for r in held} == {100}


def test_build_takes_all_files_unless_told(spark):
    files = spark.createDataFrame([(f"f{i}.py", bytearray(b"a = b\n")) for i in range(6)], "path string, content binary")
    assert X.build_loop(files, 12, max_files=None)[1].count() == 6
    assert X.build_loop(files, 12, max_files=4)[1].count() == 4


@pytest.mark.parametrize(("most", "n"), [(None, 5), (2, 2)])
def test_index_holds_all_files_unless_told(spark, most, n):
    files = spark.createDataFrame([(f"f{i}.py", bytearray(b"def load_it(): pass\n")) for i in range(5)] + [("f.unknown", bytearray(b"def x_y(): pass\n"))], "path string, content binary")
    assert N.identifier_index(files, most=most)[0].count() == n


def test_index_query_has_no_ceiling(spark, monkeypatch):
    from brindle.plans import planning

    monkeypatch.setattr(N, "INDEXED_FILES", 3)
    monkeypatch.setattr(N.identifier_index, "__defaults__", (3,))
    assert planning.identifier_index(spark, TINY).count() == W.files(spark, TINY).filter("path not like 'area%'").count()


def test_inventory_query_has_no_bounds(spark, monkeypatch):
    from brindle.operators import admission
    from brindle.plans import security

    monkeypatch.setattr(admission.inventory, "__defaults__", (3, *admission.inventory.__defaults__[1:]))
    assert sum(r.files for r in security.artifact_inventory(spark, TINY).collect()) == spark.read.parquet(f"{TINY}/documents.parquet").count()


def test_search_without_a_budget_gives_all_matches(spark):
    from brindle.operators import evidence as E

    art = spark.createDataFrame([(f"p{i}", "The the" * 2000) for i in range(4)] + [("q", "the")], "path string, text string")
    scope = art.filter("path like 'p%'").select("path")
    for kind, n in (("lexical", 16_000), ("literal", 8000), ("filename", 0)):
        assert E.search(art, kind, "the", None, scope)[0].count() == n
    assert E.search(art, "literal", "the", E.Budget(matches=10), scope)[0].count() == 10
    with pytest.raises(ValueError, match="budget"):
        E.search(art, "lexical", "the", None)


def test_a_path_declared_twice_keeps_its_right_hash(spark, tmp_path):
    import duckdb

    from brindle.plans import assembly

    # two orders of one customer name one document, one of them with a hash that is wrong
    import glob
    import os
    import shutil

    for f in glob.glob(f"{TINY}/*.parquet"):
        shutil.copy(f, tmp_path)
    con = duckdb.connect()
    con.execute(f"copy (select o.* replace (1000 as o_custkey, 10_000_000 + i * 1003 * 7 + d as o_orderkey, case when i = 0 then 490000 else 100000 end as o_totalprice) from (from '{TINY}/orders.parquet' limit 1) o, range(2) t(i), range(0, 100) u(d)) to '{tmp_path}/orders.parquet' (format parquet)")
    for f in glob.glob(f"{tmp_path}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = assembly.declaration_states(spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({assembly.ORACLES['declaration_states']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_only_declarations_of_looked_at_files_are_joined(spark):
    from brindle.operators import evidence as E

    matches = spark.createDataFrame([(f"p{i}", 5, 7, "literal_search", i) for i in range(9)], "path string, start long, end long, method string, rank long")
    declared = spark.createDataFrame([(f"p{i}", 1, 9) for i in range(9)], "path string, lo long, hi long")
    out = E.cut_to_declarations(matches, declared, 100, 2)
    assert sorted((r["rank"], r["from"], r.cut) for r in out.collect())[:3] == [(0, 1, True), (1, 1, True), (2, 5, False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


def test_files_are_dealt_to_all_cores_before_the_parse(spark):
    assert X.extract(W.files(spark, TINY)).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_a_family_writes_no_edge_it_has_no_use_for(spark, monkeypatch):
    from brindle.plans import codegraphs

    written, keep = {}, codegraphs.staged
    monkeypatch.setattr(codegraphs, "staged", lambda df, name: written.setdefault(name, keep(df, name)))
    codegraphs.seed_family(spark, TINY)
    assert {r.kind for r in written["edges"].select("kind").distinct().collect()} == {"declares", "contains", "references"}
    assert written["edges"].filter("target_node is null").isEmpty() and written["facts"].filter("class = 'call'").isEmpty()


def test_plain_modules_are_not_read_by_the_tokenizer(monkeypatch):
    from brindle.functions import parsers

    plain = b"from ..a import B\nclass C(B):\n\tdef  f(self, x1, *, k=10):\n\t\tundef = k if x1 else g(k=2)\n\t\treturn async_.subclass.f\ndel z\n"
    slow = [(f.kind, f.start, f.end, f.name, f.parent) for f in parsers.parse(plain + b"# the tokenizer reads this\n", "python", 1 << 30).facts]
    monkeypatch.setattr(parsers.tokenize, "tokenize", None)
    assert [(f.kind, f.start, f.end, f.name, f.parent) for f in parsers.parse(plain, "python", 1 << 30).facts] == slow


@pytest.mark.parametrize("text", [b"x = 1if y else z\n", b"x = 0xab + 1e5 + .5e3\n", b"x = f'{y}'\n", b"match x:\n  case y: pass\n", b"type X = Y\n", b"x = \\\n y\n", "é = y\n".encode()])
def test_modules_that_are_not_plain_are_read_by_the_tokenizer(monkeypatch, text):
    from brindle.functions import parsers

    def told(_):
        raise KeyError("tokenizer")

    monkeypatch.setattr(parsers.tokenize, "tokenize", told)
    with pytest.raises(KeyError):
        parsers.parse(text, "python", 1 << 30)


def test_facts_of_wanted_classes_alone_are_made(spark):
    every = X.extract(W.files(spark, TINY))
    some = X.extract(W.files(spark, TINY), classes=["file", "import"])
    assert sorted(map(str, some.collect())) == sorted(map(str, every.filter("class in ('file', 'import')").collect()))


def test_queries_write_only_facts_they_read(spark, monkeypatch):
    from brindle.plans import codegraphs

    written, keep = {}, codegraphs.staged
    monkeypatch.setattr(codegraphs, "staged", lambda df, name: written.setdefault(name, keep(df, name)))
    codegraphs.disclosure_items(spark, TINY)
    assert {r["class"] for r in written["facts"].select("class").distinct().collect()} == {"file", "declaration", "call", "import"}


def _written(monkeypatch, *modules):
    names = []
    for module in modules:
        keep = module.staged
        monkeypatch.setattr(module, "staged", lambda df, name, keep=keep: names.append(name) or keep(df, name))
    return names


def test_files_that_a_cache_lacks_are_parsed_once(spark, monkeypatch):
    names = _written(monkeypatch, X)
    files = W.files(spark, TINY)
    X.with_cache(files, X.extract(files.limit(0)).withColumn("toolchain", F.lit(X.TOOLCHAIN)))
    assert names == ["fresh-facts"]


def test_other_order_of_facts_is_sorted_once(spark, monkeypatch):
    from brindle.plans import codegraphs

    names = _written(monkeypatch, codegraphs)
    codegraphs.graph_identity(spark, TINY)
    assert names == ["facts", "facts"]


def test_orientation_writes_no_edges(spark, monkeypatch):
    from brindle.plans import contexts

    names = _written(monkeypatch, contexts)
    contexts._parts(spark, TINY, ["file", "declaration"])
    assert "nodes" in names and "edges" not in names


def test_a_saved_graph_is_written_once_and_read_whole(spark, monkeypatch, tmp_path):
    from brindle.operators import codegraph as G
    from brindle.sources.store import Store

    graph = G.build(X.extract(W.files(spark, TINY)).cache(), "s")
    names = _written(monkeypatch, G)
    store = Store(spark, f"file://{tmp_path}", "w")
    G.save(store, "s", *graph)
    assert names == []
    nodes, edges, unknowns = G.load(store, "s")
    assert (nodes.count(), edges.count(), unknowns.count()) == tuple(df.count() for df in graph)


def test_a_validated_graph_is_read_once(spark):
    from brindle.operators import codegraph as G

    sha = "sha256:" + "0" * 63
    nodes = spark.createDataFrame([(sha + "1", "type"), (sha + "1", "type"), (sha + "2", "rumour"), ("x", "type")], "node_id string, declaration_kind string")
    edges = spark.createDataFrame([(sha + "a", "calls", sha + "1", sha + "2"), (sha + "b", "calls", sha + "1", None), ("e", "calls", sha + "8", sha + "9"), (sha + "d", "told", sha + "9", None)], "edge_id string, kind string, source_node string, target_node string")
    found = G.violations(nodes, edges)
    assert {r.problem: r.n for r in found.collect()} == {"node_id": 1, "declaration_kind": 1, "doubled_node": 1, "edge_id": 1, "edge_kind": 1, "unknown_end": 2}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_a_map_is_made_once(spark, monkeypatch):
    from brindle.operators import codegraph as G

    names = _written(monkeypatch, G)
    cols = ["relation", "resolution", "label", "source_path", "target_path", "target_kind", "within"]
    items = spark.createDataFrame([tuple(["calls"] + [f"{i % 7}"] * 6) + (i,) for i in range(50)], ", ".join(f"{c} string" for c in cols) + ", at long")
    shown, more = G.disclosed(items, ["at"], ["calls"], 3)
    assert [r["at"] for r in shown.collect()] == [0, 1, 2] and more and names == ["disclosed"]


def all_rows(df):
    return sorted(map(repr, df.collect()))


def test_facts_that_no_one_reads_are_not_found(spark):
    # F30-F38: the same rows of the wanted classes, and no names looked for where no reference is wanted
    from brindle.functions import parsers

    text = b"import os\nclass A(B):\n    def f(self, x):\n        y = g(x)\n        return h(y)\ndef k():\n    return f'{k()}'\n"
    for data in (text, text.replace(b"f'{k()}'", b"k()")):
        whole = parsers.parse(data, "python", 1 << 30).facts
        for wanted in (["declaration"], ["declaration", "contains"], ["call"], ["import"], ["reference"], []):
            got = parsers.parse(data, "python", 1 << 30, wanted).facts
            assert [f for f in got if f.kind in wanted] == [f for f in whole if f.kind in wanted]
    assert not any(f.kind in ("call", "reference") for f in got)
    files = spark.createDataFrame([("a.py", bytearray(text)), ("b.ts", bytearray(b"export function f(x) { return g(x); }"))], "path string, content binary")
    plain = X.extract(files, classes=["file", "declaration"]).drop("demand")
    assert all_rows(X.extract(files, classes=["file", "declaration"], counted=False).drop("demand")) == all_rows(plain)
    with pytest.raises(ValueError, match="ceiling"):
        X.extract(files, 10, ["file"], counted=False)


def test_file_nodes_need_no_parse(spark, monkeypatch):
    from brindle.plans import codegraphs as CG

    monkeypatch.setattr(X, "parse_task", lambda *a: pytest.fail("parsed"))  # F36
    assert CG.file_nodes(spark, TINY).count() == W.files(spark, TINY).count()


def unknowns_by_notes(facts):
    from brindle.operators import codegraph as G

    return {r.unknown for r in G.generation(facts, "s").notes.select("unknown").distinct().collect()}


UNKNOWN_CASES = {
    "names": [("a.py", b"def f(): pass\nf()\nf\n"), ("b.py", b"f()\ng()\n")],
    "namesakes in a file": [("a.py", b"def f(): pass\ndef f(): pass\nf\n")],
    "namesakes in files": [("a.py", b"def f(): pass\n"), ("b.py", b"def f(): pass\n"), ("c.py", b"f()\nf\n")],
    "calls without a name": [("a.py", b"x = 1\nx.y()\n")],
    "all known": [("a.py", b"def f(): pass\n"), ("b.py", b"f()\n")],
    "imports": [("a/b.py", b"from .c import d\n"), ("a/c/__init__.py", b"d = 1\n")],
    "imports that are lost": [("a/b.py", b"from .e import d\nimport os\n"), ("a/c.py", b"d = 1\n")],
    "broken": [("a.py", b"def f(:\n")],
    "exports": [("a.ts", b"export function f(x) { return 1; }")],
    "nothing": [("a.py", b"")],
}


@pytest.mark.parametrize("case", UNKNOWN_CASES)
def test_unknowns_are_those_of_the_notes(spark, case):
    # from names brought together, not from a row for each fact
    from brindle.operators import codegraph as G

    facts = X.extract(spark.createDataFrame([(p, bytearray(t)) for p, t in UNKNOWN_CASES[case]], "path string, content binary")).localCheckpoint()
    assert {r.unknown for r in G.graph_unknowns(facts).collect()} == unknowns_by_notes(facts)


def test_unknowns_of_broken_facts(spark):
    from brindle.operators import codegraph as G

    facts = X.extract(spark.createDataFrame([("a.py", bytearray(b"def f():\n    def g(): pass\n"))], "path string, content binary"))
    lost = facts.filter("not (class = 'declaration' and name = 'f')").unionByName(facts.filter("class = 'file'").withColumns({"class": F.lit("export"), "local_key": F.lit("export:0:1"), "name": F.lit("q")})).localCheckpoint()
    assert {r.unknown for r in G.graph_unknowns(lost).collect()} == unknowns_by_notes(lost) >= {"unresolved_local_containment", "unresolved_export_target"}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_import_is_one_row_where_its_file_is_looked_up(spark):
    # files are dealt to the bases they may be meant by; an import does not try fourteen paths
    from brindle.operators import codegraph as G

    paths = ["x/a.ts", "x/b/index.ts", "x/b.ts", "x/b/index.js", "x/c.py", "x/d/__init__.py", "x/e.ts.ts", "x/f.js", "x/g.mjs/index.ts", "h.tsx"]
    modules = {"./b": "x/b.ts", "./b/index": "x/b/index.ts", ".c": "x/c.py", ".d": "x/d/__init__.py", "./e.ts": None, "./e": None, "./f.js": "x/f.js", "./f": "x/f.js", "./g.mjs": None, "../h": "h.tsx", "./b/index.js": "x/b/index.js", "./none": None, "os": None}
    row = lambda path, cls, key, module=None: (path, "", cls, key, None, None, module, 0, 1, None, None, False, [])
    rows = [row(p, "file", "file") for p in paths] + [row("x/a.ts", "import", f"import:{i}", m) for i, m in enumerate(modules)]
    facts = spark.createDataFrame(rows, X.FACT_SCHEMA)
    edges = G.import_edges(facts, "s")[0]
    target = G.file_nodes(facts, "s").select(F.col("node_id").alias("target_node"), F.col("path").alias("to"))
    assert {r.module: r.to for r in edges.join(target, "target_node", "left").collect()} == modules
    assert G.imports_by_base(facts).count() == len(modules)


def test_namesakes_are_told_without_a_count_of_ids(spark):
    from brindle.operators import codegraph as G

    symbols = G.symbol_nodes(X.extract(spark.createDataFrame([("a.py", bytearray(b"f = 1\n"))], "path string, content binary")), "s")
    assert "distinct" not in plan_of(G._declared(symbols)[1]).lower()


def test_a_contract_is_held_in_one_parse(spark):
    # no second parse, no table of all keys
    files = spark.createDataFrame([(f"f{i}.py", bytearray(b"a = b\n")) for i in range(5)], "path string, content binary")
    facts = X.extract(files)
    assert plan_of(X.validated(facts, files)).count("MapInArrow") == 1
    assert X.validated(facts, files).count() == 0
    worse = facts.unionByName(facts.filter("path = 'f1.py' and class = 'declaration'")).withColumn("end_byte", F.when(F.col("path") == "f2.py", 99).otherwise(F.col("end_byte")))
    worse = worse.withColumn("class", F.when((F.col("path") == "f3.py") & (F.col("class") == "declaration"), "rumour").otherwise(F.col("class"))).withColumn("content_hash", F.when(F.col("path") == "f4.py", "no").otherwise(F.col("content_hash")))
    got = {(r.path, r.problem) for r in X.validated(worse, files).collect()}
    assert got == {("f1.py", "doubled_key"), ("f2.py", "span"), ("f3.py", "class"), ("f4.py", "content_hash")}


CALL_CASES = [*UNKNOWN_CASES.values(), [("a.py", b"def f():\n    g()\n    f()\n    x.g()\ng()\nh()\n"), ("b.py", b"def g():\n    h()\n    h()\ndef h(): pass\n"), ("c.py", b"def h():\n    def h(): pass\n    h()\n"), ("d.ts", b"g(); function k(x) { return g(x); }"), ("package.json", b'{"a.py": 1, "g2": 2}')]]


@pytest.mark.parametrize("case", range(len(CALL_CASES)))
def test_ends_of_calls_are_those_of_the_edges(spark, case):
    # told by path and key, without ids
    from brindle.operators import codegraph as G

    facts = X.extract(spark.createDataFrame([(p, bytearray(t)) for p, t in CALL_CASES[case]], "path string, content binary")).localCheckpoint()
    symbols = G.symbol_nodes(facts, "s")
    ends = G.graph_nodes(facts, "s").select("node_id", "path", F.coalesce("name", "path").alias("name"))
    edges = G.use_edges(facts, symbols, "s", "call")[0]
    by_id = edges.join(ends.toDF("source_node", "path", "caller"), "source_node").join(ends.toDF("target_node", "target_path", "callee"), "target_node", "left")
    assert all_rows(G.call_ends(facts)) == all_rows(by_id.select("path", "caller", "callee", "resolution", "target_path"))


def test_call_targets_make_no_ids(spark, monkeypatch):
    # both ends of a call were looked up by id among all nodes
    from brindle.plans import codegraphs

    plan = plan_of(codegraphs.call_targets(spark, "/root/testdata/sf0.001"))
    assert "sha2" not in plan and plan.count("Join LeftOuter") == 1


@pytest.mark.parametrize("query", ["snapshot_skipped", "snapshot_status"])
def test_skip_accounting_has_no_limit_that_its_sql_lacks(spark, monkeypatch, query):
    import duckdb

    from brindle.plans import retrieval

    for limit in ("MAX_FILES", "MAX_FILE_BYTES", "MAX_TOTAL_BYTES", "MAX_DEPTH"):
        monkeypatch.setattr(retrieval.A, limit, 3)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{TINY}/documents.parquet'")
    assert sorted(map(tuple, retrieval.QUERIES[query](spark, TINY).collect())) == sorted(con.execute(retrieval.ORACLES[query]).fetchall())


def test_a_snapshot_without_one_limit_keeps_the_others(spark):
    from brindle.sources import artifacts

    files = spark.createDataFrame([(f"f{i}", bytearray(b"x" * n)) for i, n in enumerate((5, 9, 3, 2))] + [("target/x", bytearray(b"y"))], "path string, content binary")
    for limits, kept, left in (((None,) * 4, 4, {"policy_excluded": 1}), ((None, None, 10, None), 3, {"policy_excluded": 1, "limit": 1}), ((2, None, None, None), 2, {"policy_excluded": 1, "limit": 2}), ((None, 8, None, None), 3, {"policy_excluded": 1, "oversized": 1})):
        accepted, skipped = artifacts.snapshot(files, *limits)
        assert accepted.count() == kept and {r.reason: r.files for r in skipped.collect()} == left


def test_a_step_tells_of_its_files_before_its_matches(spark):
    from brindle.operators import context as C
    from brindle.operators import evidence as E

    files = spark.createDataFrame([(f"f{i}.py", "word word") for i in range(4)] + [("g.py", "other " * 4)], "path string, text string")
    tasks = spark.createDataFrame([(1, "find", "implementation"), (2, "find", "implementation")], "task long, text string, purpose string")
    plan = spark.createDataFrame([(1, 1, "literal", "word"), (2, 1, "literal", "other")], "task long, step long, kind string, query string")
    chosen = spark.createDataFrame([], "task long, path string, place long")
    none = spark.createDataFrame([], "path string, lo long, hi long")
    found = C.planned(tasks, "task", "text", "purpose", plan, chosen, files, none, "s", E.Budget(matches=3, files=2), "2024-01-01T00:00:00Z")
    assert {(r.task, r.unknown) for r in found.unknowns.collect()} == {(1, "plan_step_0_limited"), (1, "file_limit"), (2, "plan_step_0_limited"), (2, "match_limit")}


def test_all_matches_are_cut_to_declarations_of_any_size(spark):
    from brindle.operators import evidence as E

    matches = spark.createDataFrame([(f"p{i}", 5, 7, "literal_search") for i in range(9)] + [("p0", 7, 9, "exact_read"), ("p1", 90_000, 90_002, "lexical_search")], "path string, start long, end long, method string")
    declared = spark.createDataFrame([(f"p{i}", 1, 9) for i in range(8)] + [("p1", 0, 100_000), ("p1", 2, 9)], "path string, lo long, hi long")
    got = {(r.path, r.start): (r["from"], r.to, r.cut) for r in E.cut_to_declarations(matches, declared).collect()}
    want = {(f"p{i}", 5): (1, 9, True) for i in range(8)} | {("p1", 5): (2, 9, True), ("p8", 5): (5, 7, False), ("p0", 7): (7, 9, False), ("p1", 90_000): (0, 100_000, True)}
    assert got == want
    none = E.cut_to_declarations(matches, declared.limit(0)).collect()
    assert len(none) == 11 and not any(r.cut for r in none)


def test_seeds_need_only_the_graph_around_them(spark):
    from brindle.operators import codegraph as G

    facts = X.extract(W.files(spark, TINY), classes=["file", "declaration", "contains", "call"], counted=False).cache()
    nodes, edges, _ = G.build(facts, "s")
    start = spark.createDataFrame([("pkg/c1/m1.py",), ("web/s1.ts",)], "path string")
    kinds = ["contains", "calls", "declares"]
    near, around, _ = G.surroundings(facts, start, kinds, "s")
    every = {r.edge_id: r for r in edges.collect()}
    path = {r.node_id: r.path for r in nodes.select("node_id", "path").collect()}
    some = {r.edge_id: r for r in around.collect()}
    reached = {r.path for r in start.collect()}
    reached |= {path[e.target_node] for e in every.values() if path[e.source_node] in reached and e.target_node}
    assert some == {k: e for k, e in every.items() if path[e.source_node] in reached and e.kind in kinds}
    assert 0 < len(some) < len(every) / 2 and {r.path for r in near.collect()} >= reached
