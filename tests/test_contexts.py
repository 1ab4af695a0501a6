"""Searches, traversals, builds, updates and streams against plain versions, and what their plans may not do."""

import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.functions.text import byte_offsets
from brindle.operators import codegraph as G
from brindle.operators import context as C
from brindle.operators import evidence as E
from brindle.operators import facts as X
from brindle.operators import evaluation, lexindex, multisearch
from brindle.operators import logs as L
from brindle.operators import running as R
from brindle.operators import search as S
from brindle.operators.intervals import enclosing
from brindle.sources import reuse
from brindle.sources.store import Store
from brindle.streaming import retention


def places(text: bytes, needle: bytes) -> list[int]:
    return [i for i in range(len(text) - len(needle) + 1) if text[i : i + len(needle)] == needle]


# searches


@pytest.mark.parametrize("many", [False, True])
def test_finder_against_plain_places(many, monkeypatch):
    rng = random.Random(4)
    needles = [b"aa", b"aba", b"b", "é".encode(), b"abab", b"zz"][: 6 if many else 3]
    for piece in (7, 1 << 24):
        monkeypatch.setattr(multisearch, "PIECE", piece)
        find = multisearch.Finder(needles)
        for _ in range(60):
            text = "".join(rng.choice("abé") for _ in range(rng.randrange(50))).encode()
            want = {i: p[:3] for i, n in enumerate(needles) if (p := places(text, n))}
            assert find(text, 3) == want


def test_occurrences_take_linear_time(spark):
    text = "a" * (16 << 20)
    began = time.perf_counter()
    assert len(multisearch.Finder([b"aa"])(text.encode(), 10_000)[0]) == 10_000
    assert time.perf_counter() - began < 1
    row = spark.createDataFrame([("f", "a" * 400_000)], "path string, text string")
    began = time.perf_counter()
    assert row.select(F.size(byte_offsets(F.col("text"), "aa", 10_000)).alias("n")).first().n == 10_000
    assert S.literal(row, "aa").count() == 399_999
    assert time.perf_counter() - began < 60


def test_long_lines_take_linear_time(spark):
    line = " ".join(["ok"] * 20_000 + ["0", "failed"])
    row = spark.createDataFrame([(line,), (line + " x",), ("tests failed now",), ("no failed tests",), ("failed",)], "line string")
    began = time.perf_counter()
    found = [r.y for r in row.select(L.has_word(F.col("line"), L.FAILURE_WORDS, L.FAILURE_ENDINGS).alias("y")).collect()]
    assert found == [False, False, True, False, True]
    assert time.perf_counter() - began < 60


def test_texts_are_not_carried_by_matches(spark):
    files = spark.createDataFrame([(f"f{i}", "x needle y " * 3) for i in range(5)], "path string, text string")
    assert S.literal(files, "needle").columns == ["path", "start", "end", "size"]
    rows = S.bounded(files, "needle", 7, 12).collect()
    assert len(rows) == 7 and all(r.truncated for r in rows) and bytes.fromhex(rows[0].excerpt) == b"x needle y x"


def plain_context(tasks, steps, nominated, files, declarations, budget):
    """Evidence of each task in order, and what is told, by one search after another."""
    order = sorted(files, key=lambda p: __import__("base64").urlsafe_b64encode(p.encode()).rstrip(b"=").decode())

    def search(kind, query, some):
        out = []
        for path in some:
            text = files[path].encode()
            if kind == "filename":
                found = [(0, 0)] if query.lower() in path.lower() else []
            else:
                needles = [query] if kind == "literal" else list(dict.fromkeys(query.lower().split()))
                hay = text if kind == "literal" else text.lower()
                found = [(i, i + len(n.encode())) for n in needles for i in places(hay, n.encode())]
            out += [(path, a, z) for a, z in found]
        return out[: budget.matches], len(out) > budget.matches

    evidence, told = {}, {}
    for task in tasks:
        near, rest, unknowns = [], [], set()
        for i, (kind, query) in enumerate(steps[task]):
            if kind != "filename":
                for path in nominated.get(task, []):
                    found, cut = search(kind, query, [path])
                    near += [(*x, kind) for x in found]
                    unknowns |= {f"plan_step_{i}_nominated_limited", "match_limit"} if cut else set()
            some = order
            if kind == "lexical":
                words = query.lower().split()
                some = [p for p in order if set(words) <= set(__import__("re").findall("[a-z0-9_]+", files[p].lower()))]
                some.sort(key=lambda p: (len(set(__import__("re").findall("[a-z0-9_]+", files[p].lower()))), order.index(p)))
            found, cut = search(kind, query, some)
            rest += [(*x, kind) for x in found]
            unknowns |= {f"plan_step_{i}_no_evidence"} if not found else set()
            unknowns |= {f"plan_step_{i}_limited", "match_limit"} if cut else set()
        rest.sort(key=lambda x: E_SUPPORT(x[0]))
        rows = []
        for k, (path, a, z, kind) in enumerate(near + rest):
            around = [(hi - lo, lo, hi) for p, lo, hi in declarations if p == path and lo <= a and z <= hi and hi - lo <= budget.excerpt_bytes]
            cut = k < budget.evidence_items and kind != "filename" and bool(around)
            left = max(a - max(budget.excerpt_bytes - (z - a), 0) // 2, 0)
            span = min(around)[1:] if cut else (0, 0) if kind == "filename" else (left, min(len(files[path].encode()), max(left + budget.excerpt_bytes, z)))
            rows.append((path, a, z, kind, *span, cut))
        first, others = rows[: len(near)], rows[len(near) :]
        queues = {p: [r for r in first if r[0] == p and r[6]] + [r for r in first if r[0] == p and not r[6]] for p in nominated.get(task, [])}
        ordered = []
        while any(queues.values()):
            for p in nominated[task]:
                if queues[p]:
                    ordered.append(queues[p].pop(0))
        looks, ids, kept = set(), set(), []
        for path, a, z, kind, lo, hi, cut in ordered + others:
            look = (path, kind, files[path].encode()[lo:hi])
            if look in looks:
                continue
            looks.add(look)
            if (path, a, z) not in ids:
                ids.add((path, a, z))
                kept.append((path, a, z, lo, hi, cut))
        evidence[task], told[task] = kept, unknowns
    return evidence, told


def E_SUPPORT(path):
    return path.startswith("tests/")


def test_planned_context_against_plain_searches(spark):
    rng = random.Random(9)
    files = {f"{d}/f{i}.py": "\n".join(" ".join(rng.choice("alpha beta Gamma delta run_it x".split()) for _ in range(rng.randrange(1, 6))) for _ in range(4)) for i in range(7) for d in ("src", "tests")}
    declarations = [(p, lo, lo + rng.randrange(4, 30)) for p, t in files.items() for lo in range(0, max(len(t) - 30, 1), 17)]
    steps = {1: [("literal", "beta"), ("lexical", "alpha"), ("filename", "F3")], 2: [("literal", "nothing here"), ("literal", "Gamma")], 3: [("lexical", "delta x")]}
    nominated = {1: ["src/f5.py", "src/f2.py"], 2: ["tests/f1.py"], 3: []}
    budget = E.Budget(evidence_items=9, excerpt_bytes=24, matches=11, output_bytes=4096)
    want, told = plain_context([1, 2, 3], steps, nominated, files, declarations, budget)
    tasks = spark.createDataFrame([(k, "do it", "implementation") for k in steps], "task long, text string, purpose string")
    plan = spark.createDataFrame([(k, i + 1, kind, query) for k, some in steps.items() for i, (kind, query) in enumerate(some)], "task long, step long, kind string, query string")
    chosen = spark.createDataFrame([(k, p, i + 1) for k, some in nominated.items() for i, p in enumerate(some)], "task long, path string, place long")
    table = spark.createDataFrame(list(files.items()), "path string, text string")
    outer = spark.createDataFrame(declarations, "path string, lo long, hi long")
    found = C.planned(tasks, "task", "text", "purpose", plan, chosen, table, outer, "s", budget, "2024-01-01T00:00:00Z")
    rows = found.evidence.orderBy("task", "place").collect()
    for task in steps:
        assert [(r.path, r.start, r.end, r["from"], r["to"], r.cut) for r in rows if r.task == task] == want[task]
    assert {(r.task, r.unknown) for r in found.unknowns.collect()} == {(t, u) for t, some in told.items() for u in some}
    packets = {r.task: r for r in found.packets.collect()}
    assert all(packets[t].items + packets[t].omitted == len(want[t]) and packets[t].delivered <= 4096 for t in steps)


def test_all_searches_read_the_files_once(spark, monkeypatch):
    scans = []
    real = multisearch.scan
    monkeypatch.setattr(multisearch, "scan", lambda *a, **k: scans.append(1) or real(*a, **k))
    files = spark.createDataFrame([(f"f{i}", f"alpha beta{i}") for i in range(4)], "path string, text string")
    searches = spark.createDataFrame([("literal", f"beta{i}") for i in range(4)] + [("lexical", "alpha")], "kind string, query string")
    within = spark.createDataFrame([("lexical", "alpha", "f2")], "kind string, query string, path string")
    found, states = multisearch.run(files, searches, within, 100, 100, 64, 1 << 20)
    assert len(scans) == 1 and found.count() == 4 + 4 + 1 and states.filter("reason is not null").isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # what is left works on the staged places
    # needles beyond a slice are searched in further readings, with equal results
    again, _ = multisearch.run(files, searches, within, 100, 100, 64, 1 << 20, slice_bytes=6)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, found.collect()), key=repr)


def test_no_path_decides_which_nominated_file_leads(spark):
    """A nominated file leads even when one that sorts earlier would fill the limit of matches."""
    files = spark.createDataFrame([("a.py", "word " * 50), ("z.py", "one word here")], "path string, text string")
    tasks = spark.createDataFrame([(1, "find", "implementation")], "task long, text string, purpose string")
    plan = spark.createDataFrame([(1, 1, "literal", "word")], "task long, step long, kind string, query string")
    chosen = spark.createDataFrame([(1, "z.py", 1)], "task long, path string, place long")
    none = spark.createDataFrame([], "path string, lo long, hi long")
    found = C.planned(tasks, "task", "text", "purpose", plan, chosen, files, none, "s", E.Budget(matches=5), "2024-01-01T00:00:00Z")
    assert found.evidence.orderBy("place").first().path == "z.py"


# intervals, totals, shares


def test_enclosing_against_all_pairs(spark):
    rng = random.Random(1)
    outer = [(f"p{rng.randrange(3)}", lo := rng.randrange(200), lo + rng.randrange(0, 90)) for _ in range(150)]
    spans = [(f"p{rng.randrange(3)}", a := rng.randrange(250), a + rng.randrange(0, 9)) for _ in range(200)]
    got = {tuple(r) for r in enclosing(spark.createDataFrame(spans, "path string, start long, end long"), spark.createDataFrame(outer, "path string, lo long, hi long"), 64).select("path", "start", "end", "lo", "hi").collect()}
    want = set()
    for p, a, z in set(spans):
        around = [(hi - lo, lo, hi) for q, lo, hi in outer if q == p and lo <= a and z <= hi and hi - lo <= 64]
        if around:
            want.add((p, a, z, *min(around)[1:]))
    assert got == want


def test_enclosing_of_a_crowded_file(spark):
    n = 20_000
    spans = spark.range(n).selectExpr("'p' as path", "id * 10 + 3 as start", "id * 10 + 5 as end")
    outer = spark.range(n).selectExpr("'p' as path", "id * 10 as lo", "id * 10 + 9 as hi")
    began = time.perf_counter()
    assert enclosing(spans, outer, 4096).filter("lo = start - 3").count() == n
    assert time.perf_counter() - began < 60


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(100)) for i in rng.sample(range(10_000), 500)]
    found = R.running(spark.createDataFrame(rows, "k long, v long").repartition(5), ["k"], F.col("v"), "t").orderBy("k").collect()
    total = 0
    for (k, v), r in zip(sorted(rows), found):
        total += v
        assert (r.k, r.t) == (k, total)
    assert [r.n for r in R.numbered(spark.createDataFrame(rows, "k long, v long"), [F.desc("k")], "n").orderBy(F.desc("k")).collect()] == list(range(1, 501))


def plain_grants(rows, allowance):
    left, out = allowance - sum(h for _, _, h in rows), {f: h for f, _, h in rows}
    short = sorted((d - h, f) for f, d, h in rows if d > h)
    files = len(short)
    for s, f in short:
        give = min(s, max(left // files, 0))
        left, files = left - give, files - 1
        out[f] += give
    return out


def test_shares_and_grants_against_folds(spark):
    rng = random.Random(8)
    for allowance in (0, 7, 40, 100, 1000):
        scopes = {s: [(f"f{i:02}", rng.randrange(12)) for i in range(rng.randrange(1, 14))] for s in range(6)}
        table = spark.createDataFrame([(s, f, d) for s, some in scopes.items() for f, d in some], "scope long, file string, demand long")
        shares = X.equal_shares(table, ["scope"], "file", allowance)
        held = {(r.scope, r.file): r.held for r in shares.collect()}
        got = {(r.scope, r.file): r.grant for r in X.grants(shares, ["scope"], "file", allowance).collect()}
        for s, some in scopes.items():
            left, files = allowance, len(some)
            for f, d in some:
                took = min(d, -(-left // files) if left > 0 else 0)
                left, files = left - took, files - 1
                assert held[s, f] == took
            want = plain_grants([(f, d, held[s, f]) for f, d in some], allowance)
            assert {f: got[s, f] for f, _ in some} == want
            assert sum(want.values()) <= max(allowance, 0) and all(want[f] >= held[s, f] for f, _ in some)


def test_a_large_scope_gathers_no_list(spark):
    rows = spark.range(200_000).selectExpr("0 as scope", "id as file", "id % 9 as demand")
    shares = X.equal_shares(rows, ["scope"], "file", 300_000)
    found = X.grants(shares, ["scope"], "file", 300_000)
    assert found.agg(F.sum("grant")).first()[0] == 300_000
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


# structure


def graph(spark, edges, nodes):
    table = spark.createDataFrame([(n, "symbol", "p", n, i, i, "type") for i, n in enumerate(nodes)], "node_id string, kind string, path string, name string, start_byte long, end_byte long, declaration_kind string")
    rows = [(f"e{i}", "calls", a, b, None, "confirmed" if b else "unresolved", i, i) for i, (a, b) in enumerate(edges)]
    return table, spark.createDataFrame(rows, "edge_id string, kind string, source_node string, target_node string, module string, resolution string, start_byte long, end_byte long")


def plain_traversal(edges, start, depth, most_nodes, most_edges):
    seen, taken, unknowns, frontier = [start], [], set(), [start]
    order = sorted(range(len(edges)), key=lambda i: (0 if edges[i][1] else 2, i))
    for _ in range(depth):
        here = [i for n in frontier for i in order if edges[i][0] == n]
        new = []
        for i in here:
            if edges[i][1] and edges[i][1] not in seen + new and len(seen) + len(new) < most_nodes:
                new.append(edges[i][1])
        found, full = [], False
        for i in here:
            target = edges[i][1]
            if len(taken) >= most_edges:
                unknowns.add("traversal_edge_limit_reached")
                break
            if target and target not in seen + new:
                unknowns.add("traversal_node_limit_reached")
                continue
            unknowns |= set() if target else {"unresolved_traversal_target"}
            taken.append(i)
            if target and target not in seen and target not in found:
                found.append(target)
        seen += found
        frontier = found
        if not here or not frontier:
            break
    else:
        if any(e[0] in frontier for e in edges):
            unknowns.add("traversal_depth_limit_reached")
    return taken, unknowns


def test_many_traversals_against_single_ones(spark):
    rng = random.Random(12)
    names = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(names), rng.choice([*names, None])) for _ in range(45)]
    nodes, table = graph(spark, edges, names)
    starts = spark.createDataFrame([(k, i, n) for k in ("a", "b") for i, n in enumerate(names[:6])], "task string, seed int, node_id string")
    for depth, most_nodes, most_edges in ((1, 16, 16), (3, 5, 9), (4, 50, 50), (0, 3, 3)):
        _, taken, unknowns = G.traverse_all(nodes, table, starts, ["task", "seed"], [], depth, most_nodes, most_edges)
        got, told = {}, {}
        for r in taken.orderBy("place").collect():
            got.setdefault((r.task, r.seed), []).append(int(r.edge_id[1:]))
        for r in unknowns.collect():
            told.setdefault((r.task, r.seed), set()).add(r.unknown)
        for k in ("a", "b"):
            for i, n in enumerate(names[:6]):
                want, why = plain_traversal(edges, n, depth, most_nodes, most_edges)
                assert got.get((k, i), []) == want, (depth, n)
                assert told.get((k, i), set()) == why, (depth, n)


def test_merged_seeds_keep_their_order(spark):
    """Edges of an earlier seed come first, whatever their ids; an edge of two seeds stays where it came first; the tail is cut."""
    nodes, edges = graph(spark, [("b", "x"), ("a", "x"), ("a", "b"), ("b", None)], ["a", "b", "x"])
    seeds = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (2, 1, "a")], "task long, place long, node_id string")
    _, found, unknowns = G.seeded(nodes, edges, seeds, "task", [])
    rows = {t: [r.edge_id for r in found.filter(F.col("task") == t).orderBy("place").collect()] for t in (1, 2)}
    assert rows == {1: ["e0", "e3", "e1", "e2"], 2: ["e1", "e2"]}
    assert {(r.task, r.unknown) for r in unknowns.collect()} == {(1, "unresolved_traversal_target"), (2, "traversal_depth_limit_reached"), (1, "traversal_depth_limit_reached")}
    _, cut, told = G.seeded(nodes, edges, seeds, "task", [], most_bytes=300)
    assert [r.edge_id for r in cut.filter("task = 1").orderBy("place").collect()] == ["e0", "e3"][: cut.filter("task = 1").count()]
    assert "structural_query_output_limit_reached" in {r.unknown for r in told.filter("task = 1").collect()}


SOURCES = [(f"m{i}.py", "\n".join(f"def f{i}_{k}(x):\n    return f{(i + 1) % 9}_{k}(x)" for k in range(i + 1))) for i in range(9)]


def sources(spark, rows=SOURCES):
    return spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary")


def test_build_loop_spends_an_allowance(spark):
    files = sources(spark)
    whole, ledger = X.build_loop(files, 1 << 20)
    demand = {r.path: r.demand for r in ledger.collect()}
    assert all(r.parses == 1 and r.grant == r.demand for r in ledger.collect())
    for allowance in (0, 5, 30, 60, sum(demand.values()) - 1):
        facts, ledger = X.build_loop(files, allowance)
        rows = ledger.collect()
        have = {r.path: r.n for r in facts.filter("class <> 'file'").groupBy("path").agg(F.count("*").alias("n")).collect()}
        assert sum(have.values()) <= allowance
        assert all(have.get(r.path, 0) == r.grant >= r.first and r.grant <= demand[r.path] for r in rows)
        assert all((r.parses == 2) == (r.grant > r.first) for r in rows)
        # what small files leave reaches the files that were cut
        assert sum(r.grant for r in rows) == min(allowance, sum(demand.values()))
    scope = spark.createDataFrame([("m3.py",), ("none.py",)], "path string")
    assert {r.path for r in X.build_loop(files, 100, scope)[1].collect()} == {"m3.py"}


def test_update_equals_a_full_build(spark):
    files = sources(spark, [*SOURCES, ("pkg/a.py", "from .b import g\n"), ("pkg/c.py", "g(1)\n")])
    prior = G.store_generation(G.generation(X.extract(files).cache(), "s"), "prior")
    hashed = lambda df: df.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"))
    cases = {
        "renamed": ([("m3.py", SOURCES[3][1].replace("def f3_0", "def h3_0"))], []),
        "added": ([("pkg/b.py", "def g(x):\n    return x\n")], []),
        "removed": ([], ["m5.py", "pkg/c.py"]),
        "all": ([("m0.py", "x = 1\n"), ("new.py", "def f4_1(y):\n    return y\n")], ["m8.py"]),
    }
    for name, (changed, removed) in cases.items():
        new = sources(spark, changed) if changed else files.limit(0)
        after = files.filter(~F.col("path").isin(*removed, *(p for p, _ in changed), "")).unionByName(new)
        found, again = G.update(prior, hashed(after), X.extract(new), "s")
        whole = G.build(X.extract(after).cache(), "s")
        one = G.identity(found.nodes, found.edges, found.unknowns, "s").first()
        assert one == G.identity(*whole, "s").first(), name
        uses = prior.facts.filter("class in ('call', 'reference')").count()
        assert again.filter("class <> 'import'").count() < uses / 2, name
    with pytest.raises(ValueError, match="m1.py"):
        G.update(prior, hashed(sources(spark, [("m1.py", "other")])), X.extract(files.limit(0)), "s")


def test_a_stored_graph_is_proved(spark, tmp_path):
    nodes, edges, unknowns = G.build(X.extract(sources(spark, SOURCES[:3])).cache(), "s")
    store = Store(spark, f"file://{tmp_path}/store", "w")
    G.save(store, "s", nodes, edges, unknowns)
    again = G.load(store, "s")
    assert [df.count() for df in again] == [nodes.count(), edges.count(), unknowns.count()]
    folder = store.current().split("\n")[1]
    changed = spark.createDataFrame(again[1].limit(2).collect(), again[1].schema)
    changed.write.mode("overwrite").parquet(f"{folder}/edges")
    with pytest.raises(ValueError, match="not those that were stored"):
        G.load(store, "s")


# the index


def test_index_reads_its_terms_alone(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(f"p{i}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randrange(1, 90)))) for i in range(400)], "path string, text string")
    store = Store(spark, f"file://{tmp_path}/store", "w")
    store.promote("s", lexindex.tables(docs), partitioned=lexindex.PARTITIONED)
    index = lexindex.Index.of(store.read)
    plan = lexindex.postings_of(index, ["w3"], 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "LessThanOrEqual(dl,20)" in plan and "PushedFilters" in plan
    for query in (["w0"], ["w0", "w1"], ["w3", "w30"], ["w39", "w38", "w37"], ["none"], ["w0", "none"]):
        for most in (1, 7, 1000):
            want = [tuple(r) for r in S.bm25(docs, query, most).select("path", "dl", "score").collect()]
            got = [tuple(r) for r in lexindex.search(index, query, most).select("path", "dl", "score").collect()]
            assert got == want, (query, most)
        scope = F.col("path").endswith("7")
        assert lexindex.document_frequency(index, query, scope).first() == S.document_frequency(docs, query, scope).first()


# reads


def test_reads_against_a_plain_cache(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(3)}", i, f"p{rng.randrange(9)}", rng.choice([10, 25, 40]), rng.randrange(2)) for i in range(300)]
    got = {(r.request, r.ord): r for r in reuse.reused(spark.createDataFrame(rows, "request string, ord long, path string, size long, modified long"), 120).collect()}
    for request in ("r0", "r1", "r2"):
        held, kept, bound = {}, 0, False
        for _, i, path, size, modified in sorted(r for r in rows if r[0] == request):
            hit = held.get(path) == (size, modified)
            if not hit and kept + size > 120:
                bound = True
            elif not hit:
                held[path], kept = (size, modified), kept + size
            assert tuple(got[request, i])[3:] == (hit, kept, bound)


# retention


def test_what_is_kept_does_not_depend_on_the_order():
    rng = random.Random(7)
    for _ in range(200):
        events = [(rng.randrange(50), i, rng.randrange(1, 9)) for i in range(rng.randrange(1, 30))]
        newest = max(e[0] for e in events)
        age, most, most_bytes = rng.randrange(1, 60), rng.randrange(1, 12), rng.randrange(1, 60)
        want, used = [], 0
        for e in sorted(events, reverse=True):
            used += e[2]
            if e[0] < newest - age or len(want) >= most or used > most_bytes:
                break
            want.append(e)
        rng.shuffle(events)
        kept, horizon, seen = [], (-1 << 62, -1 << 62), -1 << 62
        while events:
            n = rng.randrange(1, 6)
            part, events = events[:n], events[n:]
            seen = max(seen, *(e[0] for e in part))
            kept, horizon = retention.keep_newest(kept + part, horizon, seen, age, most, most_bytes)
        assert kept == want


def test_retention_through_a_restart(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(f"w{rng.randrange(3)}", i, 1_700_000_000 + rng.randrange(1000), rng.randrange(1, 9)) for i in range(120)]
    schema = "workspace string, event_id long, at long, size long"
    source, folder = f"{tmp_path}/source", f"{tmp_path}/out"
    table = spark.createDataFrame(rows, schema).select("workspace", "event_id", F.timestamp_seconds("at").alias("ts"), "size")
    limits = ("600 seconds", 15, 70)
    part = lambda k: table.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    part(0)
    start = lambda: retention.start(spark.readStream.schema(retention.COLUMNS).parquet(source), folder, *limits, partitions=2)
    start().awaitTermination(120)
    part(1)
    # the batch is computed and its folder written in part, then the stream dies
    broken = retention.changes
    failing = lambda *a: broken(*a).withColumn("kept", F.when(F.col("event_id") % 5 == 0, F.raise_error(F.lit("dies")).cast("boolean")).otherwise(F.col("kept")))
    monkeypatch.setattr(retention, "changes", failing)
    with pytest.raises(Exception, match="dies"):
        start().awaitTermination(120)
    monkeypatch.setattr(retention, "changes", broken)
    part(2)
    start().awaitTermination(120)
    got = sorted(map(tuple, retention.current(spark, folder).select("workspace", "event_id").collect()))
    want = sorted(map(tuple, retention.retained_each(table, *limits).select("workspace", "event_id").collect()))
    assert got == want and len(got) > 10


@pytest.mark.parametrize("slice_bytes", [1 << 20, 4])
def test_files_that_hold_needles(spark, slice_bytes):
    files = spark.createDataFrame([("a", "one two two"), ("b", "two\nthree"), ("c", "")], "path string, text string")
    needles = spark.createDataFrame([(1, "two"), (2, "three"), (3, "Two"), (4, ""), (5, None), (6, "two"), (7, "e t")], "k int, needle string")
    found = {(r["k"], r["path"]) for r in evaluation.holding(files, needles, "k", slice_bytes).collect()}
    assert found == {(1, "a"), (1, "b"), (2, "b"), (6, "a"), (6, "b"), (7, "a")}
    assert evaluation.holding(files, needles.limit(0), "k").count() == 0


def test_declarations_are_recovered_whole_or_not_at_all(spark):
    art = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "")], "path string, text string")
    h = {r["path"]: r["h"] for r in art.select("path", E.content_hash(F.col("text")).alias("h")).collect()}
    changes = [(1, "a", h["a"]), (1, "a", h["a"]), (2, "a", h["a"]), (2, "gone", h["a"]), (3, "b", None), (4, "b", h["b"])]
    pairs = [(1, "a", h["a"], "c", h["c"]), (4, "b", h["b"], "b", h["b"])]
    items = [(1, "c", h["c"]), (1, "b", h["b"])]
    rows = lambda data, cols: spark.createDataFrame(data, cols)
    entries = E.declared_entries(rows(changes, "k int, path string, content_hash string"), rows(pairs, "k int, source string, source_hash string, test string, test_hash string"), rows(items, "k int, path string, content_hash string"), "k")
    declared = rows([(1, "change_set", "s", E.UNPROVED_BASE), (1, "associated_tests", "s", None), (2, "change_set", "s", None), (3, "change_set", "s", None), (4, "change_set", "s", None), (4, "associated_tests", "old", None), (5, "change_set", "s", None)], "k int, kind string, workspace_snapshot string, base_status string")
    evidence, states = E.recovered_declarations(declared, entries, "k", art, "s")
    assert {tuple(r) for r in states.collect()} == {(1, "recovered", None, E.BASE_UNKNOWN, 5), (2, "stale", "source_unavailable", None, 2), (3, "stale", "source_changed", None, 1), (4, "stale", "snapshot", None, 2), (5, "recovered", None, None, 0)}
    assert {(r["k"], r["kind"], r["path"]) for r in evidence.collect()} == {(1, "change_set", "a"), (1, "associated_tests", "c"), (1, "convention_exemplars", "b")}
