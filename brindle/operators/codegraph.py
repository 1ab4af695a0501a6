"""The property graph of a workspace: nodes and edges from facts, and queries over them.

Every step is a join on (path, key) or (path, name) with one row a key on the joined side, so no fact becomes two. What
does not resolve stays as an edge without a target, and is counted among the unknowns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import digest
from brindle.operators.structure import declaration_kind
from brindle.sources.store import Store, staged

EDGE_KINDS = ("declares", "contains", "imports", "exports", "calls", "references")
NODE_COLUMNS = ["node_id", "kind", "path", "name", "start_byte", "end_byte", "declaration_kind"]
EDGE_COLUMNS = ["edge_id", "kind", "source_node", "target_node", "module", "resolution", "start_byte", "end_byte"]
#: What tells a fact from all others of a workspace.
FACT_OF = ["path", "local_key"]
# Endings that name a module's file, and those tried in order for a module without one; package manifests.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
TRIED = (*SCRIPT_ENDINGS, "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs", "/__init__.py")
MANIFESTS = ("package.json", "Cargo.toml", "pyproject.toml", "go.mod")


def file_id(path: Column, snapshot: str) -> Column:
    return digest("graph-node", F.lit(snapshot), path, F.lit("file"))


def symbol_id(path: Column, key: Column, snapshot: str) -> Column:
    return digest("graph-node", F.lit(snapshot), path, F.lit("symbol"), key)


def edge_id(kind: Column, source: Column, target: Column, module: Column, resolution: Column, start: Column, end: Column, snapshot: str) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("\x01"))  # noqa: E731  a mark for null: no digest or module holds it
    return digest("graph-edge", F.lit(snapshot), kind, source, text(target), text(module), resolution, text(start), text(end))


def _edges(rows: DataFrame, kind: str, source: Column, target: Column, module: Column, resolution: Column, snapshot: str) -> DataFrame:
    """Edges, with the fact (path, local_key) that each comes from."""
    out = rows.select(*FACT_OF, F.lit(kind).alias("kind"), source.alias("source_node"), target.alias("target_node"), module.cast("string").alias("module"), resolution.alias("resolution"), "start_byte", "end_byte")
    return out.withColumn("edge_id", edge_id(*(F.col(c) for c in ("kind", "source_node", "target_node", "module", "resolution", "start_byte", "end_byte")), snapshot)).select(*EDGE_COLUMNS, *FACT_OF)


def file_nodes(facts: DataFrame, snapshot: str) -> DataFrame:
    none = F.lit(None)
    return facts.filter("class = 'file'").select(file_id(F.col("path"), snapshot).alias("node_id"), F.lit("file").alias("kind"), "path", none.cast("string").alias("name"), none.cast("long").alias("start_byte"), none.cast("long").alias("end_byte"), none.cast("string").alias("declaration_kind"))


def symbol_nodes(facts: DataFrame, snapshot: str) -> DataFrame:
    """One node per declaration, with the key its file knows it by."""
    return facts.filter("class = 'declaration'").select(symbol_id(F.col("path"), F.col("local_key"), snapshot).alias("node_id"), F.lit("symbol").alias("kind"), "path", "name", "start_byte", "end_byte", declaration_kind(F.col("syntax_kind")).alias("declaration_kind"), "local_key")


def _declares(symbols: DataFrame, snapshot: str) -> DataFrame:
    return _edges(symbols, "declares", file_id(F.col("path"), snapshot), F.col("node_id"), F.lit(None), F.lit("confirmed"), snapshot)


def inner_key() -> Column:
    """The key of the declaration that a containment is of."""
    return F.expr("substr(local_key, length(concat('contains:', parent_key, ':')) + 1)")


def _contains(facts: DataFrame, symbols: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    inner = facts.filter("class = 'contains'").withColumn("inner_key", inner_key())
    keys = symbols.select("path", F.col("local_key").alias("k"), F.col("node_id").alias("n"))
    found = inner.join(keys.toDF("path", "parent_key", "source"), ["path", "parent_key"], "left").join(keys.toDF("path", "inner_key", "target"), ["path", "inner_key"], "left")
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    return _edges(found.filter(whole), "contains", F.col("source"), F.col("target"), F.lit(None), F.lit("confirmed"), snapshot), found.filter(~whole).select(*FACT_OF, F.lit("unresolved_local_containment").alias("unknown"))


def module_base(path: Column, module: Column) -> Column:
    """The path that a relative module names, without its ending; null where it is not relative or leaves the workspace."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    folder = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.substr(module, dots + 1)
    up = dots - 1
    python = F.when((F.size(folder) >= up) & rest.rlike(r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*$"), F.concat(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - up, F.lit(0))), F.split(rest, r"\.")))

    def step(at, x):
        above = F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))
        return F.when(x.isin("", "."), at).when(x == "..", above).otherwise(F.concat(at, F.array(x)))

    script = F.aggregate(F.split(module, "/"), folder, step)
    slashes = module.startswith("./") | module.startswith("../")
    base = F.when(slashes, script).when(module.startswith("."), python)
    usable = ~path.startswith("/") & ~path.contains("\\") & ~module.contains("\\") & (F.size(parts) > 0)
    return F.when(usable, F.array_join(base, "/"))


def imports_by_base(facts: DataFrame) -> DataFrame:
    """Imports with what their files are looked up by: the path that they name (base), and whether it has its ending (ended)."""
    imports = facts.filter("class = 'import'").withColumn("base", module_base(F.col("path"), F.col("module")))
    return imports.withColumn("ended", F.col("base").rlike("(" + "|".join(e.replace(".", r"\.") for e in SCRIPT_ENDINGS) + ")$"))


def files_by_base(paths: DataFrame) -> DataFrame:
    """(base, ended, place, candidate): the bases that each file may be meant by, and its place among the files of a base.

    A file has one or two endings that are tried, so that files are dealt to few bases, and an import to one.
    """
    means = lambda base, ended, place: F.struct(base.alias("base"), F.lit(ended).alias("ended"), F.lit(place).alias("place"))
    path = F.col("path")
    tried = [F.when(path.endswith(e), means(F.substr(path, F.lit(1), F.length(path) - len(e)), False, i)) for i, e in enumerate(TRIED)]
    return paths.select(path.alias("candidate"), F.explode(F.array_compact(F.array(means(path, True, 0), *tried))).alias("m")).select("m.*", "candidate")


def _imports(facts: DataFrame, paths: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    first = files_by_base(paths).groupBy("base", "ended").agg(F.min(F.struct("place", "candidate"))["candidate"].alias("candidate"))
    found = imports_by_base(facts).join(first, ["base", "ended"], "left").withColumn("target", F.when(F.col("candidate").isNotNull(), file_id(F.col("candidate"), snapshot)))
    resolution = F.when(F.col("target").isNotNull(), "confirmed").otherwise("unresolved")
    return _edges(found, "imports", file_id(F.col("path"), snapshot), F.col("target"), F.col("module"), resolution, snapshot), found.filter("target is null").select(*FACT_OF, F.lit("unresolved_module_import").alias("unknown"))


def _declared(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By (path, name): the first declaration and how many; by name: the first and the last id of the workspace, one id if there is no other.

    The two ends tell one declaration from several; a count of distinct ids would shuffle every id of every name.
    """
    named = symbols.filter("name is not null")
    local = named.groupBy("path", "name").agg(F.min(F.struct("start_byte", "end_byte", "node_id"))["node_id"].alias("own"), F.count("*").alias("n_own"))
    scope = named.groupBy("name").agg(F.min("node_id").alias("any"), F.max("node_id").alias("last_any"))
    return local, scope


def _exports(facts: DataFrame, symbols: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    local, _ = _declared(symbols)
    found = facts.filter("class = 'export'").join(local, ["path", "name"], "left")
    resolution = F.when(F.col("own").isNotNull(), "confirmed").otherwise("unresolved")
    return _edges(found, "exports", file_id(F.col("path"), snapshot), F.col("own"), F.col("module"), resolution, snapshot), found.filter("own is null").select(*FACT_OF, F.lit("unresolved_export_target").alias("unknown"))


def _uses(facts: DataFrame, symbols: DataFrame, scoped: DataFrame, snapshot: str, fact: str) -> tuple[DataFrame, DataFrame]:
    """symbols: those of the facts' files; scoped: those of the workspace, or of the names that the facts use."""
    local, scope = _declared(symbols)[0], _declared(scoped)[1]
    kind, what = {"call": ("calls", "call"), "reference": ("references", "reference")}[fact]
    keys = symbols.select("path", F.col("local_key").alias("parent_key"), F.col("node_id").alias("encloser"))
    found = facts.filter(F.col("class") == fact).join(keys, ["path", "parent_key"], "left").join(local, ["path", "name"], "left").join(scope, "name", "left")
    own = F.col("own") if fact == "call" else F.when(F.col("n_own") == 1, F.col("own"))
    target = F.coalesce(own, F.when(F.col("any") == F.col("last_any"), F.col("any")))
    resolution = F.when(target.isNotNull(), "heuristic").otherwise("unresolved")
    edges = _edges(found, kind, F.coalesce("encloser", file_id(F.col("path"), snapshot)), target, F.lit(None), resolution, snapshot)
    why = F.when(F.col("any") < F.col("last_any"), f"ambiguous_{what}_target").otherwise(f"unresolved_{what}_target")
    return edges, found.filter(target.isNull()).select(*FACT_OF, why.alias("unknown"))


def _plain(found: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return found[0].select(*EDGE_COLUMNS), found[1].select("unknown")


def graph_nodes(facts: DataFrame, snapshot: str) -> DataFrame:
    return file_nodes(facts, snapshot).unionByName(symbol_nodes(facts, snapshot).select(*NODE_COLUMNS))


def declares_edges(symbols: DataFrame, snapshot: str) -> DataFrame:
    return _declares(symbols, snapshot).select(*EDGE_COLUMNS)


def contains_edges(facts: DataFrame, symbols: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(edges, unknowns): both ends are declarations of the file, found by key."""
    return _plain(_contains(facts, symbols, snapshot))


def import_edges(facts: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(edges, unknowns): a relative module resolves to the first of its candidates that is a file."""
    return _plain(_imports(facts, facts.filter("class = 'file'"), snapshot))


def export_edges(facts: DataFrame, symbols: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(edges, unknowns): an export means the first declaration of its name in its file."""
    return _plain(_exports(facts, symbols, snapshot))


def use_edges(facts: DataFrame, symbols: DataFrame, snapshot: str, fact: str) -> tuple[DataFrame, DataFrame]:
    """(edges, unknowns) of calls or references: the source is the enclosing declaration, or the file.

    A call means the first declaration of that name in its file; a reference means one only if the file has no namesake.
    Else it is the only declaration of the workspace.
    """
    return _plain(_uses(facts, symbols, symbols, snapshot, fact))


def call_ends(facts: DataFrame) -> DataFrame:
    """(path, caller, callee, resolution, target_path) of calls: what use_edges resolves them to, by the names and paths of their ends.

    A file's facts are dealt by path once, where enclosing declarations and namesakes lie beside each other. Ends are told by path
    and key, so no id is worked out and no node looked up by one. Only calls without a namesake in their file are dealt by name.
    The caller of a call outside of all named declarations is the file's path. facts is read twice: hand in a stored table.
    """
    is_declared = F.col("class") == "declaration"
    rows = facts.filter("class in ('declaration', 'call')").select("path", "class", "name", "local_key", F.when(is_declared, F.col("local_key")).otherwise(F.col("parent_key")).alias("within")).repartition("path")
    beside = lambda c, *by: F.max(F.when(is_declared, c)).over(Window.partitionBy("path", *by))
    calls = rows.withColumns({"caller": beside(F.col("name"), "within"), "own": beside(F.col("name"), "name")}).filter("class = 'call'")
    node = F.struct("path", "local_key")
    scope = facts.filter(is_declared & F.col("name").isNotNull()).groupBy(F.col("name").alias("key")).agg(F.min(node).alias("any"), F.max(node).alias("last_any"))
    # other calls go by their path, so that names that every file has, or none, crowd no task; what is found for them is not looked at
    wanting = F.col("own").isNull() & F.col("name").isNotNull()
    found = calls.withColumn("key", F.when(wanting, F.col("name")).otherwise(F.col("path"))).join(scope, "key", "left")
    target = F.when(F.col("own").isNotNull(), F.col("path")).when(wanting & (F.col("any") == F.col("last_any")), F.col("any.path"))
    resolved = found.withColumn("target_path", target)
    known = F.col("target_path").isNotNull()
    return resolved.select("path", F.coalesce("caller", "path").alias("caller"), F.when(known, F.col("name")).alias("callee"), F.when(known, "heuristic").otherwise("unresolved").alias("resolution"), "target_path")


@dataclass
class Generation:
    """A graph that can be updated: facts, nodes, edges with the fact each comes from, and notes (path, local_key, unknown)."""

    facts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    notes: DataFrame

    @property
    def unknowns(self) -> DataFrame:
        return self.notes.select("unknown").distinct()


def _resolved(facts: DataFrame, symbols: DataFrame, scoped: DataFrame, paths: DataFrame, own: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(edges, notes) of facts; own: declarations among them."""
    edges = _declares(own, snapshot)
    notes = facts.filter("class = 'file' and syntax_errors").select(*FACT_OF, F.lit("syntax_recovery_present").alias("unknown"))
    limited = facts.filter(F.expr("class = 'file' and array_contains(warnings, 'structural_resource_limit_reached')"))
    notes = notes.unionByName(limited.select(*FACT_OF, F.lit("structural_resource_limit").alias("unknown")))
    parts = (_contains(facts, symbols, snapshot), _imports(facts, paths, snapshot), _exports(facts, symbols, snapshot), _uses(facts, symbols, scoped, snapshot, "call"), _uses(facts, symbols, scoped, snapshot, "reference"))
    for part, note in parts:
        edges, notes = edges.unionByName(part), notes.unionByName(note)
    return edges, notes


def generation(facts: DataFrame, snapshot: str) -> Generation:
    """The graph of the facts. facts is read several times: hand in a stored table. Paths must be distinct."""
    # read by each builder: ids are worked out once
    symbols = staged(symbol_nodes(facts, snapshot), "symbols")
    edges, notes = _resolved(facts, symbols, symbols, facts.filter("class = 'file'").select("path"), symbols, snapshot)
    return Generation(facts, file_nodes(facts, snapshot).unionByName(symbols.select(*NODE_COLUMNS)), edges, notes)


def graph_unknowns(facts: DataFrame) -> DataFrame:
    """(unknown): what the notes of the facts' graph say, each once, without a row for each fact and without ids.

    Names are brought together by file, then over all files, in numbers that add up before they are shuffled; so a name that
    all files use is a few rows.
    """
    of_files = F.array_compact(F.array(F.when(F.col("syntax_errors"), "syntax_recovery_present"), F.when(F.array_contains("warnings", "structural_resource_limit_reached"), "structural_resource_limit")))
    told = facts.filter("class = 'file'").select(F.explode(of_files).alias("unknown"))

    key = lambda k, declared: F.struct(k.alias("key"), F.lit(declared).alias("declared"))
    is_declared = F.col("class") == "declaration"
    keys = F.when(is_declared, F.array(key(F.col("local_key"), 1))).otherwise(F.array(key(F.col("parent_key"), 0), key(inner_key(), 0)))
    ends = facts.filter("class in ('declaration', 'contains')").select("path", F.explode(keys).alias("k")).groupBy("path", "k.key").agg(F.max("k.declared").alias("declared"))
    told = told.unionByName(ends.filter("declared = 0").select(F.lit("unresolved_local_containment").alias("unknown")))

    paths = facts.filter("class = 'file'").select("path")
    lost = imports_by_base(facts).select("base", "ended").distinct().join(files_by_base(paths), ["base", "ended"], "left_anti")
    told = told.unionByName(lost.select(F.lit("unresolved_module_import").alias("unknown")))

    # a declaration is told from its namesakes in a file by its span, as by its key
    any_of = lambda c: F.max(c.cast("int"))
    place = lambda c: F.when(is_declared, F.col(c))
    named = is_declared & F.col("name").isNotNull()
    several = (F.min(place("start_byte")) != F.max(place("start_byte"))) | (F.min(place("end_byte")) != F.max(place("end_byte")))
    in_file = facts.filter("class in ('declaration', 'export', 'call', 'reference')").groupBy("path", "name").agg(F.count_if(named).alias("n_own"), F.coalesce(several, F.lit(False)).alias("several"), *(any_of(F.col("class") == c).alias(f"is_{c}") for c in ("export", "call", "reference")))
    own, wanted = F.col("n_own"), lambda c, open_: any_of((F.col(f"is_{c}") == 1) & open_).alias(c)
    in_all = in_file.groupBy("name").agg(F.count_if(own > 0).alias("files"), any_of((own > 0) & F.col("several")).alias("several"), wanted("export", own == 0), wanted("call", own == 0), wanted("reference", own != 1))
    ambiguous = (F.col("files") > 1) | (F.col("several") == 1)
    use = lambda c: F.when((F.col(c) == 1) & ambiguous, f"ambiguous_{c}_target").when((F.col(c) == 1) & (F.col("files") == 0), f"unresolved_{c}_target")
    why = F.array_compact(F.array(F.when(F.col("export") == 1, "unresolved_export_target"), use("call"), use("reference")))
    return told.unionByName(in_all.select(F.explode(why).alias("unknown"))).distinct()


def build(facts: DataFrame, snapshot: str, noted: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unknowns) of the facts; noted: unknowns that the caller has seen. Paths must be distinct.

    facts is read several times: hand in a stored table.
    """
    found = generation(facts, snapshot)
    unknowns = graph_unknowns(facts)
    if noted:
        unknowns = unknowns.unionByName(facts.sparkSession.createDataFrame([(x,) for x in noted], "unknown string"))
    return found.nodes, found.edges.select(*EDGE_COLUMNS), unknowns.distinct()


def identity(nodes: DataFrame, edges: DataFrame, unknowns: DataFrame, snapshot: str) -> DataFrame:
    """One row (graph_id, completeness, nodes, edges, doubled_files): the id is over the ids of all rows, by two-letter buckets.

    Ids are digests of all that a row holds, so no task needs more than a bucket of them.
    """
    # each table is read once: what is counted of edges and unknowns is counted with their ids
    rows = nodes.select(F.concat(F.lit("n"), "node_id").alias("x")).unionByName(edges.select(F.concat(F.lit("e"), "edge_id").alias("x"))).unionByName(unknowns.select(F.concat(F.lit("u"), "unknown").alias("x")))
    of = lambda mark: F.count_if(F.col("x").startswith(mark))
    buckets = rows.groupBy(F.substring(F.sha2("x", 256), 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("h"), of("n").alias("nodes"), of("e").alias("edges"), of("u").alias("unknowns"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    whole = buckets.agg(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), "\n").alias("all"), total("nodes"), total("edges"), F.when(F.sum("unknowns") > 0, "partial").otherwise("complete").alias("completeness"))
    doubled = nodes.filter("kind = 'file'").groupBy("path").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("doubled_files"))
    return whole.crossJoin(doubled).select(digest("structural-graph", F.lit(snapshot), F.col("completeness"), F.col("all")).alias("graph_id"), "completeness", "nodes", "edges", "doubled_files")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n): malformed or doubled ids, unknown kinds, and targets or sources that are no node.

    Both tables are read once: ends and nodes meet by id, and problems of a row travel with them.
    """
    sha = r"^sha256:[0-9a-f]{64}$"
    bad_node = F.when(~F.col("node_id").rlike(sha), "node_id").when(~F.coalesce(F.col("declaration_kind"), F.lit("other")).isin("function", "type", "variable", "other"), "declaration_kind")
    bad_edge = F.when(~F.col("edge_id").rlike(sha) | ~F.col("source_node").rlike(sha) | ~F.coalesce("target_node", "source_node").rlike(sha), "edge_id").when(~F.col("kind").isin(*EDGE_KINDS), "edge_kind")
    mark = lambda problem, node, is_node: F.struct(problem.cast("string").alias("problem"), node.cast("string").alias("node_id"), F.lit(is_node).cast("long").alias("is_node"))
    none = F.lit(None)
    of_node = F.array(mark(none, F.col("node_id"), 1), F.when(bad_node.isNotNull(), mark(bad_node, none, 0)))
    end = lambda c: F.when(F.col(c).isNotNull(), mark(none, F.col(c), 0))
    of_edge = F.array(end("source_node"), end("target_node"), F.when(bad_edge.isNotNull(), mark(bad_edge, none, 0)))
    rows = nodes.select(F.explode(of_node).alias("m")).unionByName(edges.select(F.explode(of_edge).alias("m"))).filter("m is not null").select("m.*")
    met = rows.groupBy("problem", "node_id").agg(F.count("*").alias("n"), F.sum("is_node").alias("nodes"))
    own = F.col("problem").isNotNull()
    what = F.when(own, F.col("problem")).when(F.col("nodes") == 0, "unknown_end").when(F.col("nodes") > 1, "doubled_node")
    return met.select(what.alias("problem"), F.when(own, F.col("n")).otherwise(1).alias("n")).filter("problem is not null").groupBy("problem").agg(F.sum("n").alias("n"))


def updated_facts(prior: DataFrame, replaced: DataFrame, removed: DataFrame) -> DataFrame:
    """Facts after files were replaced (their new facts) or removed (path): the rest is carried over, and all resolves anew."""
    gone = replaced.select("path").unionByName(removed.select("path")).distinct()
    return prior.join(gone, "path", "left_anti").unionByName(replaced)


def update(prior: Generation, manifest: DataFrame, replaced: DataFrame, snapshot: str) -> tuple[Generation, DataFrame]:
    """(generation, again): the graph of the files of manifest (path, content_hash), from the prior one and the facts of new files.

    A file of the manifest must be among the replaced ones or have facts of the same content in the prior graph; else the update
    raises, so what is carried over was read once from these bytes. Resolved again are only the facts of replaced files, uses
    of a name that gained or lost a declaration, and imports that may mean a file that came or went: again (path, local_key,
    class) of kept files. The prior tables must be stored ones.
    """
    fresh = staged(replaced, "replaced-facts")
    file_of = lambda df: df.filter("class = 'file'").select("path", "content_hash")
    known, now = file_of(prior.facts), file_of(fresh)
    missed = manifest.select("path", "content_hash").join(now, ["path", "content_hash"], "left_anti").join(known, ["path", "content_hash"], "left_anti")
    if not missed.isEmpty():
        raise ValueError(f"no facts of {missed.first()['path']}: neither parsed again nor held for this content")
    removed = known.select("path").join(manifest.select("path"), "path", "left_anti")
    gone = staged(now.select("path").unionByName(removed).distinct(), "gone")
    kept = prior.facts.join(gone, "path", "left_anti")
    facts = staged(kept.unionByName(fresh), "updated-facts")
    # names whose declarations differ
    declared = lambda df: symbol_nodes(df, snapshot).filter("name is not null").select("name", "node_id")
    before, after = declared(prior.facts.join(gone, "path", "left_semi")), declared(fresh)
    names = staged(before.join(after, ["name", "node_id"], "left_anti").unionByName(after.join(before, ["name", "node_id"], "left_anti")).select("name").distinct(), "changed-names")
    moved = now.select("path").join(known.select("path"), "path", "left_anti").unionByName(removed)
    uses = kept.filter("class in ('call', 'reference')").join(names, "name", "left_semi").select(*FACT_OF, "class")
    imports = imports_by_base(kept).join(files_by_base(moved), ["base", "ended"], "left_semi").select(*FACT_OF, F.lit("import").alias("class"))
    again = staged(uses.unionByName(imports), "resolved-again")
    subset = staged(kept.join(again.select(*FACT_OF), FACT_OF, "left_semi").unionByName(fresh), "facts-again")
    symbols = staged(symbol_nodes(facts, snapshot), "symbols")
    near = symbols.join(subset.select("path").distinct(), "path", "left_semi")
    used = subset.filter("class in ('call', 'reference')").select("name").distinct()
    edges, notes = _resolved(subset, near, symbols.join(used, "name", "left_semi"), facts.filter("class = 'file'").select("path"), symbol_nodes(fresh, snapshot), snapshot)
    carried = lambda df: df.join(gone, "path", "left_anti").join(again.select(*FACT_OF), FACT_OF, "left_anti")
    nodes = prior.nodes.join(gone, "path", "left_anti").unionByName(file_nodes(fresh, snapshot)).unionByName(symbol_nodes(fresh, snapshot).select(*NODE_COLUMNS))
    return Generation(facts, nodes, carried(prior.edges).unionByName(edges), carried(prior.notes).unionByName(notes)), again


def store_generation(found: Generation, name: str) -> Generation:
    """The generation, written and read again."""
    return Generation(*(staged(df, f"{name}-{part}") for part, df in (("facts", found.facts), ("nodes", found.nodes), ("edges", found.edges), ("notes", found.notes))))


def save(store: Store, snapshot: str, nodes: DataFrame, edges: DataFrame, unknowns: DataFrame) -> None:
    """Make a graph the current generation of a store, with its identity."""
    # the identity is that of the rows as they lie in the store: they are made and written once
    proof = lambda read: identity(read("nodes"), read("edges"), read("unknowns"), snapshot)
    store.promote(snapshot, {"nodes": nodes.select(*NODE_COLUMNS), "edges": edges.select(*EDGE_COLUMNS), "unknowns": unknowns, "identity": proof})


def load(store: Store, snapshot: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unknowns) of the store's graph of that snapshot; it raises where the rows do not make its identity again."""
    nodes, edges, unknowns = (store.read(t, snapshot) for t in ("nodes", "edges", "unknowns"))
    kept = store.read("identity", snapshot).first()
    if kept is None or identity(nodes, edges, unknowns, snapshot).first() != kept:
        raise ValueError("the graph's rows are not those that were stored")
    if not violations(nodes, edges).isEmpty():
        raise ValueError("the stored graph is malformed")
    return nodes, edges, unknowns


# queries


def order_key(edges: DataFrame, nodes: DataFrame, carried: list[str] = ()) -> DataFrame:
    """edges with `ord`, by which a traversal takes one node's edges: sure ones first, then by place, kind, target and module."""
    target = nodes.select(F.col("node_id").alias("target_node"), F.struct("path", "name", "start_byte", "end_byte").alias("to"))
    rank = F.when(F.col("resolution").isin("confirmed", "confirmed_manifest"), 0).when(F.col("resolution") == "heuristic", 1).when(F.col("resolution") == "unresolved", 2).otherwise(3)
    joined = edges.join(target, "target_node", "left").select(*EDGE_COLUMNS, *carried, "to")
    return joined.withColumn("ord", F.struct(rank.alias("rank"), "start_byte", "end_byte", "kind", "to", "module", "edge_id")).drop("to")


def function_locals(nodes: DataFrame, edges: DataFrame, most_depth: int = 64) -> DataFrame:
    """(local, function): variables whose nearest enclosing declaration that is no variable is a function.

    Climbs one level of containment a round, only with what still climbs; most_depth bounds a malformed graph.
    """
    kinds = nodes.select(F.col("node_id").alias("owner"), F.col("declaration_kind").alias("owner_kind"))
    # each level is read to see whether it goes on, and by the next one: made once
    parent = edges.filter("kind = 'contains' and target_node is not null").groupBy("target_node").agg(F.max(F.struct("edge_id", "source_node"))["source_node"].alias("owner"))
    parent = staged(parent, "parents")
    climb = nodes.filter("declaration_kind = 'variable'").select(F.col("node_id").alias("local")).join(parent.withColumnRenamed("target_node", "local"), "local").join(kinds, "owner")
    out = None
    for _ in range(most_depth):
        climb = staged(climb, "climb")
        here = climb.filter("owner_kind = 'function'").select("local", F.col("owner").alias("function"))
        out = here if out is None else out.unionByName(here)
        up = climb.filter("owner_kind = 'variable'").select("local", F.col("owner").alias("target_node"))
        if up.isEmpty():
            return out
        climb = up.join(parent, "target_node").select("local", "owner").join(kinds, "owner")
    return out


def looked_through(edges: DataFrame, locals_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges by `from_node`, nodes that withhold some): what a local resolves is its function's own; edges into locals and
    unresolved ones of locals are left out."""
    source = locals_.select(F.col("local").alias("source_node"), F.col("function").alias("owner"))
    target = locals_.select(F.col("local").alias("target_node"), F.lit(True).alias("into_local"))
    joined = edges.join(source, "source_node", "left").join(target, "target_node", "left").withColumn("from_node", F.coalesce("owner", "source_node"))
    held = F.coalesce(F.col("into_local"), F.lit(False)) | (F.col("owner").isNotNull() & F.col("target_node").isNull())
    return joined.filter(~held).drop("owner", "into_local"), joined.filter(held).select(F.col("from_node").alias("node_id")).distinct()


def _near(edges: DataFrame, nodes: DataFrame, frontier: DataFrame, keys: list[str]) -> DataFrame:
    """The edges (with from_node) that leave a frontier (keys, from_node, turn), with `at`, the order in which they are taken.

    The frontier picks its edges first; only these are joined to the nodes at their other ends and put in order.
    """
    here = edges.join(frontier, "from_node")
    return order_key(here, nodes, [*keys, "from_node", "turn"]).withColumn("at", F.struct("turn", "ord"))


def traverse_all(nodes: DataFrame, edges: DataFrame, starts: DataFrame, keys: list[str], kinds: list[str], depth: int, most_nodes: int, most_edges: int, locals_: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes (keys, node_id, place), edges (keys, place, EDGE_COLUMNS, from_node), unknowns (keys, unknown)) of many traversals.

    starts: (keys, node_id), one start a key. A level is one job for all keys: the frontiers of all of them pick their edges
    together, and the bounds hold for each key. A node's edges come by order_key, nodes in the order of discovery. An edge to a
    node beyond most_nodes is passed over; after most_edges nothing is taken. State is tables that each level stages; the driver
    holds none of it.
    """
    if depth < 0 or most_nodes < 1 or most_edges < 1 or any(k not in EDGE_KINDS for k in kinds):
        raise ValueError("a traversal takes known kinds and limits of one or more")
    allowed = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    withheld = None
    if locals_ is None:
        allowed = allowed.select(*EDGE_COLUMNS, F.col("source_node").alias("from_node"))
    else:
        allowed, withheld = looked_through(allowed.select(*EDGE_COLUMNS), locals_)
    seen = staged(starts.select(*keys, "node_id", F.lit(0).cast("long").alias("place")), "seen")
    frontier = seen.select(*keys, F.col("node_id").alias("from_node"), F.lit(0).cast("long").alias("turn"))
    taken, unknowns = [], []
    for _ in range(depth):
        if withheld is not None:
            unknowns.append(frontier.join(withheld, F.col("from_node") == F.col("node_id"), "left_semi").select(*keys, F.lit("local_variables_looked_through").alias("unknown")))
        here = _near(allowed, nodes, frontier, keys)
        n_taken = F.lit(0).cast("long")
        state = seen.groupBy(*keys).agg(F.count("*").alias("n_seen"))
        if taken:
            counts = taken[0]
            for part in taken[1:]:
                counts = counts.unionByName(part)
            state = state.join(counts.groupBy(*keys).agg(F.count("*").alias("n_taken")), keys, "left")
            n_taken = F.coalesce("n_taken", F.lit(0))
        state = state.select(*keys, "n_seen", n_taken.alias("n_taken"))
        known = seen.select(*keys, F.col("node_id").alias("target_node"), F.lit(True).alias("seen"))
        marked = here.join(known, [*keys, "target_node"], "left").join(state, keys)
        new = marked.filter("target_node is not null and seen is null").groupBy(*keys, "target_node", "n_seen").agg(F.min("at").alias("first"))
        admitted = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).filter(F.col("_n") <= most_nodes - F.col("n_seen")).select(*keys, "target_node", F.lit(True).alias("admitted"))
        judged = marked.join(admitted, [*keys, "target_node"], "left").withColumn("passes", F.col("target_node").isNull() | F.coalesce("seen", "admitted", F.lit(False)))
        line = Window.partitionBy(*keys).orderBy("at")
        run = F.sum(F.when(F.col("passes"), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0))
        judged = staged(judged.withColumn("run", run).withColumn("chosen", F.col("passes") & (F.col("n_taken") + F.col("run") <= most_edges)), "level")
        if judged.isEmpty():
            break
        # full: whatever comes after the last edge is cut off, and no more of it is considered
        last = judged.groupBy(*keys).agg(F.max(F.when(F.col("chosen"), F.col("at"))).alias("last"), F.count_if("chosen").alias("n_chosen"), F.max("n_taken").alias("before"))
        seen_to = judged.join(last, keys)
        full = F.col("before") + F.col("n_chosen") >= most_edges
        after = F.coalesce(F.col("at") > F.col("last"), F.lit(True))
        why = F.array_compact(F.array(F.when(full & after, "traversal_edge_limit_reached"), F.when(~F.col("passes") & ~(full & after), "traversal_node_limit_reached"), F.when(F.col("chosen") & F.col("target_node").isNull(), "unresolved_traversal_target")))
        unknowns.append(seen_to.select(*keys, F.explode(why).alias("unknown")).distinct())
        place = F.col("n_taken") + F.row_number().over(line) - 1
        taken.append(judged.filter("chosen").withColumn("place", place.cast("long")).select(*keys, "place", *EDGE_COLUMNS, "from_node"))
        first = judged.filter("chosen and seen is null and target_node is not null").groupBy(*keys, "target_node", "n_seen").agg(F.min("at").alias("first"))
        found = first.withColumn("turn", (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).cast("long"))
        found = staged(found.select(*keys, F.col("target_node").alias("node_id"), "turn", (F.col("n_seen") + F.col("turn")).alias("place")), "frontier")
        seen = seen.unionByName(found.select(*keys, "node_id", "place"))
        frontier = found.select(*keys, F.col("node_id").alias("from_node"), "turn")
        if found.isEmpty():
            break
    else:
        deeper = frontier.join(allowed.select("from_node"), "from_node", "left_semi").select(*keys, F.lit("traversal_depth_limit_reached").alias("unknown"))
        unknowns.append(deeper)
    if taken:
        edges_out = taken[0]
        for part in taken[1:]:
            edges_out = edges_out.unionByName(part)
    else:
        edges_out = _near(allowed, nodes, frontier, keys).limit(0).select(*keys, F.lit(0).cast("long").alias("place"), *EDGE_COLUMNS, "from_node")
    # a local that was looked through is shown too, after what was discovered
    sources = edges_out.groupBy(*keys, F.col("source_node").alias("node_id")).agg(F.min("place").alias("first")).join(seen.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")
    sizes = seen.groupBy(*keys).agg(F.count("*").alias("n_seen"))
    late = sources.join(sizes, keys).select(*keys, "node_id", (F.col("n_seen") + F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).cast("long").alias("place"))
    told = starts.select(*keys, F.lit("").alias("unknown")).limit(0)
    for part in unknowns:
        told = told.unionByName(part)
    return seen.unionByName(late), edges_out, told.distinct()


def traverse(nodes: DataFrame, edges: DataFrame, start: str, kinds: list[str], depth: int, most_nodes: int, most_edges: int, locals_: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(nodes, edges, unknowns) found outwards from start: nodes with their place of discovery, edges in the order they were taken."""
    if nodes.filter(F.col("node_id") == start).isEmpty():
        raise ValueError("the start is no node of the graph")
    starts = nodes.sparkSession.createDataFrame([(0, start)], "_key long, node_id string")
    found, taken, unknowns = traverse_all(nodes, edges, starts, ["_key"], kinds, depth, most_nodes, most_edges, locals_)
    return nodes.join(found.drop("_key"), "node_id"), taken.drop("_key", "from_node"), sorted(r["unknown"] for r in unknowns.collect())


#: Bounds of a seeded query: levels and edges of a seed's traversal, edges of its family, bytes of the answer.
SEED_DEPTH, SEED_MATCHES, FAMILY_EDGES, QUERY_BYTES = 1, 16, 64, 1 << 20


def seeded(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, key: str, kinds: list[str], matches: int = SEED_MATCHES, locals_: DataFrame | None = None, with_families: bool = True, most_bytes: int = QUERY_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes (key, node_id), edges (key, place, EDGE_COLUMNS), unknowns (key, unknown)) around each task's seeds (key, place, node_id).

    Every seed of every task is traversed in the same jobs, to depth SEED_DEPTH and at most SEED_MATCHES edges and as many
    nodes. The traversals are merged in the order of the seeds, an edge staying where it came first; the seeds' families follow
    them, so they only add to what the traversals gave. The answer's tail is cut where its rows as JSON pass most_bytes.
    """
    matches = min(matches, SEED_MATCHES)
    starts = seeds.select(key, F.col("place").cast("long").alias("seed_place"), "node_id").distinct()
    found, taken, unknowns = traverse_all(nodes, edges, starts, [key, "seed_place"], kinds, SEED_DEPTH, matches, matches, locals_)
    rows = taken.select(key, F.struct(F.lit(0).alias("part"), "seed_place", "place").alias("at"), *EDGE_COLUMNS)
    told = unknowns.select(key, "unknown")
    if with_families:
        around, cut = families(nodes, edges, seeds.select(F.col("node_id").alias("seed")).distinct(), kinds, FAMILY_EDGES)
        of = starts.withColumnRenamed("node_id", "seed")
        rows = rows.unionByName(around.join(of, "seed").select(key, F.struct(F.lit(1).alias("part"), "seed_place", "place").alias("at"), *EDGE_COLUMNS))
        told = told.unionByName(cut.join(of, "seed").select(key, F.lit("structural_seed_family_limit_reached").alias("unknown")))
    first = rows.groupBy(key, "edge_id").agg(F.min_by(F.struct(*[c for c in EDGE_COLUMNS if c != "edge_id"]), "at").alias("e"), F.min("at").alias("at"))
    merged = first.select(key, "at", *(F.col("edge_id") if c == "edge_id" else F.col(f"e.{c}").alias(c) for c in EDGE_COLUMNS))
    size = F.octet_length(F.to_json(F.struct(*EDGE_COLUMNS))).cast("long") + 1
    line = Window.partitionBy(key).orderBy("at")
    sized = merged.withColumns({"place": F.row_number().over(line).cast("long"), "_used": F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0))})
    sized = staged(sized.drop("at"), "seeded")
    kept = sized.filter(F.col("_used") <= most_bytes).drop("_used")
    told = told.unionByName(sized.filter(F.col("_used") > most_bytes).select(key, F.lit("structural_query_output_limit_reached").alias("unknown")))
    ends = kept.select(key, F.explode(F.array_compact(F.array("source_node", "target_node"))).alias("node_id"))
    every = found.select(key, "node_id").unionByName(ends).distinct()
    return every, kept, told.distinct()


SEED_REASONS = ("unique_symbol_in_exact_path", "unique_exact_file_path", "globally_unique_symbol", "globally_ambiguous_symbol")


def seed_candidates(nodes: DataFrame, signals: DataFrame, nominated: DataFrame, key: str, locals_: DataFrame | None = None) -> DataFrame:
    """(key, rank, position, path, offset, node_id): nodes that tasks name, by how surely.

    signals (key, kind, signal); nominated (key, path, place). Symbols of a named file come first, then the file, then
    symbols with a name of their own in the graph, then those with namesakes. Locals of functions are no seeds in a map.
    """
    symbols = nodes.filter("kind = 'symbol' and name is not null").select("node_id", "path", F.col("name").alias("signal"), F.col("start_byte").alias("offset"))
    if locals_ is not None:
        symbols = symbols.join(locals_.select(F.col("local").alias("node_id")), "node_id", "left_anti")
    names = signals.filter("kind = 'identifier'").select(key, "signal").distinct()
    asked = signals.filter("kind = 'path'").select(key, F.col("signal").alias("path")).distinct()
    files = asked.join(nodes.filter("kind = 'file'").select("path", "node_id"), "path").select(key, F.lit(1).alias("rank"), "path", F.lit(0).cast("long").alias("offset"), "node_id")
    named = names.join(symbols, "signal")
    inside = named.join(asked, [key, "path"], "left_semi").select(key, F.lit(0).alias("rank"), "path", "offset", "node_id")
    sizes = symbols.join(F.broadcast(names.select("signal").distinct()), "signal", "left_semi").groupBy("signal").agg(F.count("*").alias("n"))
    anywhere = named.join(F.broadcast(sizes), "signal").select(key, F.when(F.col("n") > 1, 3).otherwise(2).alias("rank"), "path", "offset", "node_id")
    order = nominated.groupBy(key, "path").agg(F.min("place").alias("position"))
    every = files.unionByName(inside).unionByName(anywhere).join(order, [key, "path"], "left")
    return every.select(key, "rank", F.coalesce("position", F.lit(1 << 30)).cast("long").alias("position"), "path", "offset", "node_id")


def _edges_of(facts: DataFrame, scoped: DataFrame, paths: DataFrame, kinds: list[str], snapshot: str) -> DataFrame:
    """The edges of these kinds that facts make; scoped: symbols of the workspace with the names that they use, paths: all files."""
    own = symbol_nodes(facts, snapshot)
    parts = {
        "declares": lambda: _declares(own, snapshot),
        "contains": lambda: _contains(facts, own, snapshot)[0],
        "imports": lambda: _imports(facts, paths, snapshot)[0],
        "exports": lambda: _exports(facts, own, snapshot)[0],
        "calls": lambda: _uses(facts, own, scoped, snapshot, "call")[0],
        "references": lambda: _uses(facts, own, scoped, snapshot, "reference")[0],
    }
    out = None
    for kind in kinds:
        part = parts[kind]().select(*EDGE_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def surroundings(facts: DataFrame, starts: DataFrame, kinds: list[str], snapshot: str, hops: int = SEED_DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, locals) of the workspace's graph as far as a traversal of `hops` levels from files starts (path) can read them.

    An edge is made by a fact of its source's file, so the edges of the files that are reached tell which files come next. Names
    resolve over the whole workspace, without ids of all its nodes. The last level's targets are there, with the locals among
    them, and what leaves them is not. facts is read several times: hand in a stored table with the classes of the kinds, files, declarations and contains.
    """
    paths = facts.filter("class = 'file'").select("path")
    reached = staged(starts.select("path").distinct(), "reached")
    edges = None
    for _ in range(hops + 1):
        near = staged(facts.join(reached, "path", "left_semi"), "facts-near")
        used = near.filter("class in ('call', 'reference') and name is not null").select("name").distinct()
        scoped = symbol_nodes(facts.join(used, "name", "left_semi"), snapshot)
        edges = staged(_edges_of(near, scoped, paths, kinds, snapshot), "edges-near")
        ends = scoped.select("node_id", "path")
        if "imports" in kinds:
            ends = ends.unionByName(paths.select(file_id(F.col("path"), snapshot).alias("node_id"), "path"))
        targets = edges.select(F.col("target_node").alias("node_id")).distinct()
        reached = staged(reached.unionByName(ends.join(targets, "node_id", "left_semi").select("path")).distinct(), "reached")
    near = staged(facts.join(reached, "path", "left_semi"), "facts-near")
    nodes = staged(graph_nodes(near, snapshot), "nodes-near")
    return nodes, edges, staged(function_locals(nodes, _edges_of(near, nodes, paths, ["contains"], snapshot)), "locals")


def named_nodes(facts: DataFrame, signals: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, locals): what seed_candidates reads of the graph of facts: files, symbols that signals (kind, signal) name, and the locals among these.

    Locals are told in the files that hold a variable of such a name. facts: files, declarations and contains, a stored table.
    """
    names = signals.filter("kind = 'identifier'").select(F.col("signal").alias("name")).distinct()
    asked = signals.filter("kind = 'path'").select(F.col("signal").alias("path")).distinct()
    symbols = staged(symbol_nodes(facts.join(names, "name", "left_semi"), snapshot).select(*NODE_COLUMNS), "named-symbols")
    near = staged(facts.join(symbols.filter("declaration_kind = 'variable'").select("path").distinct(), "path", "left_semi"), "facts-near")
    own = symbol_nodes(near, snapshot)
    locals_ = function_locals(own.select(*NODE_COLUMNS), _contains(near, own, snapshot)[0])
    return file_nodes(facts.join(asked, "path", "left_semi"), snapshot).unionByName(symbols), staged(locals_, "locals")


def families(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kinds: list[str], most_edges: int) -> tuple[DataFrame, DataFrame]:
    """(edges with seed and place, seeds that were cut off): the declarations around each seed (column seed).

    The edge that declares what encloses it; its members, if it is a type; what is nested in it, if it is a function, or in
    its members; the types its header refers to, each with its members. Members are functions and types, in source order.
    """
    what = nodes.select("node_id", "declaration_kind", F.col("start_byte").alias("at"), F.col("end_byte").alias("to"))
    to = what.toDF("target_node", "target_kind", "at", "to")
    contains = edges.filter("kind = 'contains' and target_node is not null").join(to, "target_node")
    members = contains.filter("target_kind in ('function', 'type')").select(F.col("source_node").alias("owner"), "edge_id", "target_node", F.struct("at", "to", "edge_id").alias("o"))
    own_kind = seeds.select(F.col("seed")).distinct().join(what.select(F.col("node_id").alias("seed"), F.col("declaration_kind").alias("own")), "seed")
    parent = contains.select(F.col("target_node").alias("seed"), F.col("source_node").alias("encloser"))
    declaring = edges.filter("kind = 'declares'").select(F.col("target_node").alias("encloser"), "edge_id")
    zero = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(-1).cast("long").alias("to"), F.lit("").alias("edge_id"))
    pick = lambda df, branch, one, two: df.select("seed", "edge_id", F.struct(F.lit(branch).alias("branch"), one.alias("one"), two.alias("two")).alias("ord"))
    parts = [pick(own_kind.join(parent, "seed").join(declaring, "encloser"), 1, zero, zero)]
    direct = own_kind.join(members.withColumnRenamed("owner", "seed"), "seed")
    parts.append(pick(direct.filter("own = 'type'"), 2, F.col("o"), zero))
    parts.append(pick(direct.filter("own = 'function'"), 3, F.col("o"), zero))
    inner = members.select(F.col("owner").alias("member"), F.col("edge_id").alias("e2"), F.col("o").alias("o2"))
    below = direct.filter("own = 'type'").join(inner, F.col("target_node") == F.col("member")).select("seed", F.col("e2").alias("edge_id"), "o", "o2")
    parts.append(pick(below, 4, F.col("o"), F.col("o2")))
    if not kinds or "references" in kinds:
        body = contains.groupBy(F.col("source_node").alias("seed")).agg(F.min("at").alias("body"))
        types = own_kind.filter("own = 'type'").join(body, "seed", "left")
        uses = edges.filter("kind = 'references'").select(F.col("source_node").alias("seed"), "edge_id", "target_node", F.struct(F.col("start_byte").alias("at"), F.col("end_byte").alias("to"), "edge_id").alias("o")).join(to.filter("target_kind = 'type'").select("target_node"), "target_node")
        bases = types.join(uses, "seed").filter("body is null or o.at < body")
        parts.append(pick(bases, 5, F.col("o"), zero))
        inherited = bases.select("seed", "target_node", "o").join(members.select(F.col("owner").alias("target_node"), F.col("edge_id").alias("e2"), F.col("o").alias("o2")), "target_node").select("seed", F.col("e2").alias("edge_id"), "o", "o2")
        parts.append(pick(inherited, 5, F.col("o"), F.col("o2")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    once = every.groupBy("seed", "edge_id").agg(F.min("ord").alias("ord")).join(edges.filter(F.col("kind").isin(*kinds)) if kinds else edges, "edge_id")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("ord")).cast("long"))
    return placed.filter(F.col("place") <= most_edges).drop("ord"), placed.filter(F.col("place") > most_edges).select("seed").distinct()


def repository_map(nodes: DataFrame, most: int) -> DataFrame:
    """(entry, path, manifest, files, symbols): directories by path, then packages, up to most entries in all.

    Files and symbols count for every directory above them; counts combine map-side. A row `unknown` tells of what is missing.
    """
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = F.when(F.size(parts) > 1, F.concat(F.array(F.lit(".")), steps)).otherwise(F.array(F.lit(".")))
    counted = nodes.select("kind", F.explode(above).alias("directory"))
    # read by each part of the map: counted once
    folders = staged(counted.groupBy("directory").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols")).filter("files > 0"), "folders")
    manifests = nodes.filter("kind = 'file'").filter(F.element_at(parts, -1).isin(*MANIFESTS)).select("path", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/")).otherwise(".").alias("directory"))
    packages = manifests.join(folders, "directory")
    rows = folders.select(F.lit("directory").alias("entry"), F.col("directory").alias("path"), F.lit(None).cast("string").alias("manifest"), "files", "symbols").unionByName(packages.select(F.lit("package").alias("entry"), F.col("directory").alias("path"), F.col("path").alias("manifest"), "files", F.lit(None).cast("long").alias("symbols")))
    shown = rows.orderBy("entry", F.coalesce("manifest", "path")).limit(most)
    state = rows.agg(F.count("*").alias("n"), F.count_if(F.col("entry") == "directory").alias("d"), F.count_if(F.col("entry") == "package").alias("p"))
    none = lambda t: F.lit(None).cast(t)
    reasons = F.array_compact(F.array(F.when((F.col("p") == 0) | (F.col("d") >= most), "package_manifests_unavailable"), F.when(F.col("n") > most, "repository_map_entry_limit_reached")))
    unknown = state.select(F.explode(reasons).alias("path")).select(F.lit("unknown").alias("entry"), "path", none("string").alias("manifest"), none("long").alias("files"), none("long").alias("symbols"))
    return shown.unionByName(unknown)


def disclosure_items(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a map shows of each edge: relation, resolution, label (at most 128 characters), kinds and paths of its ends."""
    ends = nodes.select("node_id", "path", "name", "declaration_kind")
    source = ends.toDF("source_node", "source_path", "source_name", "source_kind")
    target = ends.toDF("target_node", "path_of_target", "target_name", "target_kind")
    joined = edges.join(source, "source_node", "left").join(target, "target_node", "left")
    label = F.substring(F.coalesce("target_name", "source_name"), 1, 128)
    return joined.select("edge_id", F.col("kind").alias("relation"), "resolution", label.alias("label"), "source_path", F.when(F.col("path_of_target") != F.col("source_path"), F.col("path_of_target")).alias("target_path"), "target_kind", F.col("source_name").alias("within"), "start_byte", "end_byte")


def disclosed(items: DataFrame, order: list[str], kinds: list[str], most: int) -> tuple[DataFrame, bool]:
    """(items, whether more were there): the first of equal-looking items of the wanted relations (`all_admitted`: all)."""
    if not 1 <= most <= 1 << 20:
        raise ValueError("a map shows between one and 1048576 items")
    visible = ["relation", "resolution", "label", "source_path", "target_path", "target_kind", "within"]
    wanted = items if "all_admitted" in kinds else items.filter(F.col("relation").isin(*kinds))
    rest = [c for c in order if c not in visible]
    first = wanted.groupBy(*visible).agg(F.min(F.struct(*order)).alias("o"))
    # read by both results
    shown = staged(first.orderBy("o", *visible).limit(most + 1), "disclosed")
    return shown.orderBy("o", *visible).limit(most).select(*visible, *(F.col(f"o.{c}").alias(c) for c in rest)), shown.count() > most
