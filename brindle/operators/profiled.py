"""Contexts by profile: a plan, the evidence around it that is declared or structural, and what is covered and left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import digest
from brindle.operators import codegraph as G
from brindle.operators import context as C
from brindle.operators import evidence as E
from brindle.operators import planner as P
from brindle.sources.store import staged

#: What a declared input is called in coverage, and why it is available.
DECLARED = {"change_set": "declared_change_set_current_snapshot_verified", "associated_test": "declared_associated_tests_current_snapshot_verified", "convention_exemplar": "declared_convention_exemplars_current_snapshot_verified"}
NO_SEED = "structural_seed_unavailable"
MAP_AVAILABLE = "repository_orientation_map_available"


@dataclass
class Profiled:
    """plan_ids (key, plan_id), steps, coverage (key, evidence_class, status, reason), omissions (key, candidate, reason, count) and the context."""

    plan_ids: DataFrame
    steps: DataFrame
    coverage: DataFrame
    omissions: DataFrame
    context: C.Context


def declared_paths(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, evidence_class, path) of verified declarations: class to its (key, path, status); only what is `verified` counts."""
    out = None
    for name, df in parts.items():
        part = df.filter("status = 'verified'").select(key, F.lit(name).alias("evidence_class"), "path")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def profiled(tasks: DataFrame, key: str, text: str, profile: str, files: DataFrame, nominated: DataFrame, declarations: DataFrame, snapshot: str, budget: E.Budget, created: str, most_literal: int, rated: DataFrame | None = None, seeded: tuple[DataFrame, DataFrame, DataFrame] | None = None, seed_reasons: DataFrame | None = None, declared: DataFrame | None = None, orientation: DataFrame | None = None) -> Profiled:
    """Each task's plan by its profile and the context it leads to.

    rated: rarity of needles. seeded: the graph's nodes, and edges and unknowns of `codegraph.seeded`, with seed_reasons (key, reason) of each
    task's first seed: the spans of its edges follow the retrieved evidence. declared (key, evidence_class, path): verified
    inputs, which lead it, each file once, by path. orientation: the rows of a repository map, the same for all tasks.
    """
    tasks = staged(tasks, "profiled-tasks")
    steps, left_out = P.expand(tasks, key, text, profile, most_literal, rated)
    steps, left_out = staged(steps, "profiled-steps"), staged(left_out, "left-out")
    told = tasks.select(key, F.lit(None).cast("string").alias("evidence_class"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("reason")).limit(0)
    leading = trailing = noted = None
    if seeded is not None:
        nodes, edges, unknowns = seeded
        first = tasks.select(key).join(seed_reasons.groupBy(key).agg(F.first("reason").alias("seed")), key, "left")
        told = told.unionByName(first.select(key, F.lit("structural_relationship").alias("evidence_class"), F.when(F.col("seed").isNull(), "unavailable").otherwise("available").alias("status"), F.coalesce("seed", F.lit(NO_SEED)).alias("reason")))
        spans = edges.join(nodes.select(F.col("node_id").alias("source_node"), "path"), "source_node").filter("start_byte < end_byte")
        end = F.least("end_byte", F.col("start_byte") + budget.excerpt_bytes)
        trailing = spans.select(key, F.col("place").alias("ord"), "path", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("start_byte").alias("excerpt_start"), end.alias("excerpt_end"), F.lit("structural_relationship").alias("method"))
        noted = unknowns.select(key, "unknown")
    if declared is not None:
        reasons = F.create_map(*(F.lit(x) for pair in DECLARED.items() for x in pair))
        told = told.unionByName(declared.select(key, "evidence_class").distinct().select(key, "evidence_class", F.lit("available").alias("status"), reasons[F.col("evidence_class")].alias("reason")))
        named = declared.select(key, "path").distinct().join(files.select("path", F.octet_length("text").cast("long").alias("size")), "path")
        place = F.row_number().over(Window.partitionBy(key).orderBy("path")).cast("long")
        zero = F.lit(0).cast("long")
        leading = named.select(key, place.alias("ord"), "path", zero.alias("start"), F.least("size", F.lit(budget.excerpt_bytes).cast("long")).alias("end"), zero.alias("excerpt_start"), F.least("size", F.lit(budget.excerpt_bytes).cast("long")).alias("excerpt_end"), F.lit("exact_read").alias("method"))
    if orientation is not None:
        told = told.unionByName(tasks.select(key, F.lit("repository_orientation").alias("evidence_class"), F.lit("available").alias("status"), F.lit(MAP_AVAILABLE).alias("reason")))
    told = staged(told, "told")
    base = tasks.select(key).crossJoin(F.broadcast(P.coverage(tasks.sparkSession).toDF("evidence_class", "status_0", "reason_0")))
    coverage = base.join(told, [key, "evidence_class"], "left").select(key, "evidence_class", F.coalesce("status", "status_0").alias("status"), F.coalesce("reason", "reason_0").alias("reason"))
    rest = left_out.join(told.select(key, F.col("evidence_class").alias("candidate")), [key, "candidate"], "left_anti")
    missing = told.filter("status = 'unavailable'").select(key, F.col("evidence_class").alias("candidate"), "reason", F.lit(1).cast("long").alias("count"))
    omissions = rest.unionByName(missing)
    ids = P.plan_ids(steps, omissions, tasks, key, profile, snapshot)
    context = C.planned(tasks, key, text, profile, steps, nominated, files, declarations, snapshot, budget, created, leading, trailing, noted)
    packets = staged(context.packets, "packets")
    context = C.Context(context.evidence, packets, context.unknowns)
    over = packets.filter("omitted > 0").select(key, F.lit("retrieved_evidence").alias("candidate"), F.lit("evidence_budget").alias("reason"), F.col("omitted").cast("long").alias("count"))
    return Profiled(ids, steps, coverage, omissions.unionByName(over), context)


def map_identity(entries: DataFrame, snapshot: str) -> DataFrame:
    """One row (map_id): the digest of a repository map, which has a bounded number of entries."""
    lines = entries.select(F.to_json(F.struct(*entries.columns)).alias("x"))
    return lines.agg(digest("repository-orientation", F.lit(snapshot), F.array_join(F.array_sort(F.collect_list("x")), "\n")).alias("map_id"))


# single requests on a graph


def audited(nodes: DataFrame, edges: DataFrame, requests: DataFrame, snapshot: str, kinds: list[str], depth: int, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """(edges (request_id, place, ...), events (request_id, outcome, reason, edges)) of structure queries (request_id, snapshot, start).

    A request of another snapshot, or from what is no node, fails and is traversed no further; the others run together. An
    answer that a limit cut is `limited`.
    """
    known = requests.join(nodes.select(F.col("node_id").alias("start"), F.lit(True).alias("here")), "start", "left")
    reason = F.when(F.col("snapshot") != snapshot, "stale_state").when(F.col("here").isNull(), "invalid_input")
    judged = staged(known.select("request_id", "start", reason.alias("reason")), "requests")
    starts = judged.filter("reason is null").select("request_id", F.col("start").alias("node_id"))
    _, found, unknowns = G.traverse_all(nodes, edges, starts, ["request_id"], kinds, depth, most_nodes, most_edges)
    found = staged(found, "answers")
    cut = unknowns.filter(F.col("unknown").endswith("limit_reached")).groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list("unknown")), ",").alias("cut"))
    counts = found.groupBy("request_id").agg(F.count("*").alias("edges"))
    events = judged.join(cut, "request_id", "left").join(counts, "request_id", "left")
    outcome = F.when(F.col("reason").isNotNull(), "failed").when(F.col("cut").isNotNull(), "limited").otherwise("allowed")
    return found, events.select("request_id", outcome.alias("outcome"), F.coalesce("reason", "cut").alias("reason"), F.coalesce("edges", F.lit(0)).alias("edges"))


def edge_evidence(requests: DataFrame, edges: DataFrame, nodes: DataFrame, artifacts: DataFrame, before: int, after: int, most: int, snapshot: str) -> DataFrame:
    """(request_id, edge_id, evidence_id, path, start, end, from, to, excerpt) of edges that are asked for by id (request_id, edge_id).

    A span that is asked for as it is and fits `most` is given as it is; else it is expanded, after its bytes were proved again.
    An id that is no edge raises.
    """
    ends = nodes.select(F.col("node_id").alias("source_node"), "path")
    asked = requests.join(edges.select("edge_id", "source_node", F.col("start_byte").alias("start"), F.col("end_byte").alias("end")), "edge_id", "left")
    there = asked.withColumn("edge_id", F.when(F.col("source_node").isNull(), F.raise_error(F.concat(F.lit("structural evidence handle is unavailable: "), F.col("edge_id"))).cast("string")).otherwise(F.col("edge_id")))
    spans = staged(there.join(ends, "source_node").select("request_id", "edge_id", "path", "start", "end"), "asked-spans")
    proved = E.structural_evidence(edges.join(spans.select("edge_id").distinct(), "edge_id", "left_semi"), nodes, artifacts, snapshot)
    hashed = proved.join(artifacts.select("path", F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash")), "path")
    size = F.col("end") - F.col("start")
    as_is = (size <= most) & F.lit(before == 0 and after == 0)
    plain = proved.filter(as_is).select("path", "start", "end", "evidence_id", F.col("start").alias("from"), F.col("end").alias("to"), "excerpt")
    wide = E.expanded(hashed.filter(~as_is), artifacts, before, after, most, snapshot).select("path", "start", "end", "evidence_id", "from", "to", "excerpt")
    return spans.join(plain.unionByName(wide), ["path", "start", "end"]).select("request_id", "edge_id", "evidence_id", "path", "start", "end", "from", "to", "excerpt")


# disclosure

RELATIONS = (*G.EDGE_KINDS, "all_admitted")


def lookups(items: DataFrame, asked: DataFrame, most_items: int) -> tuple[DataFrame, DataFrame]:
    """(answers (lookup, place, item_handle), results (lookup, state, returned, result_id)) of lookups in sessions' maps.

    items (map_id, item_handle, ord, relation). asked (lookup, map_id, handle, kinds, max_items): by the map or by one item, and by
    kind of relation (`all_admitted`: any); the first max_items in order. state: `invalid` for kinds or numbers out of range or
    beyond the session's most_items, `failed` for a handle that the map does not have, `ready` if the whole map is given,
    else `partial`.
    """
    kinds = F.col("kinds")
    bad = kinds.isNull() | ~F.size(kinds).between(1, len(RELATIONS)) | F.exists(kinds, lambda k: ~k.isin(*RELATIONS)) | ~F.col("max_items").between(1, most_items)
    judged = asked.withColumn("bad", F.coalesce(bad, F.lit(True)))
    sizes = items.groupBy("map_id").agg(F.count("*").alias("all_items"))
    joined = judged.filter("not bad").select("lookup", "map_id", "handle", "kinds", "max_items").join(items, "map_id")
    named = joined.filter((F.col("handle") == F.col("map_id")) | (F.col("handle") == F.col("item_handle")))
    wanted = F.array_contains("kinds", "all_admitted") | F.array_contains("kinds", F.col("relation"))
    chosen = named.filter(wanted).withColumn("place", F.row_number().over(Window.partitionBy("lookup").orderBy("ord", "item_handle")).cast("long")).filter(F.col("place") <= F.col("max_items"))
    answers = staged(chosen.select("lookup", "place", "item_handle"), "lookup-answers")
    known = named.select("lookup").distinct().withColumn("known", F.lit(True))
    given = answers.groupBy("lookup").agg(F.count("*").alias("returned"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_handle"))), lambda x: x["item_handle"]), ",").alias("shown"))
    rows = judged.join(sizes, "map_id", "left").join(known, "lookup", "left").join(given, "lookup", "left")
    returned = F.coalesce("returned", F.lit(0))
    on_map = F.col("handle") == F.col("map_id")
    state = F.when(F.col("bad"), "invalid").when(~on_map & F.col("known").isNull(), "failed").when(returned == F.coalesce("all_items", F.lit(0)), "ready").otherwise("partial")
    result_id = digest("disclosure-lookup", F.col("map_id"), F.col("handle"), F.array_join("kinds", ","), F.col("max_items").cast("string"), F.coalesce("shown", F.lit("")))
    return answers, rows.select("lookup", state.alias("state"), returned.alias("returned"), F.when(state.isin("ready", "partial"), result_id).alias("result_id"))


def scope_disclosure(tasks: DataFrame, key: str, nominated: DataFrame, unknowns: DataFrame, considered: DataFrame) -> DataFrame:
    """(key, scoped, nominated_files, considered_files, files, unknowns): what each task's structure was limited to.

    nominated (key, place, path, reason); unknowns (key, unknown); considered: the files looked at. A task without a nominated
    file has the whole workspace.
    """
    # at most some files a task beside those that it names
    some = nominated.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "path", "reason"))).alias("f"))
    why = unknowns.groupBy(key).agg(F.array_sort(F.collect_set("unknown")).alias("u"))
    total = considered.agg(F.count("*").alias("all"))
    rows = tasks.select(key).join(some, key, "left").join(why, key, "left").crossJoin(F.broadcast(total))
    scoped = F.col("n").isNotNull()
    none = F.array(F.lit("structural_scope_whole_repository"))
    return rows.select(key, scoped.alias("scoped"), F.coalesce("n", F.lit(0)).alias("nominated_files"), F.when(scoped, F.col("all")).otherwise(0).alias("considered_files"), F.coalesce(F.transform("f", lambda x: F.struct(x["path"].alias("path"), x["reason"].alias("reason"))), F.array().cast("array<struct<path:string,reason:string>>")).alias("files"), F.when(scoped, F.coalesce("u", F.array().cast("array<string>"))).otherwise(none).alias("unknowns"))
