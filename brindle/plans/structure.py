"""Queries over the structure of code, with their oracles; the tables stand in for files, facts and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import structure as st
from brindle.sources.artifacts import table

OPENINGS = ("pub fn ", "export async function ", "class ", "  private static final type ", "return ", "final ", "defmodule\t", "classy ")
SYNTAX = ("function_item", "method", "struct_item", "pair", "bind", "comment", "trait_item", "type_spec")


def _opened():
    return F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("p_partkey") % len(OPENINGS) + 1).cast("int"))


def declared_names(spark, sf_dir):
    line = F.concat(_opened(), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(self):"))
    return table(spark, sf_dir, "part").select("p_partkey", st.declared_name(line).alias("name"))


def declaration_kinds(spark, sf_dir):
    syntax = F.element_at(F.array(*map(F.lit, SYNTAX)), (F.col("p_partkey") % len(SYNTAX) + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(st.declaration_kind(syntax).alias("kind")).agg(F.count("*").alias("n"))


def _facts(spark, sf_dir):
    facts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").alias("node"))
    return facts, facts.filter("node % 5 < 2")


def call_edges(spark, sf_dir):
    return st.resolve(*_facts(spark, sf_dir), "first")


def reference_edges(spark, sf_dir):
    return st.resolve(*_facts(spark, sf_dir), "only")


def export_edges(spark, sf_dir):
    return st.exports(*_facts(spark, sf_dir)).select("file", "name", "node", "target")


def declarers(spark, sf_dir):
    return st.declarers(_facts(spark, sf_dir)[1])


def evidence_scores(spark, sf_dir):
    uses, declared = _facts(spark, sf_dir)
    wanted = uses.filter("node % 7 = 0").select("name").distinct()
    pairs = [x.select("file", "name").distinct() for x in (uses, declared)]
    return st.evidence_scores(*pairs, wanted, uses.select("file").distinct().count())


def seed_admission(spark, sf_dir):
    """Orders of a customer as candidates for nodes of their priority: neighbours of one node count once."""
    seeds = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", (F.col("o_orderkey") % 4).alias("rank"), "o_orderkey", "o_orderpriority")
    return st.admit_seeds(seeds, "o_custkey", "o_orderstatus", ["rank", "o_orderstatus", "o_orderkey"], "o_orderpriority").drop("o_orderpriority")


def traversal_merge(spark, sf_dir):
    return st.first_of_each(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


def collapse_repeats(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_orderkey", "l_linenumber")
    return st.first_of_each(items, ["l_returnflag", "l_linestatus", "l_suppkey"], ["l_orderkey", "l_linenumber"])


def supporting_last(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return st.supporting_last(items, "o_custkey", F.col("o_orderstatus") == "F", "o_orderkey")


def packet_status(spark, sf_dir):
    ok = lambda m: F.col("o_orderkey") % m != 0
    return table(spark, sf_dir, "orders").groupBy(st.packet_status(ok(13), ok(11), ok(7), ok(5), ok(3)).alias("status")).agg(F.count("*").alias("n"))


def workspace_decision(spark, sf_dir):
    workspace = F.when(F.col("user_id") % 5 != 0, F.col("user_id"))
    return table(spark, sf_dir, "events").groupBy("event_type", st.workspace_decision(F.col("event_id") % 3 != 0, workspace).alias("effect")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (declared_names, declaration_kinds, call_edges, reference_edges, export_edges, declarers, evidence_scores, seed_admission, traversal_merge, collapse_repeats, supporting_last, packet_status, workspace_decision)}

FACTS = "with u as (select p_brand as file, p_name as name, p_partkey as node from part), d as (select * from u where node % 5 < 2)"
EDGE = FACTS + " select file, name, node, case when {own} then o when n = 1 then a end as target, case when {own} then 'local' when n = 1 then 'scope' when n > 1 then 'ambiguous' else 'unresolved' end as resolution from (select u.*, (select count(*) from d where d.file = u.file and d.name = u.name) as k, (select min(node) from d where d.file = u.file and d.name = u.name) as o, (select count(*) from d where d.name = u.name) as n, (select min(node) from d where d.name = u.name) as a from u)"
OPENED = f"(select p_partkey, string_split(trim(replace([{', '.join(repr(o) for o in OPENINGS)}][p_partkey % {len(OPENINGS)} + 1], '\\t', ' ') || replace(p_name, ' ', '_')), ' ') as w from part)".replace("'defmodule\\t'", "'defmodule '")
ORACLES = {
    "declared_names": f"with o as {OPENED}, c as (select p_partkey, list_filter(w, lambda x: x not in ({', '.join(map(repr, st.MODIFIERS))})) as w from o) select p_partkey, case when w[1] in ({', '.join(map(repr, st.KEYWORDS))}) then w[2] end as name from c",
    "declaration_kinds": f"select case p_partkey % {len(SYNTAX)} when 0 then 'function' when 1 then 'function' when 2 then 'type' when 3 then 'variable' when 4 then 'variable' when 5 then 'other' else 'type' end as kind, count(*) as n from part group by 1",
    "call_edges": EDGE.format(own="k > 0"),
    "reference_edges": EDGE.format(own="k = 1"),
    "export_edges": FACTS + " select u.*, (select min(node) from d where d.file = u.file and d.name = u.name) as target from u",
    "declarers": FACTS + " select name, count(distinct file) as files from d group by name having count(distinct file) <= 8",
    "evidence_scores": FACTS + """, t as (select distinct name from u where node % 7 = 0), b as (select distinct file, name, 1 as times from u union all select distinct file, name, 3 from d), k as (select * from b where name in (from t)),
f as (select name, length(bin(greatest((select count(distinct file) from u) // greatest(count_if(times = 1), count_if(times = 3)), 1)))::bigint as w from k group by name)
select file, sum(w * times)::bigint as score, count(distinct name) as matched from k join f using (name) group by file""",
    "seed_admission": """with c as (select o_custkey, o_orderstatus, o_orderkey % 4 as rank, o_orderkey, lag(o_orderpriority) over (partition by o_custkey order by o_orderkey % 4, o_orderstatus, o_orderkey) as last, o_orderpriority as node from orders),
f as (select * from c where last is null or last <> node qualify row_number() over (partition by o_custkey, o_orderstatus order by rank, o_orderkey) <= 3)
select o_custkey, o_orderstatus, rank, o_orderkey, row_number() over (partition by o_custkey order by rank, o_orderstatus, o_orderkey) as place from f qualify place <= 8""",
    "traversal_merge": "select user_id, event_type, min(event_id) as event_id from events group by all",
    "collapse_repeats": "select l_returnflag, l_linestatus, l_suppkey, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_returnflag, l_linestatus, l_suppkey order by l_orderkey, l_linenumber) = 1",
    "supporting_last": "select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by (o_orderstatus = 'F')::int, o_orderkey) as place from orders",
    "packet_status": "select case when o_orderkey % 13 = 0 then 'incompatible' when o_orderkey % 11 = 0 then 'corrupt' when o_orderkey % 7 = 0 then 'denied' when o_orderkey % 5 = 0 then 'partial' when o_orderkey % 3 = 0 then 'stale' else 'current' end as status, count(*) as n from orders group by 1",
    "workspace_decision": "select event_type, case when event_id % 3 <> 0 and user_id % 5 = 0 then 'deny' else 'allow' end as effect, count(*) as n from events group by all",
}
