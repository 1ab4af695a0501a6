"""Queries of the audit log and of evaluation, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.text import base64url
from brindle.operators import audit
from brindle.operators import evaluation as V
from brindle.session import prepare
from brindle.sources.artifacts import documents_as_artifacts, table
from brindle.sources.store import fresh_path
from brindle.streaming import retention

#: Events with one field broken by their type and number.
EVENT = {
    "event_id": "case when event_id % 11 = 1 then 'evt_short' when event_id % 11 = 2 then concat('Evt_', lpad(cast(event_id as string), 12, '0')) else concat('evt_', lpad(cast(event_id as string), 12, '0')) end",
    "occurred_at": "case when event_id % 11 = 3 then '2026-02-30T00:00:00Z' else '2026-02-28T00:00:00.5Z' end",
    "workspace": "case when event_id % 11 = 4 then 'sha256:xyz' when event_id % 11 = 5 then null else concat('sha256:', sha2(cast(user_id as string), 256)) end",
    "duration": "case when event_id % 11 = 6 then '01' else cast(cast(floor(value) as bigint) as string) end",
    "engine": "case when event_id % 11 = 7 then '1.0' else '1.0.0' end",
    "request_id": "case when event_id % 11 = 8 then 'req_has space' else concat('req_', lpad(cast(event_id as string), 10, '0')) end",
}


def audit_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id as number", *(f"{v} as {k}" for k, v in EVENT.items())).withColumns({"decision": F.concat(F.lit("sha256:"), F.sha2(F.lit("d"), 256)), "snapshot": F.lit(None).cast("string")})
    return rows.select("number", F.coalesce(audit.event_problem(), F.lit("valid")).alias("problem"))


def audit_append(spark, sf_dir):
    """A tenth of the events appended to the others: cutoff, number, then bytes in blocks of a hundred."""
    prepare(spark)
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props")
    out = audit.append(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), "2024-01-02 00:00:00", 5000, 40_000, F.octet_length("props") + 10)
    return out.select("event_id", "event_type")


RETENTION = ("20 days", 60, 1100)


def _audited(spark, sf_dir):
    prepare(spark)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("w"), (F.col("user_id") % 12).cast("string")).alias("workspace"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.octet_length("props") + F.col("event_id") % 7).cast("long").alias("size"))


def audit_stream(spark, sf_dir):
    """What a stream of events keeps of each workspace in the end; files come in no order of time, so many events are late."""
    source, folder = fresh_path(spark, "audit-events"), fresh_path(spark, "audit-stream")
    _audited(spark, sf_dir).repartition(4, "event_id").write.parquet(source)
    events = spark.readStream.schema(retention.COLUMNS).option("maxFilesPerTrigger", 2).parquet(source)
    retention.start(events, folder, *RETENTION, partitions=4).awaitTermination()
    return retention.current(spark, folder).select("workspace", "event_id")


def audit_each(spark, sf_dir):
    return retention.retained_each(_audited(spark, sf_dir), *RETENTION).select("workspace", "event_id")


def audit_recent(spark, sf_dir):
    """The newest 500 events, with those marked whose payload cannot be read."""
    prepare(spark)
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("user_id") < 30, F.concat("props", F.lit("}"))).when(F.col("user_id") < 60, F.lit("none")).otherwise(F.col("props")).alias("payload"))
    return audit.recent(e, 500, F.col("payload"), "k int").select("event_id", "unavailable")


def audit_purge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("workspace"))
    return audit.purged(rows, "7").groupBy("workspace").agg(F.count("*").alias("events"))


def dashboard_aggregates(spark, sf_dir):
    """Events and time by capability and outcome."""
    rows = table(spark, sf_dir, "events").withColumn("outcome", F.when(F.col("value") > 50, "failure").otherwise("success"))
    return audit.buckets(rows, ("event_type", "outcome"))


def bounded_snapshot(spark, sf_dir):
    """The newest events that fit a snapshot of 30,000 bytes."""
    prepare(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return audit.bounded_snapshot(rows, [F.desc("event_id")], 10_000, 30_000).select("event_id", "left_out")


NL = "chr(10)"
FILE = "concat('src/', p_type, '/f', cast(p_size as string), '.py')"
PATCH = f"concat('diff --git a/x b/x', {NL}, '--- a/', {FILE}, {NL}, '+++ b/', {FILE}, chr(9), 'now', {NL}, '@@ -1,3 +1,4 @@ def f_', cast(p_size as string), '(x)', {NL}, ' ', p_name, {NL}, '-old ', p_brand, {NL}, '+new ', p_brand, {NL}, ' ', {NL}, '+more', {NL}, '@@ -9 +9 @@', {NL}, '+first', {NL}, case when p_size > 25 then concat('--- a/gone', {NL}, '+++ /dev/null', {NL}, '@@ -1 +0,0 @@ class Gone', {NL}, '-all', {NL}) else concat('--- a/b', {NL}, '+++ b/lib/', p_type, '.rs', {NL}, '@@ -4,2 +4,2 @@ impl Widget for X', {NL}, '-  ', {NL}, '-  removed  ', {NL}) end)"


def _patches(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PATCH} as patch")


def patch_files(spark, sf_dir):
    files, symbols, _ = V.reference(_patches(spark, sf_dir), "p_partkey", "patch")
    return files.select("p_partkey", F.lit("file").alias("kind"), F.col("file").alias("name")).unionByName(symbols.select("p_partkey", F.lit("symbol").alias("kind"), F.col("symbol").alias("name")))


def patch_changed_lines(spark, sf_dir):
    return V.reference(_patches(spark, sf_dir), "p_partkey", "patch")[2]


def _delivered(spark, sf_dir):
    """What was delivered for each part: a map of one item, evidence of one file, at three levels of nesting."""
    part = table(spark, sf_dir, "part")
    excerpt = base64url(F.concat(F.lit("x "), "p_name", F.lit(" old "), "p_brand", F.lit(" y")).cast("binary"))
    file = F.expr(FILE)
    item = F.concat(F.lit('{"display_path":"'), F.when(F.col("p_size") % 3 == 0, file).otherwise("other.py"), F.lit('","target_display_path":"'), F.when(F.col("p_size") % 3 == 1, file).otherwise("none.py"), F.lit('","symbol_label":"f_'), F.col("p_size").cast("string"), F.lit('"}'))
    shown = F.concat(F.lit('{"artifact":{"path":{"display_path":"'), F.when(F.col("p_size") % 2 == 0, file).otherwise("other.py"), F.lit('"}},"excerpt":{"bytes_base64url":"'), excerpt, F.lit('"}}'))
    body = F.concat(F.lit('{"disclosure_map":{"items":['), item, F.lit(']},"initial_packet":{"observed_evidence":['), shown, F.lit("]}}"))
    wrapped = F.when(F.col("p_size") < 10, F.concat(F.lit('{"result":{"structuredContent":'), body, F.lit("}}"))).when(F.col("p_size") < 20, F.concat(F.lit('{"structuredContent":'), body, F.lit("}"))).otherwise(body)
    return part.select("p_partkey", wrapped.alias("delivered"))


def recall_scores(spark, sf_dir):
    return V.score(_patches(spark, sf_dir), _delivered(spark, sf_dir), "p_partkey", "patch", "delivered").drop("delivered_bytes")


def recall_report(spark, sf_dir):
    prepare(spark)
    return V.summary(V.score(_patches(spark, sf_dir), _delivered(spark, sf_dir), "p_partkey", "patch", "delivered")).drop("delivered_bytes")


def _corpus(spark, sf_dir, wanted, found, native, shown):
    """Rates of benchmark items over the documents: what is wanted, found and found plainly are the files that hold those parts of an item."""
    prepare(spark)
    art = documents_as_artifacts(spark, sf_dir).select("path", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    parts = {part: F.expr(part) for part in (wanted, found, native)}
    asked = items.select("item_id", F.explode(F.array(*(F.struct(F.lit(part).alias("part"), c.alias("needle")) for part, c in parts.items())))).select("item_id", "col.*")
    # an item and which part of it: one search for all
    held = V.holding(art, asked.select(F.struct("item_id", "part").alias("which"), "needle"), "which")
    paths = lambda part: held.filter(F.col("which.part") == part).select("which.item_id", "path")
    sizes = paths(found).groupBy("item_id").agg(F.count("*").alias("n"))
    total = art.agg(F.sum(F.octet_length("text")).alias("bytes"))
    fixtures = items.join(sizes, "item_id", "left").crossJoin(F.broadcast(total)).select("item_id", "bytes", (F.coalesce("n", F.lit(0)) * F.octet_length(F.expr(shown))).alias("excerpt_bytes"))
    out = V.corpus_rates(fixtures, paths(wanted), paths(found), paths(native), "item_id")
    return out.select("fixtures", *(F.round(c, 6).alias(c) for c in ("recall", "native_recall", "precision", "reduction")), "failures")


OPENING = "substring(text, 1, 40)"
#: Two parts of an item, neither of which holds the other.
FIRST, THIRD = "substring(text, 1, 8)", "substring(text, 3, 8)"


def corpus_evaluation(spark, sf_dir):
    """Benchmark items as fixtures: each wants the documents that hold its first 40 characters; the search is literal over whole items."""
    return _corpus(spark, sf_dir, OPENING, "text", OPENING, "text")


def corpus_openings(spark, sf_dir):
    """Each item wants the documents that hold its characters 3 to 10; the search is for its first 8, the plain one for all of it."""
    return _corpus(spark, sf_dir, THIRD, FIRST, "text", FIRST)


QUERIES = {f.__name__: f for f in (audit_stream, audit_each, audit_validation, audit_append, audit_recent, audit_purge, dashboard_aggregates, bounded_snapshot, patch_files, patch_changed_lines, recall_scores, recall_report, corpus_evaluation, corpus_openings)}

PATCHES = f"with p as (select *, {FILE} as file, p_size % 3 as m, p_size % 2 as e from part)"
SCORES = PATCHES + """, s as (select p_partkey, case when p_size > 25 then 1 else 2 end as files, case when m in (0, 1) then 1 else 0 end as map_files, case when m = 1 then 1 else 0 end as via_target, case when e = 0 then 1 else 0 end as evidence_files,
 2 as symbols, 1 as map_symbols, case when p_size > 25 then 2 else 3 end as changed_lines, case when e = 0 then 2 else 0 end as changed_in_evidence from p)"""
ORACLES = {
    "audit_validation": "select event_id as number, case event_id % 11 when 1 then 'event_id' when 2 then 'event_id' when 3 then 'occurred_at' when 4 then 'workspace' when 6 then 'duration' when 7 then 'engine' when 8 then 'request_id' else 'valid' end as problem from events",
    "audit_append": """with k as (select event_id, ts, event_type, length(props) + 10 as n from events where event_type = 'error' or ts >= timestamp '2024-01-02' order by ts desc, event_id desc limit 5000),
o as (select *, (row_number() over (order by ts, event_id) - 1) // 100 as b from k), s as (select b, sum(sum(n)) over (order by b desc) as used from o group by b) select event_id, event_type from o where b in (select b from s where used <= 40000)""",
    "audit_recent": "select event_id, user_id < 60 as unavailable from (select * from events order by ts desc, event_id desc limit 500)",
    "audit_purge": "select case when event_type <> 'view' then user_id::varchar end as workspace, count(*) as events from events where not (event_type <> 'view' and user_id = 7) group by 1",
    "dashboard_aggregates": "select event_type, case when value > 50 then 'failure' else 'success' end as outcome, count(*) as events, sum(floor(value))::bigint as duration_ms from events group by all",
    "bounded_snapshot": """with r as (select event_id, 256 + sum(length('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}') + 1) over (order by event_id desc) as used from (select * from events order by event_id desc limit 10000)) select event_id, (select count(*) from r where used > 30000) as left_out from r where used <= 30000""",
    "patch_files": PATCHES + " select p_partkey, 'file' as kind, file as name from p union all select p_partkey, 'file', 'lib/' || p_type || '.rs' from p where p_size <= 25 union all select p_partkey, 'symbol', 'f_' || p_size from p union all select p_partkey, 'symbol', case when p_size > 25 then 'Gone' else 'Widget' end from p",
    "patch_changed_lines": PATCHES + " select p_partkey, file, 'old ' || p_brand as line from p union all select p_partkey, file, p_name from p union all select p_partkey, 'lib/' || p_type || '.rs', 'removed' from p where p_size <= 25",
    "recall_scores": SCORES + " select * from s",
    "recall_report": SCORES + " select count(*) as cases, sum(files)::bigint as files, sum(symbols)::bigint as symbols, sum(changed_lines)::bigint as changed_lines, (100 * sum(map_files) // sum(files))::bigint as map_file_percent, (100 * sum(map_symbols) // sum(symbols))::bigint as map_symbol_percent, (100 * sum(evidence_files) // sum(files))::bigint as evidence_file_percent, (100 * sum(changed_in_evidence) // sum(changed_lines))::bigint as changed_line_percent from s",
    "corpus_evaluation": """with p as (select item_id, b.text as item, d.doc_id, contains(d.text, b.text) as whole from benchmark b join documents d on contains(d.text, substr(b.text, 1, 40))),
k as (select count(*) as want, count(case when whole then 1 end) as hit, coalesce(sum(case when whole then octet_length(encode(item)) end), 0) as shown from p), z as (select (select sum(octet_length(encode(text))) from documents) * (select count(*) from benchmark) as bytes, (select count(*) from benchmark) as n),
r as (select n as fixtures, case when want = 0 then 0 else hit / want end as recall, case when want = 0 then 0 else 1.0 end as native_recall, case when hit = 0 then 0 else 1.0 end as precision, 1 - shown / bytes as reduction from k, z)
select fixtures, round(recall, 6) as recall, round(native_recall, 6) as native_recall, round(precision, 6) as precision, round(reduction, 6) as reduction, concat_ws(',', case when recall < 0.9 then 'recall' end, case when precision < 0.7 then 'precision' end, case when recall + 0.02 < native_recall then 'native' end, case when reduction < 0.3 then 'reduction' end) as failures from r""",
}
ORACLES["corpus_openings"] = """with p as (select item_id, doc_id, substr(b.text, 1, 8) as opening, contains(d.text, substr(b.text, 3, 8)) as w, contains(d.text, substr(b.text, 1, 8)) as f, contains(d.text, b.text) as n from benchmark b join documents d on contains(d.text, substr(b.text, 1, 8)) or contains(d.text, substr(b.text, 3, 8))),
k as (select count(case when w then 1 end) as want, count(case when f then 1 end) as got, count(case when w and f then 1 end) as hit, count(case when w and n then 1 end) as plain, coalesce(sum(case when f then octet_length(encode(opening)) end), 0) as shown from p), z as (select (select sum(octet_length(encode(text))) from documents) * (select count(*) from benchmark) as bytes, (select count(*) from benchmark) as n),
r as (select z.n as fixtures, case when want = 0 then 0 else hit / want end as recall, case when want = 0 then 0 else plain / want end as native_recall, case when got = 0 then 0 else hit / got end as precision, 1 - shown / bytes as reduction from k, z)
select fixtures, round(recall, 6) as recall, round(native_recall, 6) as native_recall, round(precision, 6) as precision, round(reduction, 6) as reduction, concat_ws(',', case when recall < 0.9 then 'recall' end, case when precision < 0.7 then 'precision' end, case when recall + 0.02 < native_recall then 'native' end, case when reduction < 0.3 then 'reduction' end) as failures from r"""
KEPT_EACH = """with e as (select 'w' || (user_id % 12) as workspace, event_id, ts, length(props) + event_id % 7 as size from events),
r as (select *, row_number() over w as n, sum(size) over (w rows unbounded preceding) as used, max(ts) over (partition by workspace) as newest from e window w as (partition by workspace order by ts desc, event_id desc))
select workspace, event_id from r where n <= 60 and used <= 1100 and ts >= newest - interval 20 days"""
ORACLES["audit_stream"] = ORACLES["audit_each"] = KEPT_EACH
