"""Queries over logs, graphs, assembly, policy, the audit log and metrics, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import audit, graph, logs
from brindle.session import prepare
from brindle.sources.artifacts import ARTIFACTS_SQL, documents_as_artifacts, table

W = "with " + ARTIFACTS_SQL


def _lines(spark, sf_dir):
    return logs.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def log_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).cast("long").alias("bytes"))


def log_escapes(spark, sf_dir):
    noisy = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\x1b[0m 2024-01-02T03:04:05.6Z "), F.col("user_id").cast("string")).alias("line"))
    return noisy.select("event_id", logs.without_timestamp(logs.without_escapes(F.col("line"))).alias("message"))


def log_first_lines(spark, sf_dir):
    """First occurrence of each line of a document."""
    first = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("idx"))
    return _lines(spark, sf_dir).withColumn("n", first).filter("n = 1").groupBy("doc_id").agg(F.count("*").alias("fresh"))


def log_window(spark, sf_dir):
    """Lines within two of a line that holds `thing`."""
    near = F.max(F.contains("line", F.lit("thing")).cast("int")).over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(-2, 2))
    return _lines(spark, sf_dir).withColumn("near", near).filter("near = 1").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("idx").alias("places"))


def log_greedy(spark, sf_dir):
    picked = logs.greedy(_lines(spark, sf_dir), "doc_id", [F.col("idx")], F.octet_length("line") + 1, "idx", 600)
    return picked.select("doc_id", F.array_join("items", ",").alias("chosen"), "used", "skipped")


def repository_map(spark, sf_dir):
    return graph.directory_rollup(documents_as_artifacts(spark, sf_dir))


def unique_name_resolution(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return graph.unique_names(nodes)


def smallest_enclosing_span(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), (F.col("o_orderkey") % 1000).alias("lo"), (F.col("o_orderkey") % 1000 + F.col("o_orderkey") % 37 + 1).alias("hi"))
    spans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 900).alias("start"), (F.col("c_custkey") % 900 + 1).alias("end"))
    return graph.smallest_enclosing(spans, o.distinct(), 64)


def outermost_spans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), (F.col("o_orderkey") % 100).alias("lo"), (F.col("o_orderkey") % 100 + F.col("o_orderkey") % 37 + 1).alias("hi"))
    return graph.outermost(o.distinct())


def file_first_round_robin(spark, sf_dir):
    return graph.round_robin(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def packet_prefix(spark, sf_dir):
    """The longest prefix by turn of each conversation within 2,000 bytes."""
    run = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").withColumn("used", run.cast("long")).filter("used <= 2000").select("conv_id", "turn", "used")


def repeat_reads(spark, sf_dir):
    """Events whose (user, type) was seen before: the batch twin of the repeat-read notice."""
    seen = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("repeat", seen > 1).groupBy("user_id").agg(F.count_if("repeat").alias("notices"))


def rarity_weights(spark, sf_dir):
    """Integer IDF: bit length of N div document frequency."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))).alias("name")).filter("name <> ''")
    df = words.groupBy("name").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(docs.agg(F.count("*").alias("n"))), how="cross").select("name", "df", F.length(F.bin(F.expr("n div df"))).cast("long").alias("weight"))


def analyzer_coverage(spark, sf_dir):
    """Findings by capability: sorted distinct brands of each part type."""
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("hashes"), F.count("*").alias("findings"))


def audit_retention(spark, sf_dir):
    prepare(spark)
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return audit.retained(e.filter("event_id % 10 <> 0"), e.filter("event_id % 10 = 0"), "2024-01-02 00:00:00", 2000).select("event_id", "event_type")


def dashboard_buckets(spark, sf_dir):
    return audit.buckets(table(spark, sf_dir, "events"))


def duration_percentiles(spark, sf_dir):
    return audit.nearest_rank(table(spark, sf_dir, "events"))


def event_labels(spark, sf_dir):
    return audit.labels(table(spark, sf_dir, "events"), "salt")


def recall_summary(spark, sf_dir):
    """Labelled documents found by a predicate: hits, wanted, and floor percent."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", F.contains("text", F.lit("the")).alias("found")), "doc_id")
    hit, want = F.count_if((F.col("quality") == 1) & F.col("found")), F.count_if(F.col("quality") == 1)
    return joined.groupBy("source").agg(hit.alias("hits"), want.alias("wanted")).withColumn("percent", F.expr("if(wanted = 0, 0L, (100 * hits) div wanted)"))


QUERIES = {f.__name__: f for f in (log_lines, log_escapes, log_first_lines, log_window, log_greedy, repository_map, unique_name_resolution, smallest_enclosing_span, outermost_spans, file_first_round_robin, packet_prefix, repeat_reads, rarity_weights, analyzer_coverage, audit_retention, dashboard_buckets, duration_percentiles, event_labels, recall_summary)}
LINES = "with l as (select doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as raw, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) - 1 as idx from documents where text <> ''), n as (select doc_id, idx, regexp_replace(raw, '\\r$', '') as line from l)"
SPANS = "select distinct o_custkey as path, o_orderkey % {m} as lo, o_orderkey % {m} + o_orderkey % 37 + 1 as hi from orders"
ORACLES = {
    "log_lines": LINES + " select doc_id, count(*) as lines, sum(octet_length(encode(line)))::bigint as bytes from n group by doc_id",
    "log_escapes": "select event_id, user_id::varchar as message from events",
    "log_first_lines": LINES + " select doc_id, count(distinct line) as fresh from n group by doc_id",
    "log_window": LINES + ", w as (select *, max(contains(line, 'thing')::int) over (partition by doc_id order by idx rows between 2 preceding and 2 following) as near from n) select doc_id, count(*) as n, sum(idx)::bigint as places from w where near = 1 group by doc_id",
    "log_greedy": LINES + """, q as (select doc_id, list_reduce(list(struct_pack(used := octet_length(encode(line)) + 1, items := [idx]) order by idx), lambda a, x: case when a.used + x.used <= 600 then struct_pack(used := a.used + x.used, items := list_concat(a.items, x.items)) else a end, struct_pack(used := 0::bigint, items := []::bigint[])) as s from n group by doc_id)
select doc_id, coalesce(array_to_string(s.items, ','), '') as chosen, s.used::bigint as used, (select count(*) from n where n.doc_id = q.doc_id) > len(s.items) as skipped from q""",
    "repository_map": W + ", p as (select string_split(path, '/') as s from art), d as (select unnest(list_concat(['.'], list_transform(range(1, len(s)), lambda k: array_to_string(s[1:k], '/')))) as directory from p) select directory, count(*) as files from d group by 1",
    "unique_name_resolution": "select p_name || ' ' || p_brand as name, case when count(*) = 1 then min(p_partkey) end as target, case when count(*) = 1 then 'resolved' else 'ambiguous' end as resolution from part group by 1",
    "smallest_enclosing_span": "with o as (" + SPANS.format(m=1000) + """), s as (select c_custkey as path, c_custkey % 900 as start, c_custkey % 900 + 1 as "end" from customer)
select path, start, "end", lo, hi from s join o using (path) where lo <= start and "end" <= hi and hi - lo <= 64 qualify row_number() over (partition by path, start, "end" order by hi - lo, lo) = 1""",
    "outermost_spans": "with o as (" + SPANS.format(m=100) + "), r as (select *, max(hi) over (partition by path order by lo, hi desc rows between unbounded preceding and 1 preceding) as reach from o) select path, lo, hi from r where reach is null or hi > reach",
    "file_first_round_robin": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as turn from orders",
    "packet_prefix": "with r as (select conv_id, turn, sum(octet_length(encode(text)) + 1) over (partition by conv_id order by turn, role rows unbounded preceding)::bigint as used from conversations) select * from r where used <= 2000",
    "repeat_reads": "select user_id, count(*) - count(distinct event_type) as notices from events group by user_id",
    "rarity_weights": "with w as (select distinct doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) as name from documents), d as (select name, count(*) as df from w where name <> '' group by name) select name, df, length(bin((select count(*) from documents) // df))::bigint as weight from d",
    "analyzer_coverage": "select p_type, string_agg(distinct p_brand, ',' order by p_brand) as hashes, count(*) as findings from part group by p_type",
    "audit_retention": "select event_id, event_type from events where event_id % 10 = 0 or ts >= timestamp '2024-01-02 00:00:00' order by ts desc, event_id desc limit 2000",
    "dashboard_buckets": "select event_type, count(*) as events, sum(floor(value))::bigint as duration_ms from events group by event_type",
    "duration_percentiles": "with r as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events) select event_type, max(case when r = (n - 1) // 2 + 1 then value end) as p50, max(case when r = ceil(n * 95 / 100) then value end) as p95, max(value) as max from r group by event_type",
    "event_labels": "select event_id, substr(sha256('salt' || user_id), 1, 16) as workspace, event_type from events",
    "recall_summary": "select source, count_if(quality = 1 and contains(text, 'the')) as hits, count_if(quality = 1) as wanted, case when count_if(quality = 1) = 0 then 0 else (100 * count_if(quality = 1 and contains(text, 'the'))) // count_if(quality = 1) end as percent from labels join documents using (doc_id) group by source",
}
