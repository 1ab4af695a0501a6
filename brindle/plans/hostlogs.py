"""Queries of log reduction, with oracles that know each line's class from the shape it was made by."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from brindle.operators import logs
from brindle.sources.artifacts import table

BUDGET, CONTEXT = 2000, 2
FIELDS = {"{u}": "cast(user_id as string)", "{e}": "cast(event_id as string)", "{v}": "cast(cast(floor(value) as bigint) as string)"}
NO_ZERO = "case when floor(value) = 0 then 'quiet' else 'failure' end"

#: Shapes of log lines: text with fields of an event, what it reports, whether it is a verdict, and its clean text if that differs.
SHAPES = [
    ("step compile_{v} ... ok", "quiet", False),
    ("step retry_on_errors_{v} ... ok", "quiet", False),
    ("step link_{v} ... FAILED", "failure", False),
    ("loader: fatal clash in module {v}", "failure", False),
    ("   at queue/worker_{v}.go:{v}", "location", False),
    ("lane stack exception at pool/lane.go:{v}", "failure", False),
    ("  right: {v}", "failure", False),
    ("~~~ {v} failed, 4 passed, 1 left ~~~", NO_ZERO, True),
    ("Tests: 21 passed, 0 failed, 21 in all", "quiet", True),
    ("lint of the tree: 0 problems, 0 warnings", "quiet", True),
    ("rustc -Dwarnings -Cpanic=abort src/part{v}.rs", "quiet", False),
    ("ResourceWarning: handle {v} left open", "warning", False),
    ("warning: shadowed name `slot_{v}`", "warning", False),
    ("bound to port 9000 of lane {v}", "quiet", False),
    ("woke at 06:15:{v}", "quiet", False),
    ("layout{v}.css(8,2): hint L12", "location", False),
    ('  File "/opt/app/jobs/sync.py", line {v}, in pull', "location", False),
    ("Ran all {v} test cases in 3.1s", "quiet", True),
    ("PASS", "quiet", True),
    ("ok \tcorp.test/billing\t1.9s", "quiet", True),
    ("FAIL\tcorp.test/billing\t2.4s", "failure", True),
    ("ok {v} - recovers from a failed write", "quiet", False),
    ("not ok {v} - keeps the order", "failure", False),
    ("    ✗ sorts by name ({v} ms)", "failure", False),
    ("● {v} problems: 5 errors, 7 warnings", "failure", True),
    ("2025-01-05T04:03:02.{v}Z lane q aborted at b.zig:4:1", "failure", False),
    ("2025-01-05T04:03:09.5Z closing idle lane ({e})", "quiet", False),
    ("copied block {v} of the set", "quiet", False),
    ("without failures over {v} rounds", "quiet", False),
    ("fatal: the ledger is not there", "failure", False),
    ("schema.sql:{v}: error: unknown column", NO_ZERO.replace("quiet", "location"), False),
    ("\x1b[1;35mpanic\x1b[0m: \x1b]2;pane\x07 lane {v}", "failure", False, "panic:  lane {v}"),
    ("\x1b]2;pane left open exception: halt {v}", "failure", False, "]2;pane left open exception: halt {v}"),
    ("store.client.LeaseError: lease {v} is over", "failure", False),
    ("read notes/failures.md for {v} hints", "quiet", False),
    ("E   value {v} is not 9", "failure", False),
    ("sum: 0 failures 0", "quiet", True),
    ("ℹ fail {v}", NO_ZERO, True),
]


def sql_text(template: str) -> str:
    """SQL of a shape's text that both dialects read alike."""
    parts = [p for p in re.split(r"(\{[uev]\}|['\\\x00-\x1f])", template) if p]
    return "concat('', " + ", ".join(FIELDS.get(p) or (f"chr({ord(p)})" if len(p) == 1 and (p in "'\\" or p < " ") else f"'{p}'") for p in parts) + ")"


def chosen(values: list[str]) -> str:
    """SQL that takes one of the values by the event's shape."""
    return f"case (event_id * 31 + user_id) % {len(SHAPES)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


LINE = chosen([sql_text(s[0]) for s in SHAPES])
CLEAN = chosen([sql_text(s[3] if len(s) > 3 else s[0]) for s in SHAPES])
SIGNAL = chosen([s[1] if s[1].startswith("case") else f"'{s[1]}'" for s in SHAPES])
VERDICT = chosen([str(s[2]).lower() for s in SHAPES])


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"{LINE} as line")


def _logs(spark, sf_dir):
    """One log per user: the lines of the user's events."""
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "line")))
    return _lines(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def log_clean_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("event_id", logs.without_escapes(F.col("line")).alias("clean"))


def log_line_classes(spark, sf_dir):
    clean = _lines(spark, sf_dir).withColumn("line", logs.without_escapes(F.col("line")))
    return clean.select("event_id", logs.line_signal(F.col("line")).alias("signal"), logs.line_verdict(F.col("line")).alias("verdict"))


def log_keywords(spark, sf_dir):
    """Lines with a failure or a warning word that counts, whatever else they report."""
    line = F.col("line")
    words = _lines(spark, sf_dir).select("event_id", logs.has_word(line, logs.FAILURE_WORDS, logs.FAILURE_ENDINGS).alias("failing"), logs.has_word(line, logs.WARNING_WORDS, logs.WARNING_ENDINGS).alias("warning"))
    return words.groupBy("failing", "warning").agg(F.count("*").alias("n"))


def log_counted_results(spark, sf_dir):
    return _lines(spark, sf_dir).filter(logs.counted_result(F.col("line"))).select("event_id")


def log_locations(spark, sf_dir):
    return _lines(spark, sf_dir).filter(logs.source_location(F.col("line"))).select("event_id")


def log_offer_order(spark, sf_dir):
    """Stage and place at which each line of a log is offered."""
    placed = logs.ordered(logs.classified(_logs(spark, sf_dir), "user_id", "text"), "user_id", CONTEXT)
    return placed.select("user_id", F.col("idx").cast("long").alias("idx"), F.col("place.stage").cast("long").alias("stage"), F.col("place.ord").alias("ord"))


def log_reduction(spark, sf_dir):
    out = logs.reduce_logs(_logs(spark, sf_dir), "user_id", "text", BUDGET, CONTEXT)
    return out.drop("error")


QUERIES = {f.__name__: f for f in (log_clean_lines, log_line_classes, log_keywords, log_counted_results, log_locations, log_offer_order, log_reduction)}

BASE = f"with l as (select event_id, user_id, value, (event_id * 31 + user_id) % {len(SHAPES)} as shape, {LINE} as line, {CLEAN} as clean, {SIGNAL} as signal, {VERDICT} as verdict from events)"
#: By shape: whether a failure word counts, a warning word, a counted result, a place in a file, in the line as it is.
FAILING = [2, 3, 5, 20, 21, 24, 25, 29, 32, 33]
FAILING_UNLESS_ZERO = [7, 30, 37]
WARNING = [11, 12, 24]
COUNTED = [7, 8, 9, 24, 36]
LOCATED = [4, 5, 15, 16, 25, 30]
ORDER = BASE + f""", o as (select *, row_number() over (partition by user_id order by event_id) - 1 as idx, count(*) over (partition by user_id) as n from l),
m as (select *, max(case when verdict then idx end) over w as last_verdict, min(case when signal = 'failure' then idx end) over w as first_failure,
 signal in ('failure', 'location') and row_number() over (partition by user_id, clean, signal in ('failure', 'location') order by idx) = 1 as fresh from o window w as (partition by user_id)),
c as (select *, bool_or(fresh) over near as beside, bool_or(signal = 'warning' or verdict) over near as lesser from m window near as (partition by user_id order by idx rows between {CONTEXT} preceding and {CONTEXT} following)),
p as (select user_id, event_id, idx, line, clean, n, case when idx = last_verdict then 1 when verdict and signal = 'failure' then 2 when idx = first_failure then 3 when idx >= n - 3 then 4
 when abs(idx - first_failure) <= {CONTEXT} then 5 when fresh then 6 when beside then 7 when lesser then 8 when idx < 3 then 9 end as stage from c),
q as (select *, case when stage in (2, 6, 7, 8) then -idx when stage is not null then idx end as ord from p)"""
ORACLES = {
    "log_clean_lines": BASE + " select event_id, clean from l",
    "log_line_classes": BASE + " select event_id, signal, verdict from l",
    "log_keywords": BASE + f", k as (select list_contains({FAILING}, shape) or (list_contains({FAILING_UNLESS_ZERO}, shape) and floor(value) > 0) as failing, list_contains({WARNING}, shape) as warning from l) select failing, warning, count(*) as n from k group by all",
    "log_counted_results": BASE + f" select event_id from l where list_contains({COUNTED}, shape)",
    "log_locations": BASE + f" select event_id from l where list_contains({LOCATED}, shape)",
    "log_offer_order": ORDER + " select user_id, idx::bigint as idx, stage::bigint as stage, ord::bigint as ord from q",
    "log_reduction": ORDER
    + f""", g as (select user_id, list_reduce(list(struct_pack(budget := octet_length(encode(clean))::bigint + 1, missed := false, items := [struct_pack(i := idx, t := clean, r := octet_length(encode(line)) - octet_length(encode(clean)))]) order by stage, ord) filter (stage is not null),
 lambda a, x: case when x.budget <= a.budget then struct_pack(budget := a.budget - x.budget, missed := a.missed, items := list_concat(a.items, x.items)) else struct_pack(budget := a.budget, missed := true, items := a.items) end,
 struct_pack(budget := {BUDGET}::bigint, missed := false, items := []::struct(i bigint, t varchar, r bigint)[])) as s, any_value(n) as n, sum(octet_length(encode(line)) + 1)::bigint - 1 as offered_bytes from q group by user_id),
r as (select user_id, array_to_string(list_transform(list_sort(s.items), lambda x: x.t), chr(10)) as reduced, offered_bytes, n, len(s.items) as k, list_sum(list_transform(s.items, lambda x: x.r)) as e, s.missed as missed from g)
select user_id, reduced, offered_bytes, octet_length(encode(reduced))::bigint as returned_bytes, n::bigint as offered_lines, k::bigint as returned_lines, e::bigint as escape_bytes_removed,
 array_to_string(list_filter([case when k < n then 'output_lines_omitted' end, case when missed then 'output_returned_byte_limit_reached' end], lambda x: x is not null), ',') as omissions from r""",
}
