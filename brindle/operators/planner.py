"""Plans for tasks: a profile's first steps, the steps that a task's signals add, their order by rarity, identity and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import digest
from brindle.operators import signals as S

# First and second step of each profile, and what a profile leaves out from the start.
PROFILES = {
    "orientation": ("filename", "lexical", None),
    "implementation": ("lexical", "literal", None),
    "bug_investigation": ("literal", "lexical", None),
    "change_review": ("filename", "lexical", ("change_set", "change_set_evidence_unavailable")),
    "security_review": ("literal", "lexical", ("structural_relationship", "structural_relationship_evidence_not_connected")),
    "test_selection": ("filename", "lexical", ("associated_test", "associated_test_evidence_unavailable")),
    "configuration_change": ("filename", "literal", ("configuration_to_code_reference", "configuration_to_code_reference_unavailable")),
}
COVERAGE = [
    ("exact_path", "available", "exact_path_available"),
    ("filename", "available", "filename_available"),
    ("literal", "available", "literal_available"),
    ("lexical", "available", "lexical_available"),
    ("structural_relationship", "unavailable", "structural_relationship_evidence_not_connected"),
    ("change_set", "unavailable", "change_set_evidence_unavailable"),
    ("associated_test", "unavailable", "associated_test_evidence_unavailable"),
    ("configuration_to_code_reference", "unavailable", "configuration_to_code_reference_unavailable"),
    ("convention_exemplar", "unavailable", "convention_exemplar_evidence_unavailable"),
    ("repository_orientation", "unavailable", "repository_orientation_map_not_connected"),
]
#: Bounds: signals that are rated, steps of a plan, bytes of a step's query, terms of a lexical query.
QUOTES_RATED, WORDS_RATED, STEPS, QUERY_BYTES, QUERY_TERMS = 16, 32, 8, 256, 16


def has_word(needle: Column) -> Column:
    return needle.rlike("[A-Za-z0-9]{3}")


def compatible(kind: Column, query: Column, most_literal: int) -> Column:
    """Whether a whole query can be a step of a kind."""
    size, terms = F.octet_length(query), F.size(S.words(query))
    return (size <= QUERY_BYTES) & ((kind != "literal") | (size <= most_literal)) & ((kind != "lexical") | terms.between(1, QUERY_TERMS))


def base_steps(tasks: DataFrame, key: str, text: str, profile: str) -> DataFrame:
    """(key, kind, query, reason, turn) of the two steps of each task's profile."""
    rows = [(name, turn, kind, f"profile_{name}_{kind}") for name, (one, two, _) in PROFILES.items() for turn, kind in enumerate((one, two))]
    table = tasks.sparkSession.createDataFrame(rows, f"{profile} string, turn int, kind string, reason string")
    return tasks.select(key, profile, S.bounded_query(F.col(text)).alias("query")).join(F.broadcast(table), profile).select(key, "kind", "query", "reason", "turn")


def omissions(tasks: DataFrame, key: str, profile: str) -> DataFrame:
    rows = [(name, *left) for name, (_, _, left) in PROFILES.items() if left]
    return tasks.select(key, profile).join(F.broadcast(tasks.sparkSession.createDataFrame(rows, f"{profile} string, candidate string, reason string")), profile).select(key, "candidate", "reason", F.lit(1).cast("long").alias("count"))


def needles(tasks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, ord, kind, query, reason) of what a task's signals ask for: quotes, paths, identifiers, words."""
    query = S.bounded_query(F.col(text))
    bounded = tasks.select(key, query.alias("q"))

    def listed(values: Column, source: int, kind: str, reason: str) -> DataFrame:
        return bounded.select(key, F.posexplode(values).alias("ord", "query")).select(key, F.lit(source).alias("source"), F.col("ord").cast("long").alias("ord"), F.lit(kind).alias("kind"), "query", F.lit(reason).alias("reason"))

    found = S.task_signals(bounded, key, "q")
    of = lambda kind, source, step, reason: found.filter(F.col("kind") == kind).select(key, F.lit(source).alias("source"), F.col("ord"), F.lit(step).alias("kind"), F.col("signal").alias("query"), F.lit(reason).alias("reason"))
    return (
        listed(F.slice(S.quotes(F.col("q")), 1, QUOTES_RATED), 0, "literal", "task_signal_quoted_literal")
        .unionByName(of("path", 1, "filename", "task_signal_portable_path"))
        .unionByName(of("identifier", 2, "literal", "task_signal_code_identifier"))
        .unionByName(listed(F.slice(S.lexical_terms(F.col("q")), 1, WORDS_RATED), 3, "lexical", "task_signal_lexical_fallback"))
    )


def needle_terms(needle: Column) -> Column:
    """The sorted distinct words of a needle, sixteen at most: files with all words have any sixteen of them."""
    return F.slice(F.array_sort(F.array_distinct(S.words(needle))), 1, QUERY_TERMS)


def rarity(wanted: DataFrame, postings: DataFrame, nominated: DataFrame, key: str) -> DataFrame:
    """(key, query, files, reaches) of needles (key, query): files that hold all its words, and whether one is nominated.

    postings: (path, term), distinct. A needle with no word has no row.
    """
    terms = wanted.select(key, "query").distinct().withColumn("terms", needle_terms(F.col("query"))).filter(F.size("terms") > 0)
    each = terms.select("query", "terms").distinct().select("query", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    held = postings.join(F.broadcast(each), "term").groupBy("query", "path").agg(F.count("*").alias("have"), F.first("n").alias("n")).filter("have = n").select("query", "path")
    files = held.groupBy("query").agg(F.count("*").alias("files"))
    reached = terms.select(key, "query").join(held, "query").join(nominated.select(key, "path").distinct(), [key, "path"], "left_semi").select(key, "query").distinct().withColumn("reaches", F.lit(True))
    return terms.select(key, "query").join(files, "query", "left").join(reached, [key, "query"], "left").select(key, "query", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("reaches", F.lit(False)).alias("reaches"))


def expand(tasks: DataFrame, key: str, text: str, profile: str, most_literal: int, rated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(steps, omissions): up to STEPS steps (key, step, kind, query, reason) a task, and what was left out and why.

    The profile's first step comes first if its query fits; then needles that reach a nominated file, rarest first; then the
    other needles in the task's order; the profile's second step only where nothing else was found.
    """
    base = base_steps(tasks, key, text, profile).withColumn("fits", compatible(F.col("kind"), F.col("query"), most_literal))
    every = needles(tasks, key, text).withColumn("wordless", (F.col("kind") == "literal") & ~has_word(F.col("query")))
    useful = every.filter("not wordless")
    if rated is None:
        useful = useful.withColumns({"files": F.lit(None).cast("long"), "reaches": F.lit(False)})
    else:
        useful = useful.join(rated, [key, "query"], "left")
    reaches = F.coalesce(F.col("reaches"), F.lit(False)) & (F.col("kind") != "filename")
    size = F.octet_length("query")
    fits = size.between(1, QUERY_BYTES) & ((F.col("kind") != "literal") | (size <= most_literal))
    place = F.struct(F.when(reaches, 1).otherwise(2).alias("part"), F.when(reaches, F.col("files")).otherwise(0).cast("long").alias("files"), F.col("source").cast("long").alias("source"), "ord")
    zero = F.lit(0).cast("long")
    at = lambda part: F.struct(F.lit(part).alias("part"), zero.alias("files"), zero.alias("source"), zero.alias("ord"))
    first = base.filter("turn = 0 and fits").select(key, "kind", "query", "reason", at(0).alias("at"))
    rows = first.unionByName(useful.filter(fits).select(key, "kind", "query", "reason", place.alias("at")))
    once = rows.groupBy(key, "kind", "query").agg(F.min_by("reason", "at").alias("reason"), F.min("at").alias("at"))
    have = base.filter("turn = 0").select(key, "fits").join(once.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    alone = have.filter((F.coalesce("n", F.lit(0)) == 0) | (F.col("fits") & (F.col("n") == 1))).select(key)
    second = base.filter("turn = 1 and fits").join(alone, key, "left_semi").select(key, "kind", "query", "reason", at(3).alias("at")).join(once.select(key, "kind", "query"), [key, "kind", "query"], "left_anti")
    steps = once.unionByName(second.select(key, "kind", "query", "reason", "at")).withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy("at")).cast("long")).filter(F.col("step") <= STEPS)
    whole = base.filter("turn = 0 and not fits").select(key, F.lit("original_query").alias("candidate"), F.lit("original_query_exceeds_retrieval_contract").alias("reason"), F.lit(1).cast("long").alias("count"))
    wordless = every.filter("wordless").groupBy(key).agg(F.count("*").alias("count")).select(key, F.lit("task_signal_literal").alias("candidate"), F.lit("literal_without_word").alias("reason"), "count")
    return steps.select(key, "step", "kind", "query", "reason"), omissions(tasks, key, profile).unionByName(whole).unionByName(wordless)


def coverage(spark) -> DataFrame:
    return spark.createDataFrame(COVERAGE, "evidence_class string, status string, reason string")


def annotated(covered: DataFrame, left_out: DataFrame, evidence_class: str, status: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(coverage, omissions) after evidence of a class arrived (available) or was refused (unavailable, with its reason)."""
    changed = covered.withColumns({"reason": F.when(F.col("evidence_class") == evidence_class, reason).otherwise(F.col("reason")), "status": F.when(F.col("evidence_class") == evidence_class, status).otherwise(F.col("status"))})
    rest = left_out.filter(F.col("candidate") != evidence_class)
    if status == "unavailable":
        keys = [c for c in left_out.columns if c not in ("candidate", "reason", "count")]
        told = left_out.select(*keys).distinct() if keys else left_out.sparkSession.range(1).select()
        rest = rest.unionByName(told.select(*keys, F.lit(evidence_class).alias("candidate"), F.lit(reason).alias("reason"), F.lit(1).cast("long").alias("count")))
    return changed, rest


def plan_ids(steps: DataFrame, left_out: DataFrame, tasks: DataFrame, key: str, profile: str, snapshot: str) -> DataFrame:
    """(key, plan_id): the digest of profile, snapshot, steps in order and omissions by name."""
    line = F.to_json(F.struct("kind", "query", "reason"))
    ordered = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("s")).select(key, F.array_join(F.transform("s", lambda x: x["line"]), ",").alias("steps"))
    missing = left_out.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("candidate", "count", "reason")))), ",").alias("left_out"))
    whole = tasks.select(key, profile).join(ordered, key, "left").join(missing, key, "left")
    return whole.select(key, digest("plan", F.col(profile), F.lit(snapshot), F.coalesce("steps", F.lit("")), F.coalesce("left_out", F.lit(""))).alias("plan_id"))
