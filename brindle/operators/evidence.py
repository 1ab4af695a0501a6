"""From matches to evidence: bounded searches over candidates, spans and their proofs, ranking, cutting, declared inputs."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import ascii_lower, base64url, byte_slice, content_hash, digest, excerpt_bounds
from brindle.operators import search as S
from brindle.operators.intervals import enclosing
from brindle.operators.running import running
from brindle.operators.signals import words
from brindle.sources.artifacts import path_units

# Least, usual and largest value of each limit of a request.
RANGES = {
    "output_bytes": (1024, 65_536, 4_194_304),
    "evidence_items": (1, 100, 10_000),
    "files": (1, 10_000, 1_000_000),
    "excerpt_bytes": (1, 4096, 65_536),
    "matches": (1, 1000, 10_000),
    "depth": (1, 32, 256),
    "elapsed_ms": (1, 30_000, 300_000),
    "memory_bytes": (1_048_576, 536_870_912, 2_147_483_648),
}
# Directories whose files support others, and words that make a task one about tests.
SUPPORTING = "__tests__ cextern extern node_modules spec test testing tests third_party vendor vendored".split()
TEST_WORDS = "test tests testing pytest unittest".split()
SEARCHES = ("literal_search", "lexical_search")


@dataclass(frozen=True)
class Budget:
    """The limits of a request; values outside their ranges are refused."""

    output_bytes: int = RANGES["output_bytes"][1]
    evidence_items: int = RANGES["evidence_items"][1]
    files: int = RANGES["files"][1]
    excerpt_bytes: int = RANGES["excerpt_bytes"][1]
    matches: int = RANGES["matches"][1]
    depth: int = RANGES["depth"][1]
    elapsed_ms: int = RANGES["elapsed_ms"][1]
    memory_bytes: int = RANGES["memory_bytes"][1]

    def __post_init__(self):
        for f in fields(self):
            low, _, high = RANGES[f.name]
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{f.name} is between {low} and {high}")

    def narrowed(self, other: Budget) -> Budget:
        """The smaller of both in every limit."""
        return Budget(*(min(getattr(self, f.name), getattr(other, f.name)) for f in fields(self)))


def every_match(artifacts: DataFrame, candidates: DataFrame, needles: list[str], fold: bool, method: str) -> DataFrame:
    """The occurrences of all needles in all candidates (path), with excerpts of the usual size; nothing is sorted."""
    usual = RANGES["excerpt_bytes"][1]
    if not needles or any(not 1 <= len(n.encode()) <= usual for n in needles):
        raise ValueError("needles are not empty and no longer than an excerpt")
    files = artifacts.join(candidates.select("path"), "path", "left_semi").select("path", "text")
    every = None
    for needle in needles:
        found = S.literal(files, needle, fold)
        every = found if every is None else every.unionByName(found)
    left, right = excerpt_bounds(F.col("size"), F.col("start"), F.col("end"), usual)
    rows = every.withColumns({"excerpt_start": left, "excerpt_end": right}).join(artifacts.select("path", "text", content_hash(F.col("text")).alias("content_hash")), "path")
    return rows.select("path", path_units(F.col("path")).alias("path_units"), "start", "end", "size", "excerpt_start", "excerpt_end", byte_slice(F.col("text"), F.col("excerpt_start"), F.col("excerpt_end")).alias("excerpt"), F.lit(method).alias("method"), "content_hash")


def candidate_matches(artifacts: DataFrame, candidates: DataFrame, needles: list[str], fold: bool, method: str, budget: Budget | None) -> tuple[DataFrame, DataFrame]:
    """(matches, reasons): occurrences in candidates (path, rank), taken in the order of rank, needle and place up to a limit.

    Files and excerpts count towards memory. Each partition gives up no more matches than the limit and one; only these
    meet. Matches are then ordered by path and place. Without a budget all matches are given, in no order.
    """
    if budget is None:
        return every_match(artifacts, candidates, needles, fold, method), artifacts.select(F.lit("").alias("reason")).limit(0)
    if not needles or any(not 1 <= len(n.encode()) <= budget.excerpt_bytes for n in needles):
        raise ValueError("needles are not empty and no longer than an excerpt")
    counted = candidates.agg(F.count("*").alias("candidates"))
    first = candidates.orderBy("rank").limit(budget.files)
    files = artifacts.join(F.broadcast(first), "path")
    parts = []
    for i, needle in enumerate(needles):
        found = S.literal(files.select("path", "text"), needle, fold, most=budget.matches + 1).join(F.broadcast(first), "path")
        parts.append(found.select("rank", F.lit(i).alias("needle"), "path", "start", "end", "size"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    left, right = excerpt_bounds(F.col("size"), F.col("start"), F.col("end"), budget.excerpt_bytes)
    top = every.orderBy("rank", "needle", "start").limit(budget.matches + 1).withColumns({"excerpt_start": left, "excerpt_end": right})
    order = Window.orderBy("rank", "needle", "start")
    # memory before a match: all files up to its own, and the excerpts before
    sizes = files.select("rank", F.octet_length("text").cast("long").alias("file_bytes")).withColumn("files_to", F.sum("file_bytes").over(Window.orderBy("rank"))).select("rank", "files_to")
    run = top.withColumns({"n": F.row_number().over(order), "excerpts": F.sum(F.col("excerpt_end") - F.col("excerpt_start")).over(order)}).join(F.broadcast(sizes), "rank")
    heavy = (F.col("files_to") + F.col("excerpts")) > budget.memory_bytes
    stop = run.agg(F.min(F.when(heavy, F.col("n"))).alias("stop"))
    kept = run.crossJoin(F.broadcast(stop)).filter((F.col("n") <= budget.matches) & (F.col("stop").isNull() | (F.col("n") < F.col("stop"))))
    # texts come back only for what is shown
    shown = artifacts.join(F.broadcast(kept.select("path").distinct()), "path", "left_semi").select("path", "text", content_hash(F.col("text")).alias("content_hash"))
    rows = shown.join(F.broadcast(kept), "path").select("path", path_units(F.col("path")).alias("path_units"), "start", "end", "size", "excerpt_start", "excerpt_end", byte_slice(F.col("text"), F.col("excerpt_start"), F.col("excerpt_end")).alias("excerpt"), F.lit(method).alias("method"), "content_hash")
    state = run.agg(F.count_if(F.col("n") > budget.matches).alias("more"), F.count_if(heavy & (F.col("n") <= budget.matches)).alias("heavy")).crossJoin(counted)
    why = F.array_compact(F.array(F.when(F.col("candidates") > budget.files, "file_limit"), F.when((F.col("more") > 0) & (F.col("heavy") == 0), "match_limit"), F.when(F.col("heavy") > 0, "memory_limit")))
    return rows.orderBy("path_units", "start"), state.select(F.explode(why).alias("reason"))


def scoped_lexical(artifacts: DataFrame, query: list[str], scope: DataFrame) -> DataFrame:
    """Occurrences of any query term, without an index: a file of the scope (path) that lacks some still counts for the others."""
    named = artifacts.join(F.broadcast(scope.select("path").distinct()), "path", "left_semi")
    out = None
    for term in query:
        found = S.literal(named, term, fold=True).select("path", F.lit(term).alias("term"), "start", "end", "size")
        out = found if out is None else out.unionByName(found)
    return out


def search(artifacts: DataFrame, kind: str, query: str, budget: Budget | None, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, reasons) of one search: exact_path, filename, literal or lexical, over all files or those of within (path).

    Without a budget a search gives all it finds, in no order; a lexical one over all files needs a budget, as it takes the best.
    """
    scope = None if within is None else within.select("path").distinct()
    files = artifacts if within is None else artifacts.join(scope if budget is None else F.broadcast(scope), "path", "left_semi")
    rank = lambda df: df.select("path", path_units(F.col("path")).alias("rank"))
    if kind in ("exact_path", "filename"):
        hits = files.filter(F.col("path") == query) if kind == "exact_path" else files.filter(F.contains(ascii_lower(F.col("path")), ascii_lower(F.lit(query))))
        zero = F.lit(0).cast("long")
        rows = hits.select("path", path_units(F.col("path")).alias("path_units"), zero.alias("start"), zero.alias("end"), F.octet_length("text").cast("long").alias("size"), zero.alias("excerpt_start"), zero.alias("excerpt_end"), F.lit(b"").alias("excerpt"), F.lit("exact_read" if kind == "exact_path" else "filename_search").alias("method"), content_hash(F.col("text")).alias("content_hash"))
        if budget is None:
            return rows, rows.select(F.lit("").alias("reason")).limit(0)
        n = hits.agg(F.when(F.count("*") > budget.matches, "match_limit").alias("reason")).filter("reason is not null")
        return rows.orderBy("path_units").limit(budget.matches), n
    if kind == "literal":
        return candidate_matches(files, rank(files.filter(F.contains("text", F.lit(query)))), [query], False, "literal_search", budget)
    if kind != "lexical":
        raise ValueError(f"unknown kind of search {kind}")
    wanted = query.lower().split()
    if not 1 <= len(wanted) <= 16:
        raise ValueError("a lexical search takes one to sixteen terms")
    if within is None and budget is None:
        raise ValueError("the best files of a lexical search are those of a budget")
    if within is None:
        best = S.bm25(files, wanted, budget.files)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("score", "path_units"))).select("path", "rank")
    else:
        some = F.exists(F.array(*map(F.lit, wanted)), lambda t: F.contains(ascii_lower(F.col("text")), t))
        ranked = rank(files.filter(some))
    return candidate_matches(files, ranked, wanted, True, "lexical_search", budget)


def records(matches: DataFrame, snapshot: str) -> DataFrame:
    """Matches as evidence records: identity, nested place and excerpt; numbers as text, bytes as base64url."""
    text = lambda c: c.cast("string")
    start, end = F.col("start"), F.col("end")
    identity = digest("evidence", F.col("content_hash"), text(end), F.col("path"), F.lit(snapshot), text(start))
    return matches.select(
        identity.alias("evidence_id"),
        F.lit(snapshot).alias("workspace_snapshot"),
        F.struct(F.col("path").alias("display_path"), F.col("path_units").alias("relative_units_base64url"), "content_hash", F.when(F.is_valid_utf8(F.col("excerpt").cast("string")), "utf8").otherwise("unsupported").alias("decoding")).alias("artifact"),
        F.struct(text(start).alias("start_byte"), text(end).alias("end_byte")).alias("span"),
        F.struct(base64url(F.col("excerpt")).alias("bytes_base64url"), F.lit("base64url").alias("encoding"), text(start - F.col("excerpt_start")).alias("match_start_byte"), text(end - F.col("excerpt_start")).alias("match_end_byte")).alias("excerpt"),
        F.struct(F.col("method"), F.lit("1.0.0").alias("version")).alias("extraction"),
        F.lit("exact_source").alias("kind"),
        F.lit("confirmed").alias("confidence"),
        F.lit("untrusted_workspace_content").alias("trust"),
    )


def decimal_ok(c: Column) -> Column:
    return c.rlike(r"^(0|[1-9][0-9]*)$")


def record_problem(snapshot: str) -> Column:
    """What is wrong with an evidence record, or null."""
    e, s = F.col("excerpt"), F.col("span")
    numbers = [s["start_byte"], s["end_byte"], e["match_start_byte"], e["match_end_byte"]]
    good = decimal_ok(numbers[0]) & decimal_ok(numbers[1]) & decimal_ok(numbers[2]) & decimal_ok(numbers[3])
    a, b, c, d = (n.try_cast("long") for n in numbers)
    units = e["bytes_base64url"]
    data = F.try_to_binary(F.rpad(F.translate(units, "-_", "+/"), (F.ceil(F.length(units) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    return (
        F.when(~F.col("evidence_id").rlike(r"^sha256:[0-9a-f]{64}$") | ~F.col("artifact")["content_hash"].rlike(r"^sha256:[0-9a-f]{64}$"), "identity")
        .when(F.col("workspace_snapshot") != snapshot, "snapshot")
        .when(e["encoding"] != "base64url", "encoding")
        .when(~good, "decimal")
        .when((a > b) | (c > d) | (b - a != d - c), "span")
        .when(data.isNull() | (base64url(data) != units) | (d > F.octet_length(data)), "excerpt")
    )


def recovered(spans: DataFrame, artifacts: DataFrame, snapshot: str) -> DataFrame:
    """spans (path, start, end, content_hash) with their bytes and identity; a file that is not what it was raises.

    An empty span, or one outside its file, is no evidence.
    """
    now = artifacts.select("path", F.col("text").alias("_text"))
    joined = spans.filter("start < end").join(now, "path", "left")
    same = F.coalesce(content_hash(F.col("_text")) == F.col("content_hash"), F.lit(False))
    stale = F.raise_error(F.concat(F.lit("stale evidence: "), F.col("path")))
    data = F.when(same, byte_slice(F.col("_text"), F.col("start"), F.col("end"))).otherwise(stale.cast("binary"))
    inside = joined.filter(~same | (F.col("end") <= F.octet_length("_text")))
    return inside.withColumns({"excerpt": data, "evidence_id": digest("evidence", F.col("content_hash"), F.col("end").cast("string"), F.col("path"), F.lit(snapshot), F.col("start").cast("string"))}).drop("_text")


def expanded(evidence: DataFrame, artifacts: DataFrame, before: int, after: int, most: int, snapshot: str) -> DataFrame:
    """evidence (path, start, end, content_hash, excerpt, evidence_id) with from, to and the wider excerpt.

    The excerpt and the identity are proved again before anything is shown.
    """
    again = recovered(evidence.select("path", "start", "end", "content_hash", F.col("excerpt").alias("was"), F.col("evidence_id").alias("id_was")), artifacts, snapshot)
    proved = (F.col("excerpt") == F.col("was")) & (F.col("evidence_id") == F.col("id_was"))
    checked = again.withColumn("excerpt", F.when(proved, F.col("excerpt")).otherwise(F.raise_error(F.lit("evidence does not match")).cast("binary")))
    sized = checked.join(artifacts.select("path", "text", F.octet_length("text").cast("long").alias("size")), "path")
    wide = S.expand(sized, before, after, most)
    return wide.select("path", "start", "end", "evidence_id", "from", "to", byte_slice(F.col("text"), F.col("from"), F.col("to")).alias("excerpt"))


def json_bound(rows: DataFrame, rank: str, budget: int, envelope: int) -> DataFrame:
    """The longest prefix by rank whose rows, as JSON with a comma each, fit; `cut` tells whether rows were left out."""
    size = F.octet_length(F.to_json(F.struct(*[c for c in rows.columns if c != rank]))).cast("long") + 1
    run = running(rows.withColumn("_size", size), [rank], F.col("_size"), "used").withColumn("used", F.col("used") + envelope).drop("_size")
    over = run.agg(F.coalesce(F.max("used") > budget, F.lit(False)).alias("cut"))
    return run.filter(F.col("used") <= budget).crossJoin(F.broadcast(over))


# ranking


def is_supporting(path: Column) -> Column:
    """Whether a file supports others: it lies in one of the supporting directories or is named like a test."""
    parts = F.split(path, r"[/\\]")
    name = F.element_at(parts, -1)
    stem = F.element_at(F.split(name, r"\."), 1)
    folder = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SUPPORTING)))
    return folder | stem.rlike("^test_|_tests?$|^conftest$") | name.contains(".test.") | name.contains(".spec.")


def about_tests(task: Column) -> Column:
    return F.arrays_overlap(words(task), F.array(*map(F.lit, TEST_WORDS)))


def supporting_last(items: DataFrame, key: str, path: str, task: Column, order: str) -> DataFrame:
    """items with their place: supporting files after the others, unless the task is about tests."""
    late = is_supporting(F.col(path)) & ~about_tests(task)
    return items.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(late, order)).cast("long"))


def file_first(items: DataFrame, key: str, order: str, scope: DataFrame) -> DataFrame:
    """items (key, path, order) with their place: one of each file of the scope (key, path, rank) a pass, then all others."""
    ranked = scope.groupBy(key, "path").agg(F.min("rank").alias("rank"))
    placed = items.join(ranked, [key, "path"], "left")
    turn = F.when(F.col("rank").isNotNull(), F.row_number().over(Window.partitionBy(key, "path").orderBy(order)))
    return placed.withColumn("turn", turn).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("rank"), order)).cast("long")).drop("rank", "turn")


def ranked_insert(items: DataFrame, key: str, order: str) -> DataFrame:
    """The first of the items with one (path, method, kind, excerpt), and of these the first of each evidence id.

    An item whose look is new counts as shown even if its id is not. Minima combine before the shuffle.
    """
    look = [key, "path", "method", "kind", "excerpt"]
    first = items.groupBy(*look).agg(F.min(F.struct(order, "evidence_id")).alias("f")).select(*look, f"f.{order}", "f.evidence_id")
    keep = first.groupBy(key, "evidence_id").agg(F.min(order).alias(order))
    return first.join(keep, [key, "evidence_id", order])


def cut_to_declarations(matches: DataFrame, declarations: DataFrame, most: int | None = None, most_items: int | None = None) -> DataFrame:
    """matches (path, start, end, method) with from, to and cut: the smallest declaration around a search's match.

    declarations (path, lo, hi), of at most `most` bytes (None: of any size). With most_items the first so many matches by their
    rank are looked at, of whatever method; else all are. matches is read twice: hand in a stored table.
    """
    if most_items is None:
        searched = F.col("method").isin(*SEARCHES)
        best = enclosing(matches.filter(searched).select("path", "start", "end"), declarations, most)
        joined = matches.join(best, ["path", "start", "end"], "left").withColumns({c: F.when(searched, F.col(c)) for c in ("lo", "hi")})
    else:
        looked = matches.orderBy("rank").limit(most_items).select("rank")
        near = matches.join(F.broadcast(looked), "rank", "left_semi").filter(F.col("method").isin(*SEARCHES))
        # at most most_items files: what is declared elsewhere meets no match, and is not sent anywhere
        around = declarations.join(F.broadcast(near.select("path").distinct()), "path", "left_semi")
        best = near.select("rank", "path", "start", "end").join(enclosing(near, around, most), ["path", "start", "end"]).select("rank", "lo", "hi")
        joined = matches.join(best, "rank", "left")
    return joined.select(*matches.columns, F.coalesce("lo", "start").alias("from"), F.coalesce("hi", "end").alias("to"), F.col("lo").isNotNull().alias("cut"))


# declared inputs


def change_set(entries: DataFrame, key: str, artifacts: DataFrame) -> DataFrame:
    """(key, status) of declared change sets: entries (key, path, content_hash) must each be a file of the snapshot, once."""
    known = artifacts.select("path", F.col("content_hash").alias("have"))
    joined = entries.join(known, "path", "left")
    states = joined.groupBy(key).agg(F.bool_or(~F.col("content_hash").rlike(r"^sha256:[0-9a-f]{64}$")).alias("malformed"), F.bool_or(F.col("have").isNull() | (F.col("have") != F.col("content_hash"))).alias("stale"), (F.count("*") > F.count_distinct("path")).alias("twice"), F.count("*").alias("n"))
    return states.select(key, F.when(F.col("malformed") | (F.col("n") > 10_000), "invalid").when(F.col("stale"), "stale").when(F.col("twice"), "invalid").otherwise("verified").alias("status"), F.col("n").alias("entries"))


def associated_tests(pairs: DataFrame, key: str, artifacts: DataFrame) -> DataFrame:
    """(key, status) of declared pairs (key, source, test): both files exist, no file tests itself, no pair comes twice either way."""
    known = artifacts.select("path").distinct()
    ends = pairs.join(known.select(F.col("path").alias("source"), F.lit(True).alias("s")), "source", "left").join(known.select(F.col("path").alias("test"), F.lit(True).alias("t")), "test", "left")
    pair = F.array_sort(F.array("source", "test"))
    states = ends.groupBy(key).agg(F.bool_or(F.col("s").isNull() | F.col("t").isNull()).alias("stale"), F.bool_or(F.col("source") == F.col("test")).alias("own"), (F.count("*") > F.count_distinct(pair)).alias("twice"))
    return states.select(key, F.when(F.col("stale"), "stale").when(F.col("own") | F.col("twice"), "invalid").otherwise("verified").alias("status"))


def exemplars(items: DataFrame, key: str, artifacts: DataFrame) -> DataFrame:
    """(key, status) of declared exemplars (key, label, path): files exist, labels are no longer than 128 bytes, none comes twice."""
    known = artifacts.select("path", F.lit(True).alias("here")).distinct()
    states = items.join(known, "path", "left").groupBy(key).agg(F.bool_or(F.col("here").isNull()).alias("stale"), F.bool_or(~F.octet_length("label").between(1, 128)).alias("malformed"), (F.count("*") > F.count_distinct("path")).alias("twice"))
    return states.select(key, F.when(F.col("malformed"), "invalid").when(F.col("stale"), "stale").when(F.col("twice"), "invalid").otherwise("verified").alias("status"))


def declared_evidence(paths: DataFrame, artifacts: DataFrame, most_bytes: int) -> DataFrame:
    """(path, excerpt) of the distinct files that verified declarations name, up to most_bytes of each."""
    files = paths.select("path").distinct().join(artifacts, "path")
    return files.select("path", F.substring(F.col("text").cast("binary"), 1, most_bytes).alias("excerpt"), F.octet_length("text").cast("long").alias("size"))


#: Kinds of declarations in the order in which their evidence is taken, and what a change set says of a base it cannot prove.
DECLARATIONS = ("change_set", "associated_tests", "convention_exemplars")
UNPROVED_BASE, BASE_UNKNOWN = "unavailable_or_mismatched", "asserted_base_revision_unavailable_or_mismatched"


def declared_entries(changes: DataFrame, pairs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, kind, path, content_hash) of what three declarations name, each path of a declaration once.

    changes and items (key, path, content_hash); pairs (key, source, source_hash, test, test_hash). Of a path named with several
    hashes the smallest stays.
    """
    ends = F.explode(F.array(F.struct(F.col("source").alias("path"), F.col("source_hash").alias("content_hash")), F.struct(F.col("test").alias("path"), F.col("test_hash").alias("content_hash"))))
    tests = pairs.select(key, ends.alias("end")).select(key, "end.*")
    every = None
    for kind, rows in zip(DECLARATIONS, (changes, tests, items)):
        some = rows.select(key, F.lit(kind).alias("kind"), "path", "content_hash")
        every = some if every is None else every.unionByName(some)
    return every.groupBy(key, "kind", "path").agg(F.min("content_hash").alias("content_hash"))


def recovered_declarations(declared: DataFrame, entries: DataFrame, key: str, artifacts: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, states) of verified declarations, recovered from the files as they are now.

    declared (key, kind, workspace_snapshot, base_status), a row for each declaration; entries (key, kind, path, content_hash).
    states: a row for each key: status (recovered or stale), reason of the first declaration or file that is not what was
    verified (snapshot, source_unavailable, source_changed), unknown, entries. A key with anything stale has no evidence;
    of the others each path is evidence once, as an exact read, of the first kind that names it. A null hash is a changed file.
    """
    order = lambda kind: F.array_position(F.array(*map(F.lit, DECLARATIONS)), kind)
    now = artifacts.select("path", content_hash(F.col("text")).alias("have"))
    read = entries.join(now, "path", "left").withColumn("path_units", path_units(F.col("path")))
    wrong = F.when(F.col("have").isNull(), "source_unavailable").when(~F.col("have").eqNullSafe(F.col("content_hash")), "source_changed")
    files = read.select(key, order(F.col("kind")).alias("o"), "path_units", wrong.alias("reason"), F.lit(None).cast("string").alias("unknown"), F.lit(1).alias("n"))
    old = F.when(~F.col("workspace_snapshot").eqNullSafe(F.lit(snapshot)), "snapshot")
    unproved = F.when((F.col("kind") == DECLARATIONS[0]) & (F.col("base_status") == UNPROVED_BASE), BASE_UNKNOWN)
    # a declaration's snapshot is looked at before its files
    heads = declared.select(key, order(F.col("kind")).alias("o"), F.lit("").alias("path_units"), old.alias("reason"), unproved.alias("unknown"), F.lit(0).alias("n"))
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("o", "path_units", "reason")))["reason"]
    found = heads.unionByName(files).groupBy(key).agg(first.alias("reason"), F.max("unknown").alias("unknown"), F.sum("n").alias("entries"))
    states = found.select(key, F.when(F.col("reason").isNull(), "recovered").otherwise("stale").alias("status"), "reason", F.when(F.col("reason").isNull(), F.col("unknown")).alias("unknown"), "entries")
    fresh = read.join(states.filter("status = 'recovered'").select(key), key, "left_semi")
    once = fresh.groupBy(key, "path").agg(F.min(order(F.col("kind"))).alias("o"), F.first("have").alias("content_hash"), F.first("path_units").alias("path_units"))
    zero = F.lit(0).cast("long")
    identity = digest("evidence", F.col("content_hash"), F.lit("0"), F.col("path"), F.lit(snapshot), F.lit("0"))
    evidence = once.select(key, F.element_at(F.array(*map(F.lit, DECLARATIONS)), F.col("o").cast("int")).alias("kind"), "path", "path_units", zero.alias("start"), zero.alias("end"), "content_hash", F.lit("exact_read").alias("method"), identity.alias("evidence_id"))
    return evidence, states


def structural_evidence(edges: DataFrame, nodes: DataFrame, artifacts: DataFrame, snapshot: str) -> DataFrame:
    """(evidence_id, path, start, end, excerpt) of the spans that edges were found at, each span once."""
    source = nodes.select(F.col("node_id").alias("source_node"), "path")
    spans = edges.join(source, "source_node").select("path", F.col("start_byte").alias("start"), F.col("end_byte").alias("end")).distinct()
    hashed = spans.join(artifacts.select("path", content_hash(F.col("text")).alias("content_hash")), "path")
    return recovered(hashed, artifacts, snapshot).select("evidence_id", "path", "start", "end", "excerpt")


def substitutes(declarations: DataFrame, files: DataFrame, budget: int, symbol: Column | None = None, most: int = 256) -> DataFrame:
    """One row per file: the spans that stand for its text: (path, spans, returned_bytes, omitted, whole_bytes, unknowns).

    declarations (path, name, lo, hi); files (path, content). Without a symbol, spans that no earlier one reaches past; with
    one, all declarations of that name. A span over the budget is passed over, smaller ones after it may fit.
    """
    if symbol is None:
        reach = F.max("hi").over(Window.partitionBy("path").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1))
        chosen = declarations.withColumn("_reach", reach).filter("_reach is null or hi > _reach").drop("_reach")
    else:
        chosen = declarations.filter(F.col("name") == symbol)
    queue = chosen.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "name"))).alias("q"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("omitted"), F.lit(False).alias("bytes"), F.lit(False).alias("full"), F.array().cast("array<struct<lo:bigint,hi:bigint,name:string>>").alias("kept"))

    def step(a, x):
        full, size = F.size(a["kept"]) >= most, x["hi"] - x["lo"]
        over = a["used"] + size > budget
        same = lambda omitted, b, f: F.struct(a["used"].alias("used"), (a["omitted"] + omitted).alias("omitted"), b.alias("bytes"), f.alias("full"), a["kept"].alias("kept"))
        took = F.struct((a["used"] + size).alias("used"), a["omitted"].alias("omitted"), a["bytes"].alias("bytes"), a["full"].alias("full"), F.concat(a["kept"], F.array(F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["name"].alias("name")))).alias("kept"))
        return F.when(full, same(1, a["bytes"], F.lit(True))).when(over, same(1, F.lit(True), a["full"])).otherwise(took)

    done = files.join(queue, "path", "left").withColumn("s", F.aggregate(F.coalesce("q", F.array().cast("array<struct<lo:bigint,hi:bigint,name:string>>")), start, step))
    spans = F.transform("s.kept", lambda x: F.struct(x["name"].alias("name"), x["lo"].alias("start"), x["hi"].alias("end"), content_hash(F.substring(F.col("content"), (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int"))).alias("sha256")))
    none = F.size("s.kept") == 0
    unknowns = F.array_sort(F.array_compact(F.array(F.when(F.col("s.bytes"), "byte_ceiling_reached"), F.when(F.col("s.full"), "span_ceiling_reached"), F.when(none & F.lit(symbol is None), "no_declarations"), F.when(F.col("q").isNull() & F.lit(symbol is not None), "symbol_not_declared"))))
    return done.select("path", spans.alias("spans"), F.col("s.used").alias("returned_bytes"), F.col("s.omitted").cast("long").alias("omitted"), F.octet_length("content").cast("long").alias("whole_bytes"), F.array_join(unknowns, ",").alias("unknowns"))


def fallback(requirement: Column, reason: Column) -> Column:
    """Whether a reader may fall back to its own means."""
    return F.when(requirement == "disabled", True).when(requirement == "preferred", reason.isin("engine_unavailable", "unsupported_capability")).otherwise(False)
