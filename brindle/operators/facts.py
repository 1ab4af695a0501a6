"""Structural facts of files: language routing, the parse of each file, fair shares of a fact allowance, cached facts."""

from __future__ import annotations

import hashlib
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import parsers
from brindle.functions.text import content_hash
from brindle.sources.store import staged

TOOLCHAIN = "brindle-facts-1"
FACT_SCHEMA = "path string, content_hash string, class string, local_key string, syntax_kind string, name string, module string, start_byte long, end_byte long, parent_key string, demand long, syntax_errors boolean, warnings array<string>"
FACT_COLUMNS = [c.strip().split(" ")[0] for c in FACT_SCHEMA.split(", ")]
#: Paths that may be broadcast.
BROADCAST_PATHS = 500_000
#: Facts that the files of a narrow scope may have together.
SCOPED_FACTS = 28_000


def language_of(path: Column) -> Column:
    """The language of a file by its ending, or null; JSON only under the names of configuration files."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.when(name.rlike(r"[^/]\.[^./]+$"), F.element_at(F.split(name, r"\."), -1)))
    languages = F.create_map(*(F.lit(x) for pair in parsers.LANGUAGES.items() for x in pair))
    jsonc = (ending == "jsonc") | name.isin(*parsers.JSONC) | (path.rlike(r"(^|/)\.vscode/[^/]+$") & name.isin(*parsers.EDITOR_JSONC))
    return F.when((ending == "json") & name.isin(*parsers.STRICT_JSON), "json").when(ending.isin("json", "jsonc") & jsonc, "jsonc").otherwise(F.try_element_at(languages, ending))


def parse_task(classes: Collection[str] | None = None, counted: bool = True):
    """Files to their facts, or those of the classes named; counted: facts of the other classes count and take of the ceiling too."""
    keep = frozenset(classes) if classes is not None else frozenset(("file", *parsers.CLASSES))
    wanted = parsers.CLASSES if counted else keep

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content_hash", pa.string()), ("class", pa.string()), ("local_key", pa.string()), ("syntax_kind", pa.string()), ("name", pa.string()), ("module", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("parent_key", pa.string()), ("demand", pa.int64()), ("syntax_errors", pa.bool_()), ("warnings", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for path, content, language, most in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "language", "most"))):
                if len(rows) > 16_384:
                    yield fact_batch(rows, schema)
                    rows = []
                parsed = parsers.parse(content, language, most, wanted)
                digest = "sha256:" + hashlib.sha256(content).hexdigest()
                if "file" in keep:
                    rows.append((path, digest, "file", "file", language, None, None, 0, len(content), None, parsed.demand if counted else None, parsed.syntax_errors, parsed.warnings))
                rows += [(path, digest, f.kind, parsers.fact_key(f), f.syntax, f.name, f.module, f.start, f.end, f.parent, None, None, None) for f in parsed.facts if f.kind in keep]
            yield fact_batch(rows, schema)

    return task


def fact_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def extract(files: DataFrame, most: Column | int | None = None, classes: Collection[str] | None = None, counted: bool = True) -> DataFrame:
    """Facts of the files (path, content) whose language is known, a row of class `file` first for each.

    most: facts of a file (None: all). The file's row tells its demand: how many facts it has without a ceiling. classes: the
    classes of rows that are wanted (None: all); rows of others are not made, which a filter of the result cannot spare.
    counted: without it demand is null, and facts of other classes need not be found; there is no ceiling then.
    """
    if not counted and most is not None:
        raise ValueError("under a ceiling all facts count")
    most = 1 << 30 if most is None else most
    wanted = files.select("path", "content", language_of(F.col("path")).alias("language"), (most if isinstance(most, Column) else F.lit(most)).cast("long").alias("most"))
    return wanted.filter("language is not null and content is not null").mapInArrow(parse_task(classes, counted), FACT_SCHEMA)


def parsed_files(files: DataFrame) -> DataFrame:
    """(path, class): what the facts of class `file` say of paths, without a parse."""
    return files.filter(language_of(F.col("path")).isNotNull() & F.col("content").isNotNull()).select("path", F.lit("file").alias("class"))


def verified(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The files whose bytes are those of the snapshot (path, content_hash); a read of other bytes is stale and raises."""
    checked = files.join(snapshot.select("path", F.col("content_hash").alias("expected")), "path")
    stale = F.raise_error(F.concat(F.lit("stale artifact: "), F.col("path")))
    return checked.withColumn("content", F.when(content_hash(F.col("content")) == F.col("expected"), F.col("content")).otherwise(stale.cast("binary"))).drop("expected")


def scoped(files: DataFrame, max_files: int | None, scope: DataFrame | None) -> DataFrame:
    """The first max_files files by path (None: all), then those in scope: the ceiling comes before the scope."""
    if max_files is None:
        return files if scope is None else files.join(scope.select("path").distinct(), "path", "left_semi")
    # paths alone are sorted; contents stay where they are
    first = files.select("path").orderBy("path").limit(max_files)
    first = first if scope is None else first.join(scope.select("path").distinct(), "path", "left_semi")
    return files.join(F.broadcast(first) if max_files <= BROADCAST_PATHS else first, "path", "left_semi")


def shares_task(n_group: int, allowance: int, names: list[str]):
    """Files of a scope, in order, each with the number of them, to what each holds; a scope's state is two numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, files = None, 0, 0
        for batch in batches:
            groups = list(zip(*(c.to_pylist() for c in batch.columns[:n_group]))) if n_group else [()] * batch.num_rows
            held = []
            for now, demand, n in zip(groups, batch.column(n_group + 1).to_pylist(), batch.column(n_group + 2).to_pylist()):
                if now != key:
                    key, left, files = now, allowance, n
                took = min(demand, -(-left // files) if left > 0 else 0)
                left, files = left - took, files - 1
                held.append(took)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_group + 2], pa.array(held, pa.int64())], names)

    return task


def equal_shares(demands: DataFrame, group: list[str], order: str, allowance: int) -> DataFrame:
    """demands (group, order, demand) with what each file holds when files take, in turn, an equal part of what is left.

    Each share depends on all before it, so a scope's files pass one task in order; what it keeps of them is two numbers.
    """
    # counted by a window, not joined: Spark drops a repartition after a join by the same key, and a join that turns into a
    # broadcast then reads its rows where they lie, which deals a scope to several tasks
    rows = demands.select(*group, order, F.col("demand").cast("long").alias("demand")).withColumn("_files", F.count("*").over(Window.partitionBy(*group)))
    rows = rows.repartition(*group).sortWithinPartitions(*group, order).select(*group, order, "demand", "_files")
    names = [*group, order, "demand", "held"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names[:-1]) + ", held long"
    return rows.mapInArrow(shares_task(len(group), allowance, names), schema)


def grants(shares: DataFrame, group: list[str], order: str, allowance: int) -> DataFrame:
    """shares (group, order, demand, held) with the grant after the unspent part goes to the shortest shortfalls first.

    Shortfalls in ascending order are met in full until one is larger than an equal part of what is left; from there on each
    gets that part, the last ones one more. So a prefix sum and the first failing place say it all.
    """
    short = F.greatest(F.col("demand") - F.col("held"), F.lit(0)).cast("long")
    rows = shares.withColumn("_short", short)
    spent = rows.groupBy(*group).agg((F.lit(allowance) - F.sum("held")).cast("long").alias("_left"), F.count_if(F.col("_short") > 0).alias("_files"))
    line = Window.partitionBy(*group).orderBy("_short", order)
    wanting = rows.filter("_short > 0").join(spent, group)
    placed = wanting.withColumns({"_n": F.row_number().over(line).cast("long"), "_before": (F.sum("_short").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_short")).cast("long")})
    part = F.expr("(_left - _before) div (_files - _n + 1)")
    fails = F.when((F.col("_left") <= F.col("_before")) | (F.col("_short") > part), F.col("_n"))
    whole = Window.partitionBy(*group)
    broken = placed.withColumn("_first", F.min(fails).over(whole))
    at_first = F.max(F.when(F.col("_n") == F.col("_first"), F.greatest(F.col("_left") - F.col("_before"), F.lit(0)))).over(whole)
    rest = broken.withColumns({"_rest": at_first, "_sharers": F.col("_files") - F.col("_first") + 1})
    equal = F.expr("_rest div _sharers") + F.when(F.col("_n") - F.col("_first") >= F.col("_sharers") - F.expr("_rest % _sharers"), 1).otherwise(0)
    give = F.when(F.col("_first").isNull() | (F.col("_n") < F.col("_first")), F.col("_short")).otherwise(equal)
    given = rest.select(*group, order, give.cast("long").alias("give"))
    return shares.join(given, [*group, order], "left").withColumn("grant", F.col("held") + F.coalesce("give", F.lit(0))).drop("give")


def build_loop(files: DataFrame, allowance: int = SCOPED_FACTS, scope: DataFrame | None = None, max_files: int | None = 20_000) -> tuple[DataFrame, DataFrame]:
    """(facts, ledger) of the first max_files files (None: all), or of those in scope (path): together no more than allowance facts.

    All files are parsed under an equal part of the allowance, which tells what each would give. What files leave of their
    shares, taken in turn, goes to the shortest shortfalls first, and only files that were cut and got more are parsed again. ledger
    (path, demand, first, grant, parses): first is what the first parse gave, grant what the file has in the end.
    """
    chosen = scoped(files, max_files, scope).filter(language_of(F.col("path")).isNotNull())
    n = chosen.count()
    share = allowance // n if n else 0
    once = staged(extract(chosen, share), "first-parse")
    demands = once.filter("class = 'file'").select(F.lit(0).alias("_scope"), "path", "demand")
    held = equal_shares(demands, ["_scope"], "path", allowance)
    ledger = grants(held, ["_scope"], "path", allowance).withColumn("first", F.least("demand", F.lit(share).cast("long")))
    # never below what the first parse gave: the shares in turn are no smaller than the equal part
    ledger = staged(ledger.select("path", "demand", "first", F.greatest("grant", "first").cast("long").alias("grant"), F.when(F.col("grant") > F.col("first"), 2).otherwise(1).cast("long").alias("parses")), "ledger")
    again = ledger.filter("parses = 2").select("path", F.col("grant").alias("_grant"))
    more = chosen.join(again, "path")
    wanted = more.select("path", "content", language_of(F.col("path")).alias("language"), F.col("_grant").alias("most"))
    twice = wanted.mapInArrow(parse_task(), FACT_SCHEMA)
    return once.join(again, "path", "left_anti").unionByName(twice), ledger


def prefix_within(rows: DataFrame, group: list[str], order: list, budget: int, envelope: int = 0) -> DataFrame:
    """The longest prefix of each group whose rows, as JSON with a comma each, fit the budget beside the envelope."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns))).cast("long") + 1
    run = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", run).filter(F.col("_used") <= budget - envelope).drop("_used")


def validated(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (path, problem) of facts that break the contract: foreign hash, span outside the file, unknown class, doubled key."""
    sizes = files.select("path", content_hash(F.col("content")).alias("expected"), F.octet_length("content").cast("long").alias("size"))
    # dealt by path once: equal keys of a file then lie side by side in a task, and its files come to it there
    rows = facts.select("path", "content_hash", "class", "local_key", "start_byte", "end_byte").repartition("path")
    turn = F.row_number().over(Window.partitionBy("path", "local_key").orderBy("local_key"))
    joined = rows.withColumn("_turn", turn).join(sizes.hint("merge"), "path", "left")
    problem = (
        F.when(F.col("expected").isNull() | (F.col("expected") != F.col("content_hash")), "content_hash")
        .when((F.col("start_byte") < 0) | (F.col("end_byte") < F.col("start_byte")) | (F.col("end_byte") > F.col("size")), "span")
        .when(~F.col("class").isin("file", *parsers.CLASSES), "class")
    )
    return joined.select("path", F.explode(F.array_compact(F.array(problem, F.when(F.col("_turn") == 2, "doubled_key")))).alias("problem"))


def missing_facts(files: DataFrame, cache: DataFrame, toolchain: str = TOOLCHAIN) -> DataFrame:
    """The files whose (path, content hash, toolchain) the cache (path, content_hash, toolchain) does not hold."""
    known = cache.filter(F.col("toolchain") == toolchain).select("path", "content_hash").distinct()
    return files.withColumn("content_hash", content_hash(F.col("content"))).join(known, ["path", "content_hash"], "left_anti").drop("content_hash")


def with_cache(files: DataFrame, cache: DataFrame, toolchain: str = TOOLCHAIN) -> tuple[DataFrame, DataFrame]:
    """(facts of all files, facts to append): cached rows for the exact key, a parse for the others.

    cache: rows of facts with a column toolchain.
    """
    keys = files.select("path", content_hash(F.col("content")).alias("content_hash"))
    held = cache.filter(F.col("toolchain") == toolchain).drop("toolchain").join(keys, ["path", "content_hash"], "left_semi").select(*FACT_COLUMNS)
    # read by both results: parsed once
    fresh = staged(extract(missing_facts(files, cache, toolchain)), "fresh-facts")
    return held.unionByName(fresh), fresh.withColumn("toolchain", F.lit(toolchain))
