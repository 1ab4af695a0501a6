"""Identifier index and file nomination: what a workspace's files declare and mention, and which of them a task is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import is_identifier
from brindle.operators.facts import language_of
from brindle.operators.structure import DECLARED_WEIGHT, declared_name

#: Bounds of the index and of a nomination.
INDEXED_FILES, IDENTIFIERS_OF_A_FILE, DECLARATIONS_OF_A_FILE, IDENTIFIER_BYTES, MOST_DECLARERS, NOMINATED = 20_000, 512, 256, 256, 8, 16


def identifier_tokens(text: Column) -> Column:
    """Runs of letters, digits, _, -, . and :, in order, repeats too."""
    return F.filter(F.split(text, r"[^A-Za-z0-9_\-.:]+"), lambda t: F.length(t) > 0)


def identifiers(text: Column) -> Column:
    """Distinct names of code in a text, in order: tokens, and the members of dotted ones."""

    def names(t: Column) -> Column:
        member = F.when(t.contains("."), F.regexp_extract(t, r"([^.]*)$", 1))
        fits = lambda x: F.when((F.length(x) <= IDENTIFIER_BYTES) & is_identifier(x), x)
        return F.array_compact(F.array(fits(t), F.when(F.length(t) <= IDENTIFIER_BYTES, fits(member))))

    return F.array_distinct(F.flatten(F.transform(identifier_tokens(text), names)))


def declared_names(text: Column) -> Column:
    """Distinct names that a text's lines declare, in order."""
    found = F.transform(F.split(text, r"\r?\n"), declared_name)
    return F.array_distinct(F.filter(found, lambda n: n.isNotNull() & (F.length(n) <= IDENTIFIER_BYTES)))


def identifier_index(files: DataFrame, most: int | None = INDEXED_FILES) -> tuple[DataFrame, DataFrame]:
    """(index, unknowns) of files (path, content): index rows (path, mentions, declares), both arrays of names.

    Files of a known language only, the first `most` by path (None: all); a file that is no UTF-8 gives nothing, and says so. A
    file's names are found in its own row, and only paths are sorted, so building the index moves no text.
    """
    known = files.filter(language_of(F.col("path")).isNotNull())
    if most is not None:
        known = files.join(F.broadcast(known.select("path").orderBy("path").limit(most)), "path", "left_semi")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    found = known.select("path", text.alias("text")).select("path", F.col("text").isNull().alias("undecodable"), identifiers(F.col("text")).alias("m"), declared_names(F.col("text")).alias("d"))
    index = found.filter("not undecodable and (size(m) > 0 or size(d) > 0)").select("path", F.slice("m", 1, IDENTIFIERS_OF_A_FILE).alias("mentions"), F.slice("d", 1, DECLARATIONS_OF_A_FILE).alias("declares"))
    why = F.array_compact(
        F.array(
            F.when(F.col("undecodable"), "identifier_index_undecodable_file"),
            F.when(F.size("m") > IDENTIFIERS_OF_A_FILE, "identifier_index_file_identifier_limit_reached"),
            F.when(F.size("d") > DECLARATIONS_OF_A_FILE, "identifier_index_file_declaration_limit_reached"),
        )
    )
    return index, found.select(F.explode(why).alias("unknown")).distinct()


def matches(index: DataFrame, side: str, wanted: DataFrame) -> DataFrame:
    """(path, name) of wanted names (column name) that files mention or declare."""
    return index.select("path", F.explode(side).alias("name")).join(F.broadcast(wanted.select("name").distinct()), "name", "left_semi").select("path", "name")


def distinct_declarers(index: DataFrame) -> DataFrame:
    """(name, files) of names that one to MOST_DECLARERS files declare."""
    return index.select("path", F.explode("declares").alias("name")).groupBy("name").agg(F.count_distinct("path").alias("files")).filter(F.col("files") <= MOST_DECLARERS)


def module_paths(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """(token, path): dotted tokens that name exactly one file, its ending aside, at any depth, and no directory.

    tokens: column token; paths: column path. Each path gives its own tails and those of its directories, and only tails
    that a token names go further.
    """
    asked = tokens.select("token").distinct().filter(F.col("token").contains(".") & ~F.col("token").contains("/")).join(paths.select(F.col("path").alias("token")), "token", "left_anti")
    suffix = asked.withColumn("tail", F.replace("token", F.lit("."), F.lit("/")))
    parts = F.split("path", "/")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    tails = lambda whole: F.transform(F.sequence(F.lit(1), F.size(whole)), lambda i: F.array_join(F.slice(whole, i, F.size(whole)), "/"))
    own = paths.select("path", F.explode(tails(F.split(stem, "/"))).alias("tail")).join(F.broadcast(suffix), "tail")
    folders = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: tails(F.slice(parts, 1, k))))
    taken = paths.filter(F.size(parts) > 1).select(F.explode(F.array_distinct(folders)).alias("tail")).join(F.broadcast(suffix), "tail").select("token").distinct()
    one = own.groupBy("token").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return one.join(taken, "token", "left_anti").select("token", "path")


def nominate(signals: DataFrame, key: str, paths: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nominations, unknowns): (key, place, path, reason, matched) of up to NOMINATED files a task, and what was left out.

    signals: (key, kind, signal, ord). Paths that the task names come first and are all taken; then modules; then files by
    what they declare and mention of the task's names, rare names counting more and declarations three times.
    """
    n_files = paths.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_files"))
    names = signals.filter("kind = 'identifier'").select(key, F.col("signal").alias("name")).distinct()
    mentioned, declared = matches(index, "mentions", names), matches(index, "declares", names)
    both = mentioned.withColumn("declares", F.lit(0)).unionByName(declared.withColumn("declares", F.lit(1)))
    df = both.groupBy("name").agg(F.greatest(F.sum("declares"), F.sum(1 - F.col("declares"))).alias("df"))
    weight = F.length(F.bin(F.greatest(F.expr("n_files div df"), F.lit(1).cast("long"))))
    weights = df.crossJoin(F.broadcast(n_files)).select("name", weight.alias("w"))
    scored = both.join(names, "name").join(weights, "name").groupBy(key, "path").agg(F.sum("declares").alias("declared"), F.sum(1 - F.col("declares")).alias("mentioned"), F.sum(F.col("w") * F.when(F.col("declares") == 1, DECLARED_WEIGHT).otherwise(1)).alias("score"))
    asked = signals.filter("kind = 'path'").select(key, F.col("signal").alias("token"), "ord")
    exact = asked.join(paths.select(F.col("path").alias("token")), "token").select(key, F.col("token").alias("path"), F.lit(0).alias("tier"), F.col("ord").alias("o"))
    modules = asked.join(F.broadcast(module_paths(asked, paths)), "token").select(key, "path", F.lit(1).alias("tier"), F.col("ord").alias("o"))
    ranked = scored.select(key, "path", F.lit(2).alias("tier"), (-F.col("score")).cast("long").alias("o"))
    first = exact.unionByName(modules).unionByName(ranked).groupBy(key, "path").agg(F.min(F.struct("tier", "o")).alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at", "path")).cast("long")).join(scored, [key, "path"], "left")
    reason = F.when(F.col("at.tier") == 0, "exact_task_path").when(F.col("at.tier") == 1, "task_module_path").when(F.col("declared") > 0, "task_identifier_declared").otherwise("task_identifier_match")
    matched = F.when(F.col("at.tier") < 2, F.coalesce("mentioned", F.lit(0))).otherwise(F.col("declared") + F.col("mentioned"))
    taken = (F.col("at.tier") == 0) | (F.col("place") <= NOMINATED)
    chosen = placed.filter(taken).select(key, "place", "path", reason.alias("reason"), matched.cast("long").alias("matched"))
    counts = signals.select(key).distinct().join(placed.groupBy(key).agg(F.count("*").alias("all"), F.count_if(taken).alias("taken")), key, "left")
    why = F.array_compact(F.array(F.lit("structural_scope_limited_to_nominated_files"), F.when(F.col("all") > F.col("taken"), "nomination_ceiling_reached"), F.when(F.coalesce("taken", F.lit(0)) == 0, "no_candidate_file_nominated")))
    return chosen, counts.select(key, F.explode(why).alias("unknown"))
