"""Evaluation: reference patches, what was delivered, scores of cases, and the rates of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import multisearch
from brindle.operators.logs import lines, trimmed

#: Openings of a heading that names a declaration.
DECLARING = "def class fn function struct impl".split()
DELIVERED = "struct<disclosure_map:struct<items:array<struct<display_path:string,target_display_path:string,symbol_label:string>>>,initial_packet:struct<observed_evidence:array<struct<artifact:struct<path:struct<display_path:string>>,excerpt:struct<bytes_base64url:string>>>>>"


def patch_lines(patches: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, line, file, anchor): each line of a unified diff with the file it is in and the context line before it."""
    rows = lines(patches, key, text)
    line = F.col("line")
    header, hunk = line.startswith("+++ "), line.startswith("@@")
    named = trimmed(F.substring_index(F.substr(line, F.lit(5)), "\t", 1))
    touched = F.regexp_replace(named, "^b/", "")
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    filed = rows.withColumn("at", F.last(F.when(header, F.struct(F.when(~touched.isin("", "/dev/null"), touched).alias("file"))), ignorenulls=True).over(before)).withColumn("file", F.col("at.file"))
    inside = F.col("file").isNotNull() & ~header & ~hunk & ~line.startswith("---")
    context = trimmed(F.substr(line, F.lit(2)))
    mark = F.when(header | hunk, F.struct(F.lit(None).cast("string").alias("text"))).when(inside & line.startswith(" ") & (context != ""), F.struct(context.alias("text")))
    return filed.withColumn("m", F.last(mark, ignorenulls=True).over(before)).select(key, "idx", "line", "file", F.col("m.text").alias("anchor"), inside.alias("inside"))


def reference(patches: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, symbols, changed) of patches: (key, file), (key, symbol), (key, file, line), all distinct.

    A changed line is one that goes, or the context line before one that comes.
    """
    rows = patch_lines(patches, key, text)
    line = F.col("line")
    files = rows.filter(line.startswith("+++ ") & F.col("file").isNotNull()).select(key, "file").distinct()
    heading = trimmed(F.regexp_extract(line, r"^@@ (?:(?!@@).)*@@(.*)$", 1))
    symbol = F.regexp_extract(heading, rf"^(?:{'|'.join(DECLARING)}) \s*([A-Za-z0-9_$]+)", 1)
    symbols = rows.filter(line.startswith("@@")).select(key, symbol.alias("symbol")).filter("symbol <> ''").distinct()
    gone = trimmed(F.substr(line, F.lit(2)))
    changed = F.when(line.startswith("-") & (gone != ""), gone).when(line.startswith("+"), F.col("anchor"))
    return files, symbols, rows.filter("inside").select(key, "file", changed.alias("line")).filter("line is not null").distinct()


def delivered(results: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(map, evidence) of delivered JSON, at whichever level it holds its content.

    map (key, file, own, symbol): paths that items name, own where it is the item's own path; evidence (key, file, excerpt).
    """
    raw = F.col(text)
    root = F.coalesce(F.get_json_object(raw, "$.result.structuredContent"), F.get_json_object(raw, "$.structuredContent"), raw)
    parsed = results.select(key, F.from_json(root, DELIVERED).alias("d"))
    items = parsed.select(key, F.explode("d.disclosure_map.items").alias("i"))
    own = items.select(key, F.col("i.display_path").alias("file"), F.lit(True).alias("own"), F.col("i.symbol_label").alias("symbol"))
    target = items.select(key, F.col("i.target_display_path").alias("file"), F.lit(False).alias("own"), F.lit(None).cast("string").alias("symbol"))
    shown = parsed.select(key, F.explode("d.initial_packet.observed_evidence").alias("e"))
    units = F.col("e.excerpt.bytes_base64url")
    data = F.try_to_binary(F.rpad(F.translate(units, "-_", "+/"), (F.ceil(F.length(units) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    return own.unionByName(target), shown.select(key, F.col("e.artifact.path.display_path").alias("file"), F.make_valid_utf8(data.cast("string")).alias("excerpt")).filter("file is not null")


def score(patches: DataFrame, results: DataFrame, key: str, patch: str, text: str) -> DataFrame:
    """One row per case: counts of reference files and symbols, of those a map names, of changed lines, of those in the evidence."""
    files, symbols, changed = reference(patches, key, patch)
    map_, evidence = delivered(results, key, text)
    named = map_.filter("file is not null").groupBy(key, "file").agg(F.bool_or("own").alias("own"))
    f = files.join(named, [key, "file"], "left").join(evidence.select(key, "file", F.lit(True).alias("shown")).distinct(), [key, "file"], "left")
    by_file = f.groupBy(key).agg(F.count("*").alias("files"), F.count("own").alias("map_files"), F.count_if(F.col("own") == False).alias("via_target"), F.count("shown").alias("evidence_files"))  # noqa: E712
    known = map_.filter("symbol is not null").select(key, "symbol", F.lit(True).alias("hit")).distinct()
    by_symbol = symbols.join(known, [key, "symbol"], "left").groupBy(key).agg(F.count("*").alias("symbols"), F.count("hit").alias("map_symbols"))
    found = changed.join(evidence, [key, "file"], "left").groupBy(key, "file", "line").agg(F.coalesce(F.bool_or(F.contains("excerpt", F.col("line"))), F.lit(False)).alias("in_evidence"))
    by_line = found.groupBy(key).agg(F.count("*").alias("changed_lines"), F.count_if("in_evidence").alias("changed_in_evidence"))
    sizes = results.select(key, F.octet_length(text).cast("long").alias("delivered_bytes"))
    joined = sizes.join(by_file, key).join(by_symbol, key, "left").join(by_line, key, "left")
    zero = ("symbols", "map_symbols", "changed_lines", "changed_in_evidence")
    return joined.select(key, "files", "map_files", "via_target", "evidence_files", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero), "delivered_bytes")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 100 / F.nullif(whole, F.lit(0)))).cast("long")


def summary(scores: DataFrame) -> DataFrame:
    """Totals of all cases and what was recalled, in whole percent."""
    sums = scores.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in scores.columns[1:]), F.count("*").alias("cases"))
    return sums.select("cases", "files", "symbols", "changed_lines", "delivered_bytes", percent(F.col("map_files"), F.col("files")).alias("map_file_percent"), percent(F.col("map_symbols"), F.col("symbols")).alias("map_symbol_percent"), percent(F.col("evidence_files"), F.col("files")).alias("evidence_file_percent"), percent(F.col("changed_in_evidence"), F.col("changed_lines")).alias("changed_line_percent"))


def holding(files: DataFrame, needles: DataFrame, key: str, slice_bytes: int = multisearch.SLICE_BYTES) -> DataFrame:
    """(key, path) of the files (path, text) that hold a needle (key, needle), found by one automaton of all needles.

    The needles are fixtures: they pass the driver, each text once, and go to the tasks slice_bytes at a time. Empty and null
    needles are in no file. Paths must be distinct.
    """
    some = needles.filter(F.octet_length("needle") > 0)
    distinct = [r["needle"] for r in some.select("needle").distinct().toLocalIterator()]
    numbers = needles.sparkSession.createDataFrame(list(enumerate(distinct)), "number long, text string")
    _, hits = multisearch.scan(files, [(k, multisearch.TEXT, needle.encode()) for k, needle in enumerate(distinct)], 1, slice_bytes)
    numbered = some.join(numbers, some["needle"] == numbers["text"]).select(key, "number")
    return numbered.join(hits.select(F.col("needle").alias("number"), "path"), "number").select(key, "path")


def corpus_rates(fixtures: DataFrame, wanted: DataFrame, found: DataFrame, native: DataFrame, key: str) -> DataFrame:
    """One row: recall, precision and reduction over all fixtures, of the search and of a plain one, and the gates that fail.

    fixtures (key, bytes, excerpt_bytes); wanted, found, native (key, path). Rates are of sums, not means of rates.
    """
    one = lambda df, name: df.select(key, "path", F.lit(1).alias(name)).distinct()
    every = one(wanted, "w").join(one(found, "f"), [key, "path"], "full").join(one(native, "n"), [key, "path"], "full")
    hit = lambda c: F.count_if(F.col("w").isNotNull() & F.col(c).isNotNull())
    counts = every.agg(F.count("w").alias("required"), F.count("f").alias("retrieved"), hit("f").alias("relevant"), hit("n").alias("native"))
    sizes = fixtures.agg(F.count("*").alias("fixtures"), F.sum("bytes").alias("bytes"), F.sum("excerpt_bytes").alias("excerpt_bytes"))
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.nullif(F.col(b), F.lit(0)))
    rates = counts.crossJoin(sizes).select("fixtures", ratio("relevant", "required").alias("recall"), ratio("native", "required").alias("native_recall"), ratio("relevant", "retrieved").alias("precision"), (1 - ratio("excerpt_bytes", "bytes")).alias("reduction"))
    gates = F.array_compact(F.array(F.when(F.col("recall") < 0.90, "recall"), F.when(F.col("precision") < 0.70, "precision"), F.when(F.col("recall") + 0.02 < F.col("native_recall"), "native"), F.when(F.col("reduction") < 0.30, "reduction")))
    return rates.withColumn("failures", F.array_join(gates, ","))
