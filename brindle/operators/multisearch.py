"""Many searches over one reading of the files: places of all needles by one automaton, then each search's own order and limits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import excerpt_bounds
from brindle.operators.signals import words
from brindle.sources.artifacts import path_units
from brindle.sources.store import staged

#: Bytes of needles that go to the tasks at once; more are searched in slices, each of which reads the files again.
SLICE_BYTES = 8 << 20
#: Up to so many needles are looked for one by one; more go into an automaton.
FEW_NEEDLES = 4
#: Bytes of a text that the automaton takes at a time.
PIECE = 1 << 24
TERM = re.compile(rb"[a-z0-9_]+")
TEXT, FOLDED, NAME, WORD = "text", "folded", "name", "word"


class Finder:
    """The first places of each of many needles in a text, overlapping ones too, in time linear in the text."""

    def __init__(self, needles: list[bytes]):
        self.needles, self.automaton = needles, None
        self.longest = max(map(len, needles), default=0)
        if len(needles) > FEW_NEEDLES:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for i, needle in enumerate(needles):
                # one character a byte, so that places are bytes
                self.automaton.add_word(needle.decode("latin-1"), (i, len(needle)))
            self.automaton.make_automaton()

    def __call__(self, text: bytes, most: int) -> dict[int, list[int]]:
        """Needle to its first `most` places."""
        found: dict[int, list[int]] = {}
        if self.automaton is None:
            for i, needle in enumerate(self.needles):
                at, places = text.find(needle), []
                while at >= 0 and len(places) < most:
                    places.append(at)
                    at = text.find(needle, at + 1)
                if places:
                    found[i] = places
            return found
        for base in range(0, len(text), PIECE):
            # pieces share what a needle can span, and a place counts for the piece it begins in
            piece = text[base : base + PIECE + self.longest - 1].decode("latin-1")
            for end, (i, size) in self.automaton.iter(piece):
                start = end - size + 1
                if start < PIECE:
                    places = found.setdefault(i, [])
                    if len(places) < most:
                        places.append(base + start)
        return found


SCAN_SCHEMA = "path string, size long, dl long, needle long, places array<long>"


def scan_task(needles: list[tuple[int, str, bytes]], most: int):
    """(path, text) to a row for the file (needle null, with its size and number of terms) and one for each needle it holds."""
    by_mode = {mode: [(k, n) for k, m, n in needles if m == mode] for mode in (TEXT, FOLDED, NAME, WORD)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {mode: Finder([n for _, n in by_mode[mode]]) for mode in (TEXT, FOLDED, NAME)}
        asked = {n: k for k, n in by_mode[WORD]}
        for batch in batches:
            rows, held = [], 0
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = text.lower()
                terms = {t for t in TERM.findall(low) if len(t) <= 64}
                rows.append((path, len(text), len(terms), None, None))
                hay = {TEXT: text, FOLDED: low, NAME: path.encode().lower()}
                for mode, finder in finders.items():
                    if finder.needles:
                        for i, places in finder(hay[mode], 1 if mode == NAME else most).items():
                            rows.append((path, len(text), len(terms), by_mode[mode][i][0], [0] if mode == NAME else places))
                            held += len(places)
                rows += [(path, len(text), len(terms), asked[t], []) for t in (terms & asked.keys() if len(terms) < len(asked) else asked.keys() & terms)]
                if held > 1 << 18:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    return task


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], ["path", "size", "dl", "needle", "places"])


def scan(files: DataFrame, needles: list[tuple[int, str, bytes]], most: int, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files (path, units, size, dl), hits (path, needle, places)) of files (path, text), staged; needles: (number, mode, bytes).

    Modes: text as it is, folded, in the file's name, as a whole term. A hit has its first `most` places; those of names and
    terms have none of their own. Paths must be distinct.
    """
    slices, held = [[]], 0
    for needle in needles:
        if held and held + len(needle[2]) > slice_bytes:
            slices.append([])
            held = 0
        slices[-1].append(needle)
        held += len(needle[2])
    rows = files.select("path", F.col("text").cast("binary").alias("text"))
    found = [staged(rows.mapInArrow(scan_task(part, most), SCAN_SCHEMA), "scan") for part in slices]
    every = found[0].filter("needle is not null")
    for part in found[1:]:
        every = every.unionByName(part.filter("needle is not null"))
    return found[0].filter("needle is null").select("path", path_units(F.col("path")).alias("units"), "size", "dl"), every.select("path", "needle", "places")


def first_rows(rows: DataFrame, keys: list[str], order: list, most: int, as_: str, spread: int = 64) -> DataFrame:
    """The first `most` rows of each key by order, with their place. Each of `spread` parts of a key is cut before they meet."""
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if rows.schema[c].dataType.typeName() != "array"]), F.lit(spread)).alias("_part")
    cut = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).filter(F.col("_n") <= most).drop("_part", "_n")
    return cut.withColumn(as_, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(as_) <= most)


def query_terms(query: Column) -> Column:
    return F.array_distinct(words(query))


SEARCH = ["kind", "query"]
METHODS = {"filename": "filename_search", "literal": "literal_search", "lexical": "lexical_search"}


def needles_of(searches: DataFrame) -> DataFrame:
    """(kind, query, ord, mode, needle): what is looked for. A lexical search asks for whole terms, and shows their places in any word."""
    texts = F.when(F.col("kind") == "lexical", query_terms(F.col("query"))).otherwise(F.array("query"))
    modes = F.when(F.col("kind") == "lexical", F.array(F.lit(FOLDED), F.lit(WORD))).when(F.col("kind") == "filename", F.array(F.lit(NAME))).otherwise(F.array(F.lit(TEXT)))
    each = searches.select(*SEARCH, modes.alias("modes"), F.posexplode(texts).alias("ord", "needle"))
    low = F.translate("needle", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return each.select(*SEARCH, F.col("ord").cast("long").alias("ord"), F.explode("modes").alias("mode"), "needle").withColumn("needle", F.when(F.col("mode") == TEXT, F.col("needle")).otherwise(low))


def run(files: DataFrame, searches: DataFrame, within: DataFrame, matches: int, most_files: int, excerpt_bytes: int, memory_bytes: int, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(matches, states) of many searches at once, over all files and, for within (kind, query, path), over one file each.

    searches (kind, query), distinct: filename, literal or lexical. matches: (kind, query, within, n, path, start, end, size,
    excerpt_start, excerpt_end), within null for a search of all files, n their order. states: (kind, query, within, found,
    reason), a row for each search, reason null where nothing was cut off. The files are read once. A search over all files
    takes candidates by path, a lexical one those that hold all its terms, best first; matches then go by candidate, needle
    and place.
    """
    wanted = staged(needles_of(searches), "needles")
    distinct = [(r["mode"], r["needle"]) for r in wanted.select("mode", "needle").distinct().orderBy("mode", "needle").toLocalIterator()]
    numbers = searches.sparkSession.createDataFrame([(k, mode, needle) for k, (mode, needle) in enumerate(distinct)], "number long, mode string, needle string")
    numbered = wanted.join(numbers, ["mode", "needle"]).select(*SEARCH, "ord", "mode", "number", F.octet_length("needle").cast("long").alias("width"))
    table, hits = scan(files, [(k, mode, needle.encode()) for k, (mode, needle) in enumerate(distinct)], matches + 1, slice_bytes)
    table, hits = table.alias("table"), hits.withColumnRenamed("needle", "number")
    shown = numbered.filter(F.col("mode") != WORD)

    # candidates of searches over all files
    plain = shown.filter("kind <> 'lexical'").join(hits.select("number", "path"), "number").join(table.select("path", "units"), "path").select(*SEARCH, "path", F.lit(0.0).alias("score"), "units")
    terms = numbered.filter(F.col("mode") == WORD)
    held = terms.join(hits.select("number", "path"), "number")
    stats = table.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = held.select("number", "path").distinct().groupBy("number").agg(F.count("*").alias("df"))
    weight = F.greatest(F.log((F.col("n") - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5)), F.lit(1e-6))
    idf = terms.join(df, "number", "left").crossJoin(F.broadcast(stats)).groupBy(*SEARCH).agg(F.sum(weight).alias("idf"), F.count("*").alias("asked"), F.first("avgdl").alias("avgdl"))
    full = held.groupBy(*SEARCH, "path").agg(F.count("*").alias("have")).join(idf, SEARCH).filter("have = asked")
    score = F.round(-F.col("idf") * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * F.col("dl") / F.col("avgdl"))), 9)
    ranked = full.join(table.select("path", "units", "dl"), "path").select(*SEARCH, "path", score.alias("score"), "units")
    candidates = staged(plain.unionByName(ranked), "candidates")
    counted = candidates.groupBy(*SEARCH).agg(F.count("*").alias("candidates"))
    # each candidate has a match, so candidates past the limit of matches show nothing
    first = first_rows(candidates, SEARCH, ["score", "units"], min(most_files, matches + 1), "rank").select(*SEARCH, F.lit(None).cast("string").alias("within"), "path", "rank")
    narrow = within.join(shown.select(*SEARCH).distinct(), SEARCH, "left_semi").select(*SEARCH, F.col("path").alias("within"), "path", F.lit(1).cast("long").alias("rank")).distinct()
    chosen = first.unionByName(narrow)

    key = [*SEARCH, "within"]
    found = chosen.join(shown.select(*SEARCH, "ord", "number", "width"), SEARCH).join(hits, ["path", "number"]).join(table.select("path", "size"), "path")
    before = F.sum(F.size("places")).over(Window.partitionBy(*key).orderBy("rank", "ord")) - F.size("places")
    some = found.withColumn("_before", before).filter(F.col("_before") <= matches)
    each = some.select(*key, "rank", "ord", "path", "size", "width", F.explode("places").alias("start"))
    each = each.withColumn("end", F.when(F.col("kind") == "filename", F.col("start")).otherwise(F.col("start") + F.col("width")))
    left, right = excerpt_bounds(F.col("size"), F.col("start"), F.col("end"), excerpt_bytes)
    zero = F.lit(0).cast("long")
    is_name = F.col("kind") == "filename"
    each = each.withColumns({"excerpt_start": F.when(is_name, zero).otherwise(left), "excerpt_end": F.when(is_name, zero).otherwise(right)})
    line = Window.partitionBy(*key).orderBy("rank", "ord", "start")
    # memory before a match: all files up to its own, and the excerpts before
    sizes = chosen.join(table.select("path", "size"), "path").withColumn("files_to", F.sum("size").over(Window.partitionBy(*key).orderBy("rank"))).select(*(F.col(c).alias(f"k_{c}") for c in key), F.col("rank").alias("k_rank"), "files_to")
    same = F.lit(True)
    for c in (*key, "rank"):
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    run_ = each.withColumns({"n": F.row_number().over(line).cast("long"), "excerpts": F.sum(F.col("excerpt_end") - F.col("excerpt_start")).over(line)}).filter(F.col("n") <= matches + 1).join(sizes, same)
    heavy = F.when(is_name, F.lit(False)).otherwise((F.col("files_to") + F.col("excerpts")) > memory_bytes)
    stop = F.min(F.when(heavy, F.col("n"))).over(Window.partitionBy(*key))
    judged = staged(run_.withColumns({"heavy": heavy, "stop": stop}), "judged-matches")
    kept = judged.filter((F.col("n") <= matches) & (F.col("stop").isNull() | (F.col("n") < F.col("stop")))).select(*key, "n", "path", "start", "end", "size", "excerpt_start", "excerpt_end")
    more = judged.groupBy(*key).agg(F.max("n").alias("last"), F.count_if(F.col("heavy") & (F.col("n") <= matches)).alias("heavy"), F.min("stop").alias("stop"))
    every = searches.select(*SEARCH, F.lit(None).cast("string").alias("within")).unionByName(narrow.select(*key))
    on = lambda a, b: a["kind"].eqNullSafe(b["kind"]) & a["query"].eqNullSafe(b["query"]) & a["within"].eqNullSafe(b["within"])
    joined = every.join(more, on(every, more), "left").select(every["kind"], every["query"], every["within"], "last", "heavy", "stop").join(counted, SEARCH, "left")
    whole = F.col("within").isNull()
    why = F.array_compact(F.array(F.when(whole & (F.col("candidates") > most_files), "file_limit"), F.when(F.col("heavy") > 0, "memory_limit").when(F.col("last") > matches, "match_limit")))
    # least passes over nulls: a search without matches has no last one
    found_any = F.when(F.col("last").isNull(), 0).otherwise(F.least(F.col("last"), F.lit(matches), F.col("stop") - 1))
    return kept, joined.select(*key, found_any.cast("long").alias("found"), F.explode_outer(why).alias("reason"))
