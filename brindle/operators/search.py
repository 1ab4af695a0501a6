"""Retrieval: exact path, file name, literal and lexical search with byte-exact spans and excerpts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import ascii_lower, digest, term_set, terms
from brindle.operators.running import running
from brindle.sources.artifacts import path_units
from brindle.sources.store import staged


def exact_path(artifacts: DataFrame, path: str) -> DataFrame:
    """The artifact of that path, with an empty span at byte 0; no row is an error of the caller's."""
    return artifacts.filter(F.col("path") == path).select("path", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))


def filename(artifacts: DataFrame, query: str) -> DataFrame:
    """Artifacts whose path holds the query, A-Z and a-z alike; one empty span each."""
    hit = F.contains(ascii_lower(F.col("path")), ascii_lower(F.lit(query)))
    return artifacts.filter(hit).select("path", path_units(F.col("path")).alias("path_units"), F.lit(0).cast("long").alias("start"))


def places_task(needle: bytes, fold: bool, most: int | None, cap: int | None):
    """(path, text) to a row for each of the first `most` places of a text, overlapping ones too; with cap, excerpts of that size."""

    def places(text: bytes) -> Iterator[int]:
        hay = text.lower() if fold else text
        at, n = hay.find(needle), 0
        while at >= 0 and (most is None or n < most):
            yield at
            at, n = hay.find(needle, at + 1), n + 1

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            size = len(text)
            for start in places(text):
                end = start + len(needle)
                if cap is None:
                    yield path, start, end, size
                else:
                    left = max(start - max(cap - len(needle), 0) // 2, 0)
                    right = min(size, max(left + cap, end))
                    yield path, start, end, size, left, right, text[left:right]

    names = ["path", "start", "end", "size", "excerpt_start", "excerpt_end", "excerpt"][: 4 if cap is None else 7]
    types = [pa.string(), *[pa.int64()] * 5, pa.binary()][: len(names)] if cap is not None else [pa.string(), *[pa.int64()] * 3]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rows(batch)
            while some := list(itertools.islice(found, 8192)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)

    return task


def literal(artifacts: DataFrame, needle: str, fold: bool = False, scope: DataFrame | None = None, most: int | None = None, cap: int | None = None) -> DataFrame:
    """(path, start, end, size) of all occurrences, overlapping ones too, in time linear in the texts; no row carries its text.

    scope: paths to search. most: places of a file. cap: bytes of an excerpt; with it rows have excerpt_start, excerpt_end and
    excerpt. Texts without the needle are turned away before any leaves the engine.
    """
    if scope is not None:
        artifacts = artifacts.join(scope, "path", "left_semi")
    needle = needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if fold else needle
    hay = ascii_lower(F.col("text")) if fold else F.col("text")
    rows = artifacts.filter(F.contains(hay, F.lit(needle))).select("path", F.col("text").cast("binary").alias("text"))
    schema = "path string, start long, end long, size long" + ("" if cap is None else ", excerpt_start long, excerpt_end long, excerpt binary")
    return rows.mapInArrow(places_task(needle.encode(), fold, most, cap), schema)


def bounded(artifacts: DataFrame, needle: str, most: int, cap: int) -> DataFrame:
    """The first occurrences by (path units, start) with excerpts, and whether the limit cut any off.

    A file gives up its first most + 1 places, a partition its first most + 1 rows, before the single ordered window sees them.
    """
    keyed = literal(artifacts, needle, most=most + 1, cap=cap).withColumn("path_units", path_units(F.col("path")))
    first = keyed.orderBy("path_units", "start").limit(most + 1)
    numbered = first.withColumns({"rank": F.row_number().over(Window.orderBy("path_units", "start")).cast("long"), "total": F.count("*").over(Window.partitionBy())})
    return numbered.filter(F.col("rank") <= most).select("rank", "path", "start", "end", "excerpt_start", "excerpt_end", F.hex("excerpt").alias("excerpt"), (F.col("total") > most).alias("truncated"))


def byte_bound(rows: DataFrame, rank: str, size: F.Column, budget: int) -> DataFrame:
    """The longest prefix by rank whose sizes stay within budget."""
    return running(rows, [rank], size, "used").filter(F.col("used") <= budget)


def postings(artifacts: DataFrame) -> DataFrame:
    """(path, term): the sorted distinct terms of each artifact."""
    return artifacts.select("path", F.explode(terms(F.col("text"))).alias("term"))


def _ranked(docs: DataFrame, n_terms: int, most: int) -> DataFrame:
    """docs (path, dl, t0, t1, ...): how long each file is and which query terms it holds."""
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(f"t{i}").alias(f"n{i}") for i in range(n_terms)))
    idf = sum(F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6)) for i in range(n_terms))
    held = docs
    for i in range(n_terms):
        held = held.filter(f"t{i}")
    score = -idf * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = held.join(F.broadcast(stats), how="cross").select("path", F.col("dl").cast("long").alias("dl"), F.round(score, 9).alias("score"), path_units(F.col("path")).alias("path_units"))
    return scored.orderBy("score", "path_units").limit(most)


def bm25(artifacts: DataFrame, query: list[str], most: int) -> DataFrame:
    """Artifacts holding all query terms, best first: BM25 (k1 1.2, b 0.75) over distinct terms, negated, then path.

    A text is cut to terms once; its length and the terms it holds are stored, and the statistics are one aggregate row.
    """
    found = artifacts.select("path", term_set(F.col("text")).alias("terms")).select("path", F.size("terms").alias("dl"), *(F.array_contains("terms", t).alias(f"t{i}") for i, t in enumerate(query)))
    return _ranked(staged(found, "term-flags"), len(query), most)


def document_frequency(artifacts: DataFrame, query: list[str], within: F.Column) -> DataFrame:
    """How many artifacts hold all terms, in all and in scope."""
    flags = artifacts.select(term_set(F.col("text")).alias("terms"), within.alias("within")).select("within", *(F.array_contains("terms", t).alias(f"t{i}") for i, t in enumerate(query)))
    every = F.lit(True)
    for i in range(len(query)):
        every = every & F.col(f"t{i}")
    return flags.agg(F.count_if(every).alias("files"), F.count_if(every & F.col("within")).alias("files_in_scope"))


def evidence(spans: DataFrame, snapshot: str) -> DataFrame:
    """Adds the evidence id: one span of one content is one id, whatever its excerpt."""
    return spans.withColumn("evidence_id", digest("evidence", "content_hash", F.col("end").cast("string"), "path", F.lit(snapshot), F.col("start").cast("string")))


def expand(spans: DataFrame, before: int, after: int, most: int) -> DataFrame:
    """Excerpt bounds grown to the left first, what is left of `most` to the right."""
    if not 0 <= most <= 65536:
        raise ValueError("an expansion holds at most 65536 bytes")
    room = F.lit(most) - (F.col("end") - F.col("start"))
    left = F.least(F.lit(before).cast("long"), F.col("start"), F.greatest(room, F.lit(0)))
    right = F.least(F.lit(after).cast("long"), F.col("size") - F.col("end"), F.greatest(room - left, F.lit(0)))
    return spans.withColumns({"from": F.col("start") - left, "to": F.col("end") + right})


