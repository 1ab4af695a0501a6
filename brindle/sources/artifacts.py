"""Artifact tables: file trees, and the corpus views over the driver's tables."""

from __future__ import annotations

import base64
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import base64url, content_hash
from brindle.sources.store import exists, file_system, read_bytes, staged

# File endings of the corpus languages, names never scanned, and skips that make a snapshot partial.
ENDINGS = {"en": ".py", "fr": ".rs", "de": ".md", "es": ".test.ts"}
EXCLUDED = (".git", ".brindle", "target")
PARTIAL = ("oversized", "limit", "read_failed", "changed")

# Limits of a snapshot.
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES, MAX_DEPTH = 100_000, 16 << 20, 2 << 30, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): documents as the files of one workspace."""
    ending = F.lit(".txt")
    for lang, end in ENDINGS.items():
        ending = F.when(F.col("lang") == lang, end).otherwise(ending)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ending).alias("path"), "text")


ARTIFACTS_SQL = """art as (select doc_id, 'src/' || source || '/' || lang || '/doc_' || doc_id || case lang when 'en' then '.py' when 'fr' then '.rs' when 'de' then '.md' when 'es' then '.test.ts' else '.txt' end as path, text from documents)"""


def path_units(path: Column) -> Column:
    """Lossless path identity: base64url of its bytes. Results are ordered by this text."""
    return base64url(path.cast("binary"))


def snapshot(files: DataFrame, max_files: int | None = MAX_FILES, max_file_bytes: int | None = MAX_FILE_BYTES, max_total_bytes: int | None = MAX_TOTAL_BYTES, max_depth: int | None = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(artifacts, skipped) of (path, content): one of accept or skip(reason) per file, in path order.

    A file over the running total is skipped and later smaller ones may fit, so what is accepted depends on all before. Paths
    and sizes are stored in ranges of paths. A range that fits as a whole is taken as a whole; only in ranges where a bound is
    near are the files that can still fit gone through, one range at a time. Contents never leave their partitions. A limit of
    None is no limit; without limits of the whole each file is judged where it lies.
    """
    parts = F.split("path", "/")
    reason = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))), "policy_excluded")
    if max_depth is not None:
        reason = reason.when(F.size(parts) > max_depth, "limit")
    if max_file_bytes is not None:
        reason = reason.when(F.col("size") > max_file_bytes, "oversized")
    judged = files.select("path", F.octet_length("content").cast("long").alias("size"), content_hash(F.col("content")).alias("content_hash")).withColumn("reason", reason)
    if max_files is None and max_total_bytes is None:
        return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("files"))
    max_files, max_total_bytes = (math.inf if most is None else most for most in (max_files, max_total_bytes))
    ranged = staged(judged.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "snapshot")
    open_ = ranged.filter("reason is null")
    whole, singles, taken, used = [], [], 0, 0
    for r in open_.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("size").alias("least")).orderBy("part").collect():
        if taken + r["n"] <= max_files and used + r["size"] <= max_total_bytes:
            whole.append(r["part"])
            taken, used = taken + r["n"], used + r["size"]
        elif taken < max_files and used + r["least"] <= max_total_bytes:
            near = open_.filter((F.col("part") == r["part"]) & (F.col("size") <= max_total_bytes - used)).select("path", "size").orderBy("path")
            for f in near.toLocalIterator():
                if taken >= max_files:
                    break
                if used + f["size"] <= max_total_bytes:
                    singles.append((f["path"],))
                    taken, used = taken + 1, used + f["size"]
    named = F.broadcast(files.sparkSession.createDataFrame(singles, "path string").withColumn("named", F.lit(True)))
    told = ranged.join(named, "path", "left").withColumn("accepted", F.col("reason").isNull() & (F.col("part").isin(whole) | F.coalesce("named", F.lit(False))))
    skipped = told.filter("not accepted").groupBy(F.coalesce("reason", F.lit("limit")).alias("reason")).agg(F.count("*").alias("files"))
    return told.filter("accepted").select("path", "size", "content_hash"), skipped


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below root, paths relative to it."""
    fs, at = file_system(spark, root.rstrip("/"))
    whole = fs.makeQualified(at).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.when(F.col("path").startswith(whole + "/"), F.substr("path", F.lit(len(whole) + 2))).otherwise(F.col("path")).alias("path"), "content")


def completeness(skipped: DataFrame) -> DataFrame:
    return skipped.agg(F.coalesce(F.bool_or(F.col("reason").isin(*PARTIAL)), F.lit(False)).alias("partial"), F.coalesce(F.sum("files"), F.lit(0)).alias("skipped"))


def read_ledger(reads: DataFrame) -> DataFrame:
    """(reads, repeated, bytes) of (path, bytes)."""
    return reads.agg(F.count("*").alias("reads"), (F.count("*") - F.count_distinct("path")).alias("repeated"), F.sum("bytes").alias("bytes"))


def source_fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 over sorted path, NUL, hash lines, per 2-character hash bucket and then over the buckets: no task holds all paths."""
    line = F.concat_ws("\0", "path", "content_hash")
    buckets = files.withColumn("bucket", F.substring(F.sha2("path", 256), 1, 2)).groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"), F.count("*").alias("n"), F.count_distinct("path").alias("d"))
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "h"))), "\n"), 256).alias("fingerprint"), (F.sum("n") == F.sum("d")).alias("compatible"))


def is_safe(path: Column) -> Column:
    """Whether a path is relative and stays below its root: no empty, `.` or `..` step and no NUL."""
    return ~path.rlike(r"^/|^$|(^|/)\.{0,2}(/|$)|\x00")


def encode_path(path: str) -> str:
    return base64.urlsafe_b64encode(path.encode()).decode().rstrip("=")


def decode_path(units: str) -> str:
    """The path of an identity; ValueError for units that are not the only ones of their path, or of an unsafe path."""
    if not re.fullmatch(r"[A-Za-z0-9_-]*", units):
        raise ValueError("path units are base64url")
    try:
        path = base64.urlsafe_b64decode(units + "=" * (-len(units) % 4)).decode()
    except ValueError:
        raise ValueError("path units are UTF-8 bytes") from None
    if encode_path(path) != units or path.startswith("/") or "\0" in path or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError("unsafe or non-canonical path")
    return path


def revision(spark: SparkSession, root: str) -> str | None:
    """The revision that a working tree's HEAD names, by its own file or the packed ones; None where there is none."""

    def text(name: str) -> str | None:
        path = f"{root.rstrip('/')}/.git/{name}"
        return read_bytes(spark, path)[: 1 << 20].decode("utf-8", "replace") if exists(spark, path) else None

    head = (text("HEAD") or "").strip()
    if not (m := re.fullmatch(r"ref: (refs/[A-Za-z0-9._/-]+)", head)):
        return head if re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", head) else None
    if ".." in m[1]:
        return None
    loose = (text(m[1]) or "").strip()
    if re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", loose):
        return loose
    packed = re.search(rf"(?m)^([0-9a-f]{{40}}|[0-9a-f]{{64}}) {re.escape(m[1])}$", text("packed-refs") or "")
    return packed[1] if packed else None


def declared_json(text: Column, schema: str) -> Column:
    """A declaration by its schema; malformed text and names that the schema does not have raise. Numbers are read as text."""
    names = [f.split(" ")[0] for f in re.sub(r"<[^>]*>", "", schema).split(", ")]
    extra = F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, names)))) > 0
    parsed = F.from_json(text, schema, {"mode": "FAILFAST"})
    return F.when(~F.coalesce(extra, F.lit(True)), parsed).otherwise(F.raise_error(F.lit("malformed declaration")).cast(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>"))


def exact_read(files: DataFrame, wanted: DataFrame, most_bytes: int) -> DataFrame:
    """wanted (path) with content and hash; files larger than most_bytes are refused before their bytes are looked at.

    Several reads of one request may share a persisted result; it is let go with the request.
    """
    sized = wanted.select("path").distinct().join(files, "path")
    over = F.raise_error(F.concat(F.lit("too large: "), F.col("path")))
    content = F.when(F.octet_length("content") <= most_bytes, F.col("content")).otherwise(over.cast("binary"))
    return sized.select("path", content.alias("content"), content_hash(F.col("content")).alias("content_hash"))
