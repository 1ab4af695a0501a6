"""Token counts through a digest cache.

Documents are joined by (content digest, tokenizer-version digest) to stored counts. Only distinct misses are encoded,
and their counts are appended to the cache, so a later run encodes new content only. The cache is a Parquet folder of
(tokenizer, content, n_tokens) rows; rows written twice after a retried append are harmless.

Content is what the tokenizer's own normaliser makes of a text, so texts that it makes equal are one content, counted once.
A text with an added token's string in it is its own content, as such strings are looked for before the normaliser.

Nulls count as empty text (no token). Texts are counted whole. Repeated rows each get a row, also where they tie in all
columns. A hot content, which may be a third of the corpus, is encoded once and its count is broadcast. An empty table
gives an empty result and leaves the cache as it was. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from brindle.llm.common import BROADCAST_ROWS, discard, fresh_path, join_by_class, small_batches, stage, text_of

CACHE_SCHEMA = StructType([StructField("tokenizer", BinaryType()), StructField("content", BinaryType()), StructField("n_tokens", LongType())])

#: Words in a worker's table of counts; beyond that the table is set aside for a new one, and words that come again are taken from it.
WORD_TABLE = 300_000


def tokenizer_digest(path: str) -> bytes:
    """The tokenizer version: SHA-256 of its file and of how it is used."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0no added tokens\0" + os.path.basename(path).encode()).digest()


class Counter:
    """Counts as the library gives them. word_local: the tokenizer never joins text across ASCII white space."""

    def __init__(self, path: str, word_local: bool):
        self.word_local, self.words, self.aside, self.special = word_local, {}, {}, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.normal = model.normalize
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.normal = model.normalizer.normalize_str if model.normalizer else str
            if added := [t.content for t in model.get_added_tokens_decoder().values()]:
                self.special = re.compile("|".join(map(re.escape, added)))

    def content(self, text: str) -> bytes:
        """Digest of what the count depends on: the text as the tokenizer's normaliser makes it.

        Where words count apart, the white space between them does not matter. Latin-1 is then lower-cased here, as it has
        no character whose composition or case would depend on others.
        """
        if self.word_local:
            try:
                text.encode("latin-1")
                normal = text.lower()
            except UnicodeEncodeError:
                normal = self.normal(text)
            kept = b" ".join(normal.encode("utf-8", "surrogatepass").split())
        else:
            normal = self.normal(text)
            kept = normal.encode("utf-8", "surrogatepass")
        if self.special and (self.special.search(text) or self.special.search(normal)):
            return hashlib.sha256(b"\1" + text.encode("utf-8", "surrogatepass")).digest()
        return hashlib.sha256(b"\0" + kept).digest()

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.word_local:
            return self.lengths(texts)
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.words) > WORD_TABLE:
            self.words, self.aside = {}, self.words
        known, aside = self.words, self.aside
        if new := list({w for ws in split for w in ws if w not in known}):
            known.update((w, aside[w]) for w in new if w in aside)
            new = [w for w in new if w not in aside]
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                known.update(zip(part, self.lengths([w.decode("utf-8", "surrogatepass") for w in part])))
        return [sum(map(known.__getitem__, ws)) for ws in split]


def is_word_local(path: str) -> bool:
    """Whether the tokenizer's own rules drop white space before it splits, so that words count apart."""
    import json

    if not path.endswith(".json"):
        return False
    with open(path) as f:
        rules = json.load(f)
    normal = (rules.get("normalizer") or {}).get("normalizers", [])
    spaced = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": "\\s+"} and normal[1]["content"] == " "
    splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    dropped = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and "[^\\s" in s["pattern"].get("Regex", "") for s in splits)
    return spaced and dropped and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in rules.get("added_tokens", []))


def digest_task(path: str):
    """(id, h, text) to (id, h, n_bytes, content)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path, is_word_local(path))
        for batch in batches:
            texts = batch.column(2)
            content = pa.array([count.content(t) for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.binary_length(texts).cast(pa.int64()), content], ["id", "h", "n_bytes", "content"])

    return task


def encode_task(path: str):
    """(content, text) to (content, n_tokens)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path, is_word_local(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

    return task


def read_cache(spark: SparkSession, cache: str, tokenizer: bytes) -> DataFrame:
    """Stored counts of one tokenizer version; empty where there is no cache yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == F.lit(tokenizer))
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens. cache: folder of stored counts; without one, a fresh cache in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_digest(tokenizer_path)
    cache = cache or fresh_path(spark, "token-counts")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = stage(texts.mapInArrow(digest_task(tokenizer_path), f"id {kind}, h long, n_bytes long, content binary"), "contents")
    # one row of each content is encoded; equal rows of that id and text are told by their number
    same = rows.groupBy("content", "id", "h").agg(F.count("*").alias("n"))
    classes = stage(same.groupBy("content").agg(F.min(F.struct("id", "h", "n")).alias("rep"), F.sum("n").alias("size")), "content-classes")

    misses = classes.join(read_cache(spark, cache, version), "content", "left_anti")
    wanted = stage(misses.select(F.col("rep.id").alias("i"), F.col("rep.h").alias("k"), "content", (F.col("rep.n") > 1).alias("again")), "misses")
    table = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    found = texts.join(table, texts["id"].eqNullSafe(F.col("i")) & (texts["h"] == F.col("k"))).select("content", "text", "again")
    once = found.filter("not again").select("content", "text")
    if not wanted.filter("again").isEmpty():
        once = once.unionByName(found.filter("again").select("content", "text").dropDuplicates(["content"]))
    coded = once.mapInArrow(encode_task(tokenizer_path), "content binary, n_tokens long")
    coded.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)

    counts = stage(classes.select("content", "size").join(read_cache(spark, cache, version), "content"), "counts")
    discard(classes, wanted)
    return join_by_class(rows, counts, "content", "size", rows.count()).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
