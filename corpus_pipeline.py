"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, sampled segmentation.

Each stage works on all that the one before kept, written as Parquet and read again. Stages return the columns of
documents; the last returns the segmentations of the documents that stayed.

Null and empty texts have no letter and go in the first stage. Rows without an id, and rows that share one, are told apart by
their texts; of repeated rows one stays. An empty table passes every stage as an empty table. Very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, exact_dedup, jaccard_join, language_id, sampled_pieces
from brindle.llm.common import remainder, stage
from brindle.llm.queries import PIECES, vocabulary

#: No SQL expresses n-gram components, template slots or sampled segmentations; tests use brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects."""
    return language_id.accept(docs, language_id.fit(docs, remainder("doc_id", 3) != 1))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word sets with similarity of 0.8 or more, the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs, size=5, num=80, den=100)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it is or re-parameterised."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what stayed: doc_id, sample, log_prob, inclusion, ids."""
    return sampled_pieces.segmentations(docs, vocabulary(PIECES))


STAGES = [
    ("language ID", languages),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_items),
    ("SentencePiece encoding and decoding", segmentation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
