"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary finds the digests that may be frequent. An exact pass over these few verifies their counts and
winners, and the verified winners (HOT_SHARE at most) are broadcast, so copies of hot texts are settled map-side. The
remaining digests, each with less than one in HOT_SHARE of the rows, go through an ordinary shuffle.

Nulls count as empty text. Repeated rows (same id, same text) are copies of each other: one stays; different texts of one
id are judged apart. Rows without an id tie below all others. An empty table gives an empty result. Extra columns are not
looked at by `decide`, whatever their names, and are carried through by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import HOT_SHARE, ascii_lower, keep_rows, misra_gries, stage, text_of


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged rows (id, row, digest): row tells repeated rows apart, digest is SHA-256 of the ASCII-lower-cased text."""
    digest = F.unhex(F.sha2(ascii_lower(text_of(text_col)).cast("binary"), 256))
    return stage(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest")), "digests")


def verified_winners(rows: DataFrame, total: int) -> DataFrame:
    """The digests with at least total / HOT_SHARE rows, their exact counts and winners: HOT_SHARE rows at most."""
    k = 2 * HOT_SHARE
    candidates = misra_gries(rows, "digest", k).filter(F.col("estimate") * k >= total).select("digest")
    exact = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size"))
    return exact.filter(F.col("group_size") * HOT_SHARE >= total)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays."""
    rows = digests(docs, id_col, text_col)
    hot = F.broadcast(stage(verified_winners(rows, rows.count()), "winners"))
    in_hot = rows.join(hot, "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti").select("digest", "id", "row", F.max(F.struct("id", "row")).over(same).alias("best"), F.count("*").over(same).alias("group_size"))
    return in_hot.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = stage(decide(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.xxhash64("text_sha256").alias("h"), "kept"), "decided")
    kept = rows.groupBy("id", "h").agg(F.bool_or("kept").alias("kept"), (F.count("*") > 1).alias("again")).filter("kept")
    return keep_rows(docs, kept, id_col, F.xxhash64(F.sha2(ascii_lower(text_of(text_col)).cast("binary"), 256)))
