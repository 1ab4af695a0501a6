"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (1 to 3 letters, words marked by blanks), weighted by TF-IDF and
normalised. Each language has several centroids, found by spherical k-means over a bounded sample of its labelled
texts; a text gets the language of the nearest centroid by cosine. A text whose cosine is far below what the sample
showed at its length is rejected. At lengths below the sample's, beginnings of the sampled texts stand in; above them,
the threshold of the longest sampled length holds on.

Null text and text without a letter: language `und`, score 0, rejected. Rows without a label, or with a label but
null text, are never learned from. Texts are used whole. Repeated rows are judged alike; an empty table gives an empty
result. Other columns are not looked at; `accept` carries them through, whatever their names. Without any labelled row every text is `und` and rejected. Ties go to the
language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import small_batches

BITS = 14
DIM = 1 << BITS
#: At most so many labelled texts of each language are learned from.
PER_LANGUAGE = 256
CENTROIDS = 4
UNKNOWN = "und"
#: A text is rejected below this share of the least cosine of the sample at its length.
REJECT_SHARE = 0.5
#: Letters in the pieces a long text is counted in.
PIECE = 1 << 20


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams of a whole text, and its number of letters."""
    counts, n = np.zeros(DIM, np.int64), 0
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[code]
        found = int(is_letter.sum())
        if not found:
            continue
        n += found
        # words with one blank between them and at both ends
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        line = np.concatenate((np.zeros(1, np.uint32), np.where(is_letter, code, 0)[keep], np.zeros(1, np.uint32)))
        one, two = line * np.uint32(0x9E3779B1), line[:-1] * np.uint32(0x85EBCA6B) + line[1:] * np.uint32(0xC2B2AE35)
        three = two[:-1] * np.uint32(0x27D4EB2F) + line[2:] * np.uint32(0x165667B1)
        middle = line[1:-1] != 0
        for hashed in (one[line != 0], two[(line[:-1] != 0) | (line[1:] != 0)], three[middle]):
            hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(hashed >> np.uint32(32 - BITS), minlength=DIM)
    return counts, n


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped term frequency times idf, of unit length."""
    rows = np.log1p(counts).astype(np.float32) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def bucket(n_letters: np.ndarray | int) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(int), 24)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # least cosine to accept, by length bucket

    def predict(self, counts: np.ndarray, n_letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and rejections of a batch of texts."""
        if not self.languages:
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
        blank = n_letters == 0
        names = [UNKNOWN if b else self.languages[self.owner[k]] for b, k in zip(blank, best)]
        return names, np.where(blank, 0.0, score), blank | (score < self.least[bucket(n_letters)])


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other, so the result depends on the rows alone."""
    picked = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(picked) < min(k, len(rows)):
        picked.append(int(np.argmin((rows @ rows[picked].T).max(axis=1))))
    centres = rows[picked]
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[nearest == i].sum(axis=0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def dense(rows: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Sparse counts as rows."""
    out = np.zeros((len(rows), DIM), np.int64)
    for i, (at, n) in enumerate(rows):
        out[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    return out


def fit_vectors(sample: list[tuple[str, bytes, bytes, int]], cuts: Iterable[tuple[str, bytes, bytes, int]] = ()) -> Model:
    """Fit from (language, places, counts, letters) of sampled texts; cuts are beginnings of theirs, for thresholds of shorter texts.

    Rows are made wide for one language at a time.
    """
    sample = [x for x in sample if x[3]]
    languages = sorted({x[0] for x in sample})
    if not languages:
        return Model([], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros(25))
    held = np.zeros(DIM, np.int64)
    for _, at, _, _ in sample:
        held[np.frombuffer(at, np.uint16)] += 1
    idf = (np.log((1 + len(sample)) / (1 + held)) + 1).astype(np.float32)
    at_all = bucket(np.array([x[3] for x in sample]))
    nearest, parts = np.full(25, np.inf), []
    shorter = [x for x in cuts if x[3] and bucket(x[3]) < at_all.min()]
    for language in languages:
        own = [x for x in sample if x[0] == language]
        rows = weighted(dense([x[1:3] for x in own]), idf)
        parts.append(k_means(rows, CENTROIDS))
        np.minimum.at(nearest, bucket(np.array([x[3] for x in own])), (rows @ parts[-1].T).max(axis=1))
        brief = [x for x in shorter if x[0] == language]
        for i in range(0, len(brief), 256):
            some = brief[i : i + 256]
            np.minimum.at(nearest, bucket(np.array([x[3] for x in some])), (weighted(dense([x[1:3] for x in some]), idf) @ parts[-1].T).max(axis=1))
    nearest[at_all.max() + 1 :] = nearest[at_all.max()]
    # a shorter text may be as far as the longer of the sample
    least = REJECT_SHARE * np.maximum(np.minimum.accumulate(nearest[::-1])[::-1], 0)
    owner = np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)])
    return Model(languages, owner, np.concatenate(parts), idf, least)


def sparse(text: str) -> tuple[bytes, bytes, int]:
    """Places and numbers of the counts that are not zero, and the letters: a row of counts is too wide to keep many."""
    counts, letters = grams(text)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes(), letters


def vector_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to sparse counts of the text and of beginnings of it, each half as long as the one before."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        of, cut, found = [], [], []
        for i, text in enumerate(texts):
            for k in range(max(1, len(text).bit_length())):
                of.append(i)
                cut.append(k > 0)
                found.append(sparse(text[: len(text) >> k]))
        at, n, letters = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(cut, pa.bool_()), pa.array(at, pa.binary()), pa.array(n, pa.binary()), pa.array(letters, pa.int64())], ["lang", "cut", "at", "n", "letters"])


#: Hashes that pick the sample lie below this.
SPREAD = 1 << 40


def sample_cutoff(count: int | Column, per_language: int) -> Column:
    """The hash below which about twice the bound lies. In doubles: a product of two longs would pass their range on large tables."""
    return F.lit(float(SPREAD)) * 2 * per_language / (F.lit(count) if isinstance(count, int) else count)


def sampled(docs: DataFrame, trainable: Column, id_col: str, text_col: str, label_col: str, per_language: int) -> DataFrame:
    """(lang, text) of at most per_language labelled rows of each language: those with the smallest hashes of id and text.

    Rows that repeat both count once, so neither a repeated row nor a repeated id fills the sample or empties it.
    """
    rows = docs.filter(trainable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(label_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    keys = rows.select("lang", "id", "th", F.pmod(F.xxhash64("id", "th"), F.lit(SPREAD)).alias("h"))
    sizes = keys.groupBy("lang").agg(F.approx_count_distinct("h").alias("count"))
    # first a share of the keys that holds about twice the bound, then exactly the bound: no language meets in one task
    near = keys.join(F.broadcast(sizes), "lang").filter(F.col("h") <= sample_cutoff(F.col("count"), per_language)).select("lang", "id", "th", "h").distinct()
    picked = near.withColumn("n", F.expr("row_number() over (partition by lang order by h, id, th)")).filter(F.col("n") <= per_language).select("lang", F.col("id").alias("kid"), "th")
    same = (rows["lang"] == picked["lang"]) & rows["id"].eqNullSafe(picked["kid"]) & (rows["th"] == picked["th"])
    return rows.join(F.broadcast(picked), same, "left_semi").dropDuplicates(["lang", "id", "th"]).select("lang", "text")


def fit(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit from a sample of at most per_language labelled rows of each language."""
    small_batches(docs.sparkSession)
    texts = sampled(docs, trainable, id_col, text_col, label_col, per_language)
    found = texts.mapInArrow(vector_task, "lang string, cut boolean, at binary, n binary, letters long").collect()

    row = lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"]), r["letters"])
    sample = sorted(row(r) for r in found if not r["cut"])
    return fit_vectors(sample, [row(r) for r in found if r["cut"]])


def identify_task(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                found = [grams(t or "") for t in part.column(1).to_pylist()]
                names, score, rejected = model.predict(np.stack([c for c, _ in found]), np.array([n for _, n in found]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    return task


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (cosine), rejected."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(identify_task(model), "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns: text without a letter and text far from every language go."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                found = [grams(t or "") for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                _, _, rejected = model.predict(np.stack([c for c, _ in found]), np.array([n for _, n in found]))
                yield part.filter(pa.array(~rejected, pa.bool_()))

    return docs.mapInArrow(task, schema)
