"""Quality classification by a regularised quadratic discriminant.

A text becomes a vector of statistics, made even by transformation: logarithms of counts, arc sines of roots of shares. Counts,
sums and products of the vectors of all labelled training rows are gathered for each class, so the fit has no sample bound. A
class's covariance shrinks to the pooled one by POOLED and to a multiple of the identity by ROUND. The score is the logistic
function of the difference of the two log densities, each a Mahalanobis distance through a Cholesky factor that is worked out
once, and of the classes' log shares.

Null text counts as empty; an empty text has a vector and a score like any other. Texts are used whole, a long one in pieces cut at
blanks. Rows without an id are scored and never learned from. Labels other than 0 and 1, null ones too, are not learned from; an
id with several labels, or several rows, counts with each of them. Repeated rows are scored alike. Without labelled rows every score is
0.5; with rows of one class alone, every score is that class. A score of 0.5 is predicted as 1. An empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import small_batches, stage, text_of

POOLED, ROUND = 0.1, 0.02
#: Least variance of a statistic, in the units of its transformed values.
LEAST_VARIANCE = 1e-6
#: Bytes of a text that are split at a time.
PIECE = 1 << 22


def members(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), list(chars.encode()))


UPPER, DIGIT, LINE = members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), members("0123456789"), members("\n")
STOP, MARK = members(".,;:?'\"-()"), members("!#$%&*+/<=>@[\\]^_`{|}~")
BLANK, CONTINUED = members(" \t\n\x0b\x0c\r"), (np.arange(256) & 0xC0) == 0x80

NAMES = ("chars", "words", "lines", "word_chars", "line_chars", "upper", "digits", "stops", "marks", "blanks", "new_words", "top_word", "echoes", "bare_marks", "new_lines", "top_line", "word_entropy", "byte_entropy")
SIZE = len(NAMES)


def pieces(text: bytes, blank: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut before a blank."""
    at = 0
    while len(text) - at > PIECE and (end := text.find(blank, at + PIECE)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


def entropy(counts: np.ndarray) -> float:
    """Bits of a draw from counts."""
    total = counts.sum()
    if not total:
        return 0.0
    share = counts[counts > 0] / total
    return float(-(share * np.log2(share)).sum())


def share(part: float, whole: float) -> float:
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def counted(text: bytes, blank: bytes, split) -> tuple[Counter, int, int, int]:
    """What split gives: counts, total, how many equal the one before, how many hold neither letter nor digit."""
    counts, total, echoes, last = Counter(), 0, 0, None
    for piece in pieces(text, blank):
        found = split(piece)
        counts.update(found)
        total += len(found)
        echoes += sum(map(eq, found, found[1:])) + bool(found and found[0] == last)
        last = found[-1] if found else last
    return counts, total, echoes, sum(n for x, n in counts.items() if len(x) < 4 and not any(c > 127 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 for c in x))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    seen = np.zeros(256, np.int64)
    for at in range(0, len(text), PIECE):
        seen += np.bincount(np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at), minlength=256)
    chars = int(seen.sum() - seen[CONTINUED].sum())
    words, n_words, echoes, bare = counted(text, b" ", bytes.split)
    lines, n_lines, _, _ = counted(text, b"\n", lambda piece: [x for x in piece.split(b"\n") if x.strip()])
    solid = chars - int(seen[BLANK].sum())
    return [
        float(np.log1p(chars)),
        float(np.log1p(n_words)),
        float(np.log1p(n_lines)),
        float(np.log1p(solid / n_words)) if n_words else 0.0,
        float(np.log1p(chars / n_lines)) if n_lines else 0.0,
        share(seen[UPPER].sum(), chars),
        share(seen[DIGIT].sum(), chars),
        share(seen[STOP].sum(), chars),
        share(seen[MARK].sum(), chars),
        share(seen[BLANK].sum(), chars),
        share(len(words), n_words),
        share(max(words.values(), default=0), n_words),
        share(echoes, n_words),
        share(bare, n_words),
        share(len(lines), n_lines),
        share(max(lines.values(), default=0), n_lines),
        entropy(np.fromiter(words.values(), np.int64, len(words))),
        entropy(seen),
    ]


def statistics_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) for each document, staged: a text is read once for fitting and scoring."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"))
    return stage(rows.mapInArrow(statistics_task, "id long, x array<double>"), "statistics")


def moments_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, n0, n1) to the task's count, sums and products for each class, one number a row."""
    held = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), float).reshape(-1, SIZE)
        for k in (0, 1):
            n = np.asarray(batch.column(1 + k).to_numpy(zero_copy_only=False), float)
            held[k, 0] += n.sum()
            held[k, 1 : 1 + SIZE] += n @ x
            held[k, 1 + SIZE :] += ((x * n[:, None]).T @ x).ravel()
    k, place = np.divmod(np.arange(held.size), held.shape[1])
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(held.ravel())], ["k", "place", "v"])


@dataclass
class Model:
    """Means, inverse Cholesky factors and log densities at the means; classes without rows have none."""

    means: np.ndarray
    factors: np.ndarray
    heights: np.ndarray
    scale: np.ndarray
    present: tuple[bool, bool]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not all(self.present):
            return np.full(len(x), 0.5 if not any(self.present) else float(self.present[1]))
        log = []
        for k in (0, 1):
            z = ((x / self.scale) - self.means[k]) @ self.factors[k].T
            log.append(self.heights[k] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit_moments(held: np.ndarray, pooled: float = POOLED, round_: float = ROUND) -> Model:
    """Fit from count, sums and products of each class."""
    n = held[:, 0]
    present = (bool(n[0] > 0), bool(n[1] > 0))
    if not all(present):
        return Model(np.zeros((2, SIZE)), np.zeros((2, SIZE, SIZE)), np.zeros(2), np.ones(SIZE), present)
    means = held[:, 1 : 1 + SIZE] / n[:, None]
    products = held[:, 1 + SIZE :].reshape(2, SIZE, SIZE) / n[:, None, None]
    spread = np.stack([products[k] - np.outer(means[k], means[k]) for k in (0, 1)])
    # statistics are brought to one scale before a share of the identity is mixed in
    within = np.tensordot(n / n.sum(), spread, 1)
    scale = np.sqrt(np.maximum(np.diag(within), LEAST_VARIANCE))
    spread, within, means = spread / np.outer(scale, scale), within / np.outer(scale, scale), means / scale
    factors, heights = [], []
    for k in (0, 1):
        mixed = (1 - pooled) * spread[k] + pooled * within
        mixed = (1 - round_) * mixed + round_ * max(np.trace(mixed) / SIZE, LEAST_VARIANCE) * np.eye(SIZE)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        heights.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Model(means, np.stack(factors), np.array(heights), scale, present)


def fit(statistics: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit from all labelled rows whose id, under the name id_col, meets trainable."""
    usable = labels.filter(trainable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    # one row an id, so that repeated labels do not multiply rows
    marks = usable.groupBy(F.col(id_col).alias("id")).agg(*(F.count_if(F.col(label_col) == k).cast("double").alias(f"n{k}") for k in (0, 1)))
    rows = statistics.join(marks, "id").select("x", "n0", "n1")
    sums = rows.mapInArrow(moments_task, "k int, place int, v double").groupBy("k", "place").agg(F.sum("v").alias("v"))
    held = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for r in sums.collect():
        held[r["k"], r["place"]] = r["v"]
    return fit_moments(held)


def score_task(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(np.array(batch.column(1).to_pylist(), float).reshape(-1, SIZE))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    return task


def classify(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, score, predicted. trainable: which ids of labels may be learned from."""
    found = document_statistics(docs, id_col, text_col)
    model = fit(found, labels, trainable, id_col, label_col)
    scored = found.mapInArrow(score_task(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
