"""Secret scan: three base patterns, and character Markov models for secrets that no pattern names.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples.
A run of at least LEAST_RUN key-like characters is a secret where the log-likelihood ratio of the two models, in bits,
passes a threshold in total and per character; shorter runs are not put to the models. Spans of the models are added; spans of the patterns stay as they are.

Null and empty texts have no spans. Texts are scanned whole. Repeated rows each get a row; an empty table gives an empty
result. Spans that start at one place are ordered by kind. Other columns are not looked at, whatever their names. Labels outside 0 and 1 and
null samples are ignored; a model without samples is uniform.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import small_batches, text_of

KINDS = ("assign", "access", "hex", "markov")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs shorter than the least length would be dropped anyway, and no two runs overlap.
HEX = re.compile(r"[0-9a-f]{16,}")
#: RE2 forms that hold in every text with a match; they spare most texts the search for positions.
ASSIGN_HINT = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
HEX_HINT = r"[0-9a-f]{16}"

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: The least value length of the assignment pattern, and below the 16 characters of the shortest training key: from here on
#: the models' thresholds decide.
LEAST_RUN = 12
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}+")
RUN_HINT = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN}}}"

#: Bounds of the labelled sample that the query trains from.
SAMPLE_DOCS, SAMPLE_PER_LABEL = 2000, 20_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in code points, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class LikelihoodRatio:
    """log2 of P(random) / P(identifier) by two first-order Markov models over ALPHABET, with add-a-half smoothing."""

    def __init__(self, samples: Iterable[tuple[str | None, int | None]], bits: float = 12.0, bits_per_char: float = 0.6):
        self.bits, self.bits_per_char = bits, bits_per_char
        n = len(ALPHABET)
        counts = np.full((2, n + 1, n), 0.5)
        for text, label in samples:
            if text and label in (0, 1):
                code = self.codes(text)
                np.add.at(counts[label], (np.concatenate(([n], code[:-1])), code), 1)
        logs = np.log2(counts / counts.sum(axis=2, keepdims=True))
        self.table = logs[1] - logs[0]

    @staticmethod
    def codes(text: str) -> np.ndarray:
        index = np.full(256, len(ALPHABET), np.int64)
        index[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
        code = index[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        return code[code < len(ALPHABET)]

    def score(self, text: str) -> float:
        code = self.codes(text)
        return float(self.table[np.concatenate(([len(ALPHABET)], code[:-1])), code].sum()) if len(code) else 0.0

    def is_secret(self, text: str) -> bool:
        score = self.score(text)
        return score >= self.bits and score >= self.bits_per_char * len(text)


def model_spans(text: str, model: LikelihoodRatio, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs that the models call secret and no pattern span touches."""
    return [(m.start(), 3, m.end()) for m in RUN.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base) and model.is_secret(m[0])]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_task(model: LikelihoodRatio):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            near = pc.or_(pc.or_(pc.match_substring_regex(texts, ASSIGN_HINT), pc.match_substring(texts, "AKIA")), pc.match_substring_regex(texts, HEX_HINT)).to_pylist()
            runs = pc.match_substring_regex(texts, RUN_HINT).to_pylist()
            rows = []
            for i in range(len(texts)):
                text = texts[i].as_py() if near[i] or runs[i] else ""
                base = base_spans(text) if near[i] else []
                spans = sorted(base + model_spans(text, model, base)) if runs[i] else base
                of = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*of, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return task


def scan(docs: DataFrame, model: LikelihoodRatio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, SHA-256 of the pattern spans, and all spans."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(scan_task(model), "id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def random_strings(n: int, seed: int) -> list[str]:
    """Keys as key generators make them: hex, base32, base36, base62 and base64 text of 16 to 64 characters."""
    draw = random.Random(seed)
    sets = [string.hexdigits[:16], string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"]
    return ["".join(draw.choices(draw.choice(sets), k=draw.randint(16, 64))) for _ in range(n)]


def identifiers(words: list[str], n: int, seed: int) -> list[str]:
    """Ordinary names made from words: plain, snake, kebab, camel, constant, path and numbered forms."""
    draw = random.Random(seed)
    made = list(words[:n])
    forms = [
        lambda w: "_".join(w),
        lambda w: "-".join(w),
        lambda w: "".join(x.capitalize() for x in w),
        lambda w: "_".join(w).upper(),
        lambda w: "/".join(w),
        lambda w: f"{'_'.join(w)}_{draw.randint(0, 99)}",
        lambda w: "".join(w),
        lambda w: draw.choice("=-_") * draw.randint(8, 40),
        lambda w: f"{draw.randint(1990, 2039)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}-{'-'.join(w)}",
    ]
    while words and len(made) < 2 * n:
        made.append(draw.choice(forms)(draw.choices(words, k=draw.randint(2, 5))))
    return made


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = SAMPLE_DOCS, per_label: int = SAMPLE_PER_LABEL, seed: int = 7) -> list[tuple[str, int]]:
    """A bounded labelled sample: names built from the ASCII words of at most most_docs documents (label 0), and generated keys (label 1).

    The documents are those with the smallest hashes of their ids, so the sample does not depend on partitioning.
    """
    ids = docs.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(most_docs)
    texts = docs.join(F.broadcast(ids), docs[id_col] == ids["id"], "left_semi").select(text_of(text_col).alias("text"))
    words = texts.select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("w")).filter("length(w) between 2 and 24")
    sample = words.groupBy("w").count().orderBy(F.xxhash64("w"), "w").limit(per_label).collect()
    plain = sorted(r["w"] for r in sample)
    return [(x, 0) for x in identifiers(plain, per_label, seed)] + [(x, 1) for x in random_strings(per_label, seed)]


def trained(spark: SparkSession, samples: DataFrame | Iterable[tuple[str, int]]) -> LikelihoodRatio:
    """A model from labelled rows (text, label), which the caller has bounded."""
    rows = [(r[0], r[1]) for r in samples.collect()] if isinstance(samples, DataFrame) else samples
    return LikelihoodRatio(rows)


