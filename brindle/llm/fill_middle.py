"""Fill-in-middle transformation by bit-parallel work on big integers.

A text's UTF-8 bytes are a bit vector held in one integer: `bytes.translate` turns each byte into the digit of its class, and
the digits are read as binary. Shifted boolean operations on the class masks mark the first byte of each unit, `bit_count`
gives the number of units n, and recursive halving finds the k-th marked byte. A text is cut at two units that a keyed
digest of its id picks, and its parts are written in one of two orders:

- psm: `<P>` prefix `<S>` suffix `<M>` middle
- spm: `<S>` suffix `<P>` prefix `<M>` middle

Units: line (`[^\\n]*\\n|[^\\n]+`), word (a run of bytes that are not blank with the blanks after it; blanks that lead are a unit of
their own) and char (one code point). Offsets that are given out are code points.

Null and empty texts, and texts that hold a sentinel, stay plain: the output is the text. A null id counts as empty text in the
digest. Repeated rows are transformed alike; ties of the two cuts leave an empty middle. Very long texts are taken whole, one at a
time: a mask weighs an eighth of its text. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import small_batches, text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
BLANKS = b" \t\n\x0b\x0c\r"
UNITS = ("line", "word", "char")


def digits(members: bytes) -> bytes:
    """Table for bytes.translate: digit one for members, zero for the rest."""
    return bytes(49 if b in members else 48 for b in range(256))


NEWLINE, BLANK, LEAD = digits(b"\n"), digits(BLANKS), digits(bytes(b for b in range(256) if b & 0xC0 != 0x80))
SOLID = digits(bytes(b for b in range(256) if b not in BLANKS))


def mask(reversed_text: bytes, table: bytes) -> int:
    """Bit i is set where byte i of the text belongs to the class; the text comes last byte first, as the first digit read is the highest."""
    return int(reversed_text.translate(table), 2) if reversed_text else 0


def starts(text: bytes, unit: str = "line") -> int:
    """Bit i is set where a unit starts at byte i."""
    if not text:
        return 0
    back, full = text[::-1], (1 << len(text)) - 1
    if unit == "line":
        return ((mask(back, NEWLINE) << 1) | 1) & full
    if unit == "word":
        return (mask(back, SOLID) & (mask(back, BLANK) << 1) | 1) & full
    if unit == "char":
        return mask(back, LEAD)
    raise ValueError(f"unit must be one of {UNITS}")


def select(bits: int, rank: int) -> int:
    """Place of the set bit with this rank (from 0): halves until a machine word's worth is left."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    return at


def cut_places(bits: int, size: int, ranks: tuple[int, ...]) -> list[int]:
    """The byte before which so many units lie, for each rank; the whole size where that is all of them."""
    n = bits.bit_count()
    return [size if k >= n else select(bits, k) for k in ranks]


@dataclass(frozen=True)
class Choice:
    """What the digest of an id picks."""

    seed: str = "7"
    rate: int = 100  # of a hundred texts, so many are transformed
    spm_rate: int = 50  # of a hundred of those, so many in suffix-first order

    def numbers(self, row_id: int | None) -> tuple[int, int, int, int]:
        found = hashlib.sha256(f"{self.seed}:{'' if row_id is None else row_id}".encode()).digest()
        return tuple(int.from_bytes(found[i : i + 4], "big") for i in (0, 4, 8, 12))

    def form(self, text: bytes, h3: int, h4: int) -> str:
        if not text or h3 % 100 >= self.rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return PLAIN
        return SPM if h4 % 100 < self.spm_rate else PSM


def transform(text: bytes, row_id: int | None, choice: Choice = Choice(), unit: str = "line") -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, output."""
    bits = starts(text, unit)
    n = bits.bit_count()
    h1, h2, h3, h4 = choice.numbers(row_id)
    form = choice.form(text, h3, h4)
    if form == PLAIN:
        return n, form, None, None, text
    a, b = cut_places(bits, len(text), tuple(sorted((h1 % (n + 1), h2 % (n + 1)))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    parts = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == PSM else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    return n, form, mask(prefix, LEAD).bit_count(), mask(middle, LEAD).bit_count(), b"".join(parts)


def restore(output: bytes, form: str) -> bytes:
    """The text again. No sentinel can arise across a seam, as none ends with what another starts with."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == PSM else two + middle + one


SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output {kind}"


def task_of(choice: Choice, unit: str, digest_only: bool):
    """digest_only: the output's and the restored text's SHA-256 in place of the output, so that no second copy of the corpus is moved."""

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        for row_id, text in zip(ids, texts):
            *found, output = transform(text, row_id, choice, unit)
            if digest_only:
                yield row_id, *found, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, found[1])).hexdigest()
            else:
                yield row_id, *found, output

    names = ["id", "n", "form", "prefix_chars", "middle_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names, kinds = (names + ["output_sha256", "restored_sha256"], kinds + [pa.string()] * 2) if digest_only else (names + ["output"], kinds + [pa.binary()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*rows(batch.column(0).to_pylist(), batch.column(1).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return task


def fill_in_middle(docs: DataFrame, choice: Choice = Choice(), unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(task_of(choice, unit, False), SCHEMA.format(kind="binary"))
    return found.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, choice: Choice = Choice(), unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As fill_in_middle, with output_sha256 and restored_sha256 in place of the output."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"))
    schema = SCHEMA.replace("output {kind}", "output_sha256 string, restored_sha256 string")
    return rows.mapInArrow(task_of(choice, unit, True), schema).withColumnRenamed("id", id_col)
