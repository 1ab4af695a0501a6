"""Benchmark decontamination by templates.

Texts are cut to words; numbers, names and units become typed placeholders. Windows of template tokens are hashed and
joined, through a hash table of the benchmark's windows, to the windows of every document. Windows that agree are
followed along their diagonal (document place minus item place); where they cover enough of an item, the slots are
checked: one item value must stand for one document value, and windows where one stands for several do not count. Two item
values may stand for one, as new values may coincide. So a passage is found as it is (exact), and with other numbers, names
or units (re-parameterised); a text that shares only its shape is left alone.

Beside the templates, an item is found by its words alone: by any RUN of its words in a row, numbers and names included, so a
long passage counts however long the item is; and an item of fewer words, or without template windows, by all its words.
Scripts without blanks are cut to letters, and a run of theirs is BLANKLESS_RUN letters. An item without a letter, digit or
sign that WORD knows matches nothing.

Which words are names follows from one lexicon of the whole benchmark, sent as eight bytes a word and refused beyond
LEXICON_WORDS. Items are handled in slices of bounded bytes, so the table that goes to the executors has a proven size
however large the benchmark is; the slices share the lexicon, so results are equal for any size of slice. Null and empty texts and items match nothing. Items shorter than the window are one window of their whole
length, if that has enough plain words, besides their literal words. Repeated rows are judged each; items that tie are all reported. Texts are read whole. An empty table of documents
or of items gives no match. Other columns are not looked at, whatever their names; `clean` carries them through.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import small_batches, text_of

WINDOW = 8
#: Plain words a window must hold: a window of placeholders says nothing.
PLAIN = 5
#: Share of an item's windows that must agree, slots included.
COVERAGE = 0.5
#: Words, or letters of scripts without blanks, that make a match wherever they agree literally and in a row.
RUN, BLANKLESS_RUN = 13, 32
#: Bytes of benchmark text whose windows go to the executors at once.
SLICE_BYTES = 16 << 20
#: Distinct lower-case words that the benchmark may have.
LEXICON_WORDS = 1 << 24

#: Thai, Lao, Burmese, Khmer, kana and Han.
BLANKLESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
LETTER = rf"[^\W\d_{BLANKLESS}]"
WORD = re.compile(rf"\d+(?:[.,:/]\d+)*|{LETTER}+(?:['’-]{LETTER}+)*|[^\W\d_]|[.!?]+|[%°$€£]")
IS_BLANKLESS = re.compile(f"[{BLANKLESS}]")
#: Units that are replaced by a placeholder.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent "
    "meter meters metre metres kilometer kilometers gram grams kilogram kilograms degree degrees mph kmh".split()
)
SIGNS = frozenset("%°$€£")
PLAIN_KIND, NUMBER, NAME, UNIT, STOP = range(5)
#: Distinct words a worker remembers; it starts anew beyond that.
WORD_TABLE = 300_000


def words(text: str) -> list[str]:
    return WORD.findall(text)


def word_hash(low: str) -> int:
    return xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))


def lexicon_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = {w for t in batch.column(0).to_pylist() for w in words(t or "") if w.islower()}
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(word_hash, low), np.uint64, len(low)).view(np.int64))], ["h"])


def lexicon(benchmark: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the words that occur in lower case: a capital does not make a name of them."""
    small_batches(benchmark.sparkSession)
    found = benchmark.select(F.col(text_col).alias("text")).mapInArrow(lexicon_task, "h long").distinct().limit(LEXICON_WORDS + 1).toArrow()
    if found.num_rows > LEXICON_WORDS:
        raise ValueError(f"the benchmark has more than {LEXICON_WORDS} lower-case words")
    return np.sort(found.column(0).to_numpy().view(np.uint64))


class Vocabulary(dict):
    """Word to number; by number, the hash of its lower-case form and what it may be: number, name, unit, sentence end."""

    def __init__(self, plain: np.ndarray):
        super().__init__()
        self.plain = plain
        self.hashes, self.kinds = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        if n == len(self.hashes):
            self.hashes, self.kinds = np.concatenate((self.hashes, self.hashes)), np.concatenate((self.kinds, self.kinds))
        low = w.lower()
        self.hashes[n] = h = word_hash(low)
        if w[0] in ".!?":
            kind = STOP
        elif w[0].isdigit():
            kind = NUMBER
        elif w in SIGNS or low in UNITS:
            kind = UNIT
        else:
            kind = NAME if w[0].isupper() and not w.isupper() and not self.is_plain(h) else PLAIN_KIND
        self.kinds[n] = kind
        return n

    def is_plain(self, h: int) -> bool:
        at = int(self.plain.searchsorted(np.uint64(h)))
        return at < len(self.plain) and int(self.plain[at]) == h


class Template:
    """A text's words without sentence ends, the kind of slot each fills (0: none), and hashes with slots in their place."""

    def __init__(self, text: str, vocabulary: Vocabulary):
        raw = words(text)
        number = np.fromiter(map(vocabulary.__getitem__, raw), np.int64, len(raw))
        kinds = vocabulary.kinds[number]
        keep = kinds != STOP
        start = np.ones(len(raw), bool)
        start[1:] = ~keep[:-1]
        after_number = np.zeros(len(raw), bool)
        after_number[1:] = kinds[:-1] == NUMBER
        kinds = np.where((kinds == NAME) & start, PLAIN_KIND, kinds)
        kinds = np.where((kinds == UNIT) & ~after_number, PLAIN_KIND, kinds)
        self.raw, self.at = raw, np.flatnonzero(keep)
        self.kinds = kinds[keep]
        self.literal = vocabulary.hashes[number[keep]]
        self.hashes = np.where(self.kinds == PLAIN_KIND, self.literal, self.kinds.astype(np.uint64))

    def value(self, i: int) -> str:
        return self.raw[self.at[i]].lower()


class WindowHashes:
    """Hashes of all windows of any size over a row of codes: of two halves, which may overlap."""

    def __init__(self, code: np.ndarray):
        self.powers = [code]

    def __call__(self, size: int) -> np.ndarray:
        n, k = len(self.powers[0]) - size + 1, size.bit_length() - 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        while len(self.powers) <= k:
            last, step = self.powers[-1], 1 << len(self.powers) - 1
            self.powers.append(self.joined(last[:-step], last[step:]))
        half = self.powers[k]
        return half if size == 1 << k else self.joined(half[:n], half[size - (1 << k) :][:n])

    @staticmethod
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


class Keys:
    """A set of hashes; a table by their last bits turns most other hashes away before they are looked up."""

    def __init__(self, hashes):
        self.ordered = np.sort(np.fromiter(hashes, np.uint64, len(hashes)))
        self.mask = np.uint64((1 << (8 * len(hashes)).bit_length()) - 1)
        self.likely = np.zeros(int(self.mask) + 1, bool)
        self.likely[self.ordered & self.mask] = True

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in the set."""
        at = np.flatnonzero(self.likely[hashes & self.mask])
        rest = hashes[at]
        return at[self.ordered[np.minimum(self.ordered.searchsorted(rest), len(self.ordered) - 1)] == rest]


class Windows:
    """Hash tables of a slice of the benchmark: window hash to (item, place), and hash of literal words to items, by window size."""

    def __init__(self, items: list[tuple[int, str]], plain: np.ndarray):
        self.plain, self.items, self.by_size, self.literal, self.runs = plain, {}, {}, {}, {}
        vocabulary = Vocabulary(plain)
        grown: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        literal: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            template = Template(text or "", vocabulary)
            n = len(template.kinds)
            if not n:
                continue
            blankless = 2 * sum(bool(IS_BLANKLESS.match(template.value(i))) for i in range(n)) > n
            run = min(BLANKLESS_RUN if blankless else RUN, n)
            hashes = WindowHashes(template.literal)(run)
            self.runs[item] = len(hashes)
            for h in hashes.tolist():
                literal[run][h].add(item)
            size = min(WINDOW, n)
            if size < PLAIN:
                continue
            hashes = WindowHashes(template.hashes)(size)
            places = [p for p in range(len(hashes)) if (template.kinds[p : p + size] == PLAIN_KIND).sum() >= PLAIN]
            if places:
                self.items[item] = (template, size, len(places))
                for p in places:
                    grown[size][int(hashes[p])].append((item, p))
        for size, found in grown.items():
            self.by_size[size] = (Keys(found), dict(found))
        for size, found in literal.items():
            self.literal[size] = (Keys(found), dict(found))

    def matches(self, text: str, vocabulary: Vocabulary) -> list[tuple]:
        """(item, matched, windows, exact) of the items whose windows and slots agree with the text."""
        if not self.literal or not text:
            return []
        template = Template(text, vocabulary)
        of_templates, of_words = WindowHashes(template.hashes), WindowHashes(template.literal)
        runs: dict[tuple[int, int], set] = defaultdict(set)
        for size, (keys, places) in self.by_size.items():
            hashes = of_templates(size)
            for p in keys.found(hashes).tolist():
                for item, q in places[int(hashes[p])]:
                    runs[item, p - q].add(q)
        found: dict[int, list] = defaultdict(lambda: [set(), True])
        for (item, shift), places in runs.items():
            agreeing, same = self.slots_agree(item, shift, places, template)
            if agreeing:
                found[item][0] |= agreeing
                found[item][1] &= same
        out = {item: (item, len(places), self.items[item][2], exact) for item, (places, exact) in found.items() if len(places) >= math.ceil(COVERAGE * self.items[item][2])}
        copied: dict[int, set] = defaultdict(set)
        for size, (keys, holders) in self.literal.items():
            hashes = of_words(size)
            for h in set(hashes[keys.found(hashes)].tolist()):
                for item in holders[h]:
                    copied[item].add(h)
        for item, runs in copied.items():
            if item not in out:
                out[item] = (item, len(runs), self.runs[item], True)
        return [out[item] for item in sorted(out)]

    def slots_agree(self, item: int, shift: int, places: set, text: Template) -> tuple[set, bool]:
        """The places of windows without an item value that stands for several, and whether all values are the item's own."""
        mine, size, _ = self.items[item]
        values, at, same = defaultdict(set), defaultdict(list), True
        for i in sorted({p + k for p in places for k in range(size)}):
            if kind := int(mine.kinds[i]):
                a, b = (kind, mine.value(i)), (kind, text.value(i + shift))
                values[a].add(b)
                at[a].append(i)
                same &= a == b
        torn = {i for a, found in values.items() if len(found) > 1 for i in at[a]}
        return {p for p in places if torn.isdisjoint(range(p, p + size))} if torn else places, same


def slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in slices of about slice_bytes."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), text_of(text_col).alias("text")).filter("item is not null and text <> ''")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(size / slice_bytes))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield sorted((r["item"], r["text"]) for r in part.collect())


def match_task(table: Windows):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(table.plain)
        for batch in batches:
            if len(known) > WORD_TABLE:
                known = Vocabulary(table.plain)
            rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in table.matches(text, known)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.bool_()])], ["id", "item", "matched", "windows", "exact"])

    return task


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document and benchmark item it holds: id, item, matched and windows (of the item), exact.

    Where the templates don't reach their share, matched and windows count runs of literal words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    out, plain = None, lexicon(benchmark, item_text_col)
    for items in slices(benchmark, item_col, item_text_col, slice_bytes):
        part = rows.mapInArrow(match_task(Windows(items, plain)), "id long, item long, matched long, windows long, exact boolean")
        out = part if out is None else out.unionByName(part)
    return out.toDF(id_col, item_col, "matched", "windows", "exact")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    small_batches(docs.sparkSession)
    out, plain = docs, lexicon(benchmark, item_text_col)
    for items in slices(benchmark, item_col, item_text_col, slice_bytes):
        table = Windows(items, plain)

        def task(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            known = Vocabulary(table.plain)
            for batch in batches:
                if len(known) > WORD_TABLE:
                    known = Vocabulary(table.plain)
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not table.matches(t or "", known) for t in texts], pa.bool_()))

        out = out.mapInArrow(task, docs.schema)
    return out
