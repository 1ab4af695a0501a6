"""Spelling variant grouping: a trie self-join with active-node sets over a prefix-partitioned vocabulary.

Words are counted over all documents: each task counts what it reads, the counts meet by word. Two words are near if they differ
by exactly one inserted, deleted or replaced code point. Where the shorter of the two has m code points, they share either their
first m // 2 or their last m // 2. So each word is dealt, forwards and reversed, under its first half for m its own length and
for m one less; a task builds the trie of a group's remainders and passes the set of nodes at distance one down it: the set of a
child is its parent, its siblings, its children, and the steps that the parent's set can take by the child's letter. Where a
word ends, the words that end in its set are near. A task gives each word its number of near words and the best of them, so no list of
pairs is written. Groups of more than SPLIT words are walked in parts, each by a task that builds the trie and walks the
branches of its own words.

Null and empty texts have no words; a null id counts as empty text in the digest that plants the deletions. Repeated rows count
each time. Texts are used whole: a long one is cut at blanks for splitting only. Ties between near words of one count go to the
smallest in code-point order. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import BROADCAST_ROWS, discard, small_batches, stage, text_of

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A near word becomes a word's form if it occurs so many times as often.
FORM_RATIO = 5
#: One in so many (document, word) pairs loses a letter.
DELETE_ONE_IN = 199
#: Words that one task walks for a group.
SPLIT = 50_000
#: Distinct words that a task holds before it hands its counts on.
HELD = 1 << 19
#: Bytes of a text that are split at a time.
PIECE = 1 << 22

#: Latin-1 byte to lower-cased letter, or to a blank: what lies beyond Latin-1 becomes a question mark first, so a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The maximal runs of letters of a text, lower-cased, in Latin-1, some at a time."""
    line = text.encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while len(line) - at > PIECE:
        end = line.find(b" ", at + PIECE)
        if end < 0:
            break
        yield line[at:end].split()
        at = end
    yield line[at:].split()


class Tally(dict):
    """Numbers for words, counts by number, and what the digest of a document adds for each word."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self.counts = np.zeros(1024, np.int64)
        self.own = np.zeros(1024, np.uint32)  # digest without a document
        self.size = np.zeros(1024, np.int64)  # bytes of UTF-8
        self.done = 0
        self.odd: dict[str, int] = {}  # words that lost a letter

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def grow(self) -> None:
        if len(self.words) > len(self.counts):
            more = max(len(self.words), 2 * len(self.counts))
            self.counts, self.own, self.size = (np.concatenate((x, np.zeros(more - len(x), x.dtype))) for x in (self.counts, self.own, self.size))
        for i in range(self.done, len(self.words)):
            word = self.words[i].decode("latin-1").encode()
            self.size[i] = len(word)
            # crc32 is affine: crc32(word, seed) = crc32(zeros, seed) ^ crc32(zeros) ^ crc32(word)
            self.own[i] = zlib.crc32(word) ^ zlib.crc32(bytes(len(word)))
        self.done = len(self.words)

    def add(self, seed: int, found: list[bytes], least_length: int, one_in: int) -> None:
        """Counts a document's words; seed: crc32 of what comes before the word."""
        ids = np.fromiter(map(self.__getitem__, [w for w in found if len(w) >= least_length]), np.int64)
        if not len(ids):
            return
        self.grow()
        sizes = self.size[ids]
        lengths, which = np.unique(sizes, return_inverse=True)
        shifted = np.array([zlib.crc32(bytes(int(n)), seed) for n in lengths], np.uint32)
        digest = shifted[which] ^ self.own[ids]
        cut = digest % one_in == 0
        if cut.any():
            for i, h in zip(ids[cut].tolist(), digest[cut].tolist()):
                word = self.words[i].decode("latin-1")
                at = h % len(word)
                if len(word) > least_length:
                    left = word[:at] + word[at + 1 :]
                    self.odd[left] = self.odd.get(left, 0) + 1
            ids = ids[~cut]
        np.add.at(self.counts, ids, 1)

    def rows(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.counts)
        words = [self.words[i].decode("latin-1") for i in at.tolist()] + list(self.odd)
        counts = self.counts[at].tolist() + list(self.odd.values())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])


def count_task(least_length: int, one_in: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{'' if row_id is None else row_id}:".encode())
                for found in runs(text):
                    tally.add(seed, found, least_length, one_in)
                    if len(tally.words) + len(tally.odd) > HELD:
                        yield tally.rows()
                        tally = Tally()
        yield tally.rows()

    return task


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word, n) of all words of at least that length and count. A word is found with the letter that the digest takes from it gone."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    parts = rows.mapInArrow(count_task(least_length, one_in), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Trie:
    """A trie of sorted distinct words, numbered level by level, so that the children of a node are a range of numbers."""

    def __init__(self, words: list[str]):
        self.first = [1]  # children of node i: first[i] to first[i + 1]
        self.letter = [""]
        self.ends = []  # the word that ends at a node, or -1
        self.low, self.high = [0], [len(words)]  # the words below a node
        self.step: dict[tuple[int, str], int] = {}
        level, depth, node = [0], 0, 0
        while level:
            below = []
            for node in level:
                i, end = self.low[node], self.high[node]
                whole = i < end and len(words[i]) == depth
                self.ends.append(i if whole else -1)
                i += whole
                while i < end:
                    letter, start = words[i][depth], i
                    while i < end and words[i][depth] == letter:
                        i += 1
                    child = len(self.letter)
                    self.letter.append(letter)
                    self.low.append(start)
                    self.high.append(i)
                    self.step[node, letter] = child
                    below.append(child)
                self.first.append(len(self.letter))
            level, depth = below, depth + 1

    def near(self, start: int, stop: int) -> Iterator[tuple[int, list[int]]]:
        """For each word from start to stop with words at distance one: its place and theirs."""
        first, letter, ends, low, high, step = self.first, self.letter, self.ends, self.low, self.high, self.step
        get = step.get
        # depth first, so that only the sets along one path and of its siblings are held
        stack = [(0, set(range(first[0], first[1])))]
        while stack:
            node, active = stack.pop()
            at = ends[node]
            if start <= at < stop and (found := [ends[m] for m in active if ends[m] >= 0]):
                yield at, found
            children = range(first[node], first[node + 1])
            for child in children:
                if high[child] <= start or low[child] >= stop:
                    continue
                by = letter[child]
                reached = set(children)
                reached.discard(child)
                reached.update(range(first[child], first[child + 1]))
                reached.add(node)
                for m in active:
                    if (x := get((m, by))) is not None:
                        reached.add(x)
                stack.append((child, reached))


def group_near(m: int, back: bool, words: list[str], counts: list[int], part: int, parts: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of near words, count of the best, the best) within one group; words in the direction of the group, sorted."""
    half = m // 2
    trie = Trie([w[half:] for w in words])
    start, stop = part * len(words) // parts, (part + 1) * len(words) // parts
    tails = [w[: -half - 1 : -1] for w in words] if back else []
    for at, found in trie.near(start, stop):
        if len(words[at]) > m:
            # both one longer than m: met where m is their length
            found = [x for x in found if len(words[x]) == m]
        if back:
            # those that share the first half too were met forwards
            found = [x for x in found if tails[x] != tails[at]]
        if found:
            most = max(counts[x] for x in found)
            best = [words[x] for x in found if counts[x] == most]
            yield words[at][::-1] if back else words[at], len(found), most, min(x[::-1] for x in best) if back else min(best)


def join_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, back, half, part, parts, word, n), sorted by group, to (word, n_near, best_n, best)."""

    def flush(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    key, words, counts, out = None, [], [], []

    def end() -> None:
        if len(words) > 1:
            out.extend(group_near(key[0], key[1], words, counts, key[3], key[4]))

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for *now, word, n in zip(*columns):
            if now != key:
                end()
                key, words, counts = now, [], []
                if len(out) > 20_000:
                    yield flush(out)
                    out.clear()
            words.append(word)
            counts.append(n)
    end()
    yield flush(out)


def dealt(words: DataFrame, least_length: int = LEAST_LENGTH, split: int = SPLIT) -> DataFrame:
    """Each word under its first and last halves: (m, back, half, part, parts, word, n), word reversed where back."""
    size = F.length("word")
    shorter = F.array_compact(F.array(F.when(size > least_length, size - 1), size))
    rows = words.select("word", "n", F.explode(shorter).alias("m")).select("m", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "word", "n")
    rows = rows.withColumn("word", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    rows = rows.withColumn("half", F.expr("substring(word, 1, m div 2)"))
    sizes = rows.groupBy("m", "back", "half").agg(F.count("*").alias("size"))
    large = stage(sizes.filter(F.col("size") > split), "large-groups")
    if large.isEmpty():
        out = rows.withColumns({"part": F.lit(0), "parts": F.lit(1)})
    else:
        parts = large.select("m", "back", "half", F.ceil(F.col("size") / split).cast("int").alias("parts"))
        held = large.count() <= BROADCAST_ROWS
        out = rows.join(F.broadcast(parts) if held else parts, ["m", "back", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        out = out.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.select("m", "back", "half", "part", "parts", "word", "n")


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, split: int = SPLIT) -> DataFrame:
    """(word, n_near, best_n, best) for each word of (word, n) that has near words; best: the most frequent of them."""
    key = ["m", "back", "half", "part"]
    rows = dealt(words, least_length, split).repartition(*key).sortWithinPartitions(*key, "word")
    found = rows.mapInArrow(join_task, "word string, n_near long, best_n long, best string")
    # the smallest of (-n, word): most occurrences, then first in code-point order
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("top")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed from the last ones back, one staged level at a time.

    A form occurs FORM_RATIO times as often as its word, so there are no more levels than the logarithm of the largest count.
    """
    last = forms.join(forms.select(F.col("word").alias("form")), "form", "left_anti").select("word", F.col("form").alias("root"))
    level = stage(last, "roots")
    done = [level]
    while not level.isEmpty():
        level = stage(forms.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "roots")
        done.append(level)
    out = done[0]
    for level in done[1:-1]:
        out = out.unionByName(level)
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, one_in: int = DELETE_ONE_IN, split: int = SPLIT) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stage(vocabulary(docs, id_col, text_col, least_length, least_count, one_in), "vocabulary")
    near = near_words(words, least_length, split)
    is_form = F.col("best_n") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    judged = stage(judged, "judged")
    discard(words)
    ends = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
