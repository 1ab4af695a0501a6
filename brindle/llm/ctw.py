"""LM scoring by context-tree weighting over bytes, with a word-unigram base score beside it.

Each byte is eight binary decisions, each decision node with a context tree of its own over the DEPTH bytes before it.
A node's Krichevsky-Trofimov estimate and the product of its children are mixed half and half at every depth. The
counts are those of all training texts, so the model is a sum over the corpus: every weight follows from counts of
(DEPTH + 1)-grams, and the probability of a byte after a context depends on that gram alone.

A text is its ASCII-lower-cased bytes and a closing zero byte, after DEPTH zero bytes. A null text counts as empty.

How it scales: documents are dealt to blocks of bounded bytes. A block emits its distinct grams and words once, with
training counts; these are summed and turned into log-probabilities by joins, and each block gets back the slice it
needs and scores its documents. No table of the corpus is broadcast or collected; the totals N and V are two numbers.
Rows are dealt by id and text, so rows without an id spread. Repeated rows are scored each, and equal texts score alike.
Texts are scored whole, in pieces of bounded memory. An empty table gives an empty result; without a training text every
bit is one half. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, small_batches, stage, text_of

#: A gram of DEPTH + 1 bytes is one number, in eight bytes as a key; DEPTH is 6 at most. The README has figures of deeper contexts.
DEPTH = 4
KEY_BYTES = 8
BLOCK_BYTES = 16 << 20
#: Context bytes by which grams are dealt to tasks, and grams of a deal.
SPLIT, DEAL_GRAMS = 2, 200_000
PIECE_BYTES = 1 << 20


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All (DEPTH + 1)-grams of the texts as big-endian numbers, and where each text's grams begin."""
    pad = b"\0" * DEPTH
    data = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8).astype(np.uint64)
    gram = np.zeros(len(data) - DEPTH, np.uint64)
    for back in range(DEPTH + 1):
        gram |= data[DEPTH - back : len(data) - back] << np.uint64(8 * back)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + DEPTH)[:-1])) if len(texts) else np.zeros(0, np.int64)
    return gram, starts


def text_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams that score the texts (len + 1 each, one after the other), and the offsets of each text."""
    gram, starts = stream(texts)
    counted = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(counted)))
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counted) + np.repeat(starts, counted)
    return gram[index], offsets


def pieces(texts: list[bytes]):
    """Slices of the list that hold about PIECE_BYTES each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def distinct_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for a, b in pieces(texts):
        k, n = np.unique(text_grams(texts[a:b])[0], return_counts=True)
        both, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, n)), len(both)).astype(np.int64)
        keys = both
    return keys, counts


def norm(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


KEY_FIELDS = "block long, word boolean, key binary, n long"


def block_keys(table: pa.Table) -> pa.Table:
    """The distinct words and grams of a block with their counts in its training texts."""
    texts = [norm(t) for t in table["text"].to_pylist()]
    train = table["train"].to_pylist()
    words: Counter = Counter()
    for t, learn in zip(texts, train):
        if learn:
            words.update(t.split())
    for t, learn in zip(texts, train):
        if not learn:
            for w in t.split():
                words[w] += 0
    learned, n = distinct_grams([t for t, learn in zip(texts, train) if learn])
    other = np.setdiff1d(distinct_grams([t for t, learn in zip(texts, train) if not learn])[0], learned)
    grams = np.concatenate((learned, other)).astype(">u8").tobytes()
    fixed = pa.Array.from_buffers(pa.binary(KEY_BYTES), len(grams) // KEY_BYTES, [None, pa.py_buffer(grams)])
    keys = pa.concat_arrays([pa.array(list(words), pa.binary()), fixed.cast(pa.binary())])
    counts = np.concatenate((np.fromiter(words.values(), np.int64, len(words)), n, np.zeros(len(other), np.int64)))
    block = pa.array(np.full(len(counts), table["block"][0].as_py()), pa.int64())
    return pa.table({"block": block, "word": pa.array(np.arange(len(counts)) < len(words)), "key": keys, "n": pa.array(counts.astype(np.int64))})


def log_gamma(x, log):
    """ln Gamma for x >= 1/2 by Stirling's series after a shift of eight; log: of columns or of arrays."""
    shift = x
    for i in range(1, 8):
        shift = shift * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(shift)


def weigh(zeros, ones, log):
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


class Subtrees:
    """The nodes of depths SPLIT to DEPTH above some grams, deepest first: all grams that end on the same SPLIT context bytes.

    A node is its context, shifted by a byte, and its place j among a byte's decisions (a leading one and the bits before).
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        k = np.arange(8, dtype=np.uint64)
        byte = (gram & np.uint64(255))[:, None]
        j = (np.uint64(1) << k) | (byte >> (np.uint64(8) - k))
        self.bit = ((byte >> (np.uint64(7) - k)) & np.uint64(1)).ravel().astype(bool)
        node, self.at = np.unique(((gram >> np.uint64(8) << np.uint64(8))[:, None] | j).ravel(), return_inverse=True)
        every = np.repeat(n, 8).astype(np.float64)
        ones = np.bincount(self.at, every * self.bit, len(node))
        zeros = np.bincount(self.at, every, len(node)) - ones
        weight, stop = weigh(zeros, ones, np.log), np.ones(len(node))
        self.up, self.kt, self.stop = [], [], []
        for depth in range(DEPTH - 1, SPLIT - 1, -1):
            self.kt.append((ones + 0.5) / (zeros + ones + 1))
            self.stop.append(stop)
            node, up = np.unique(node & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
            self.up.append(up)
            zeros, ones, below = (np.bincount(up, x, len(node)) for x in (zeros, ones, weight))
            own = weigh(zeros, ones, np.log)
            weight = np.logaddexp(own, below) - math.log(2)
            stop = np.exp(own - weight - math.log(2))
        self.top = (node >> np.uint64(8)).astype(np.int64), (node & np.uint64(255)).astype(np.int64), zeros, ones, weight, stop

    def bits(self, p: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Bits of each gram's byte, given for each top node what the depths so far give to a one and the weight left."""
        for up, kt, stop in zip(reversed(self.up), reversed(self.kt), reversed(self.stop)):
            p, left = p[up] + left[up] * stop * kt, left[up] * (1 - stop)
        one = p[self.at]
        return -np.log2(np.where(self.bit, one, 1 - one)).reshape(-1, 8).sum(axis=1)


def gram_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["gram"].to_numpy().astype(np.uint64), table["n"].to_numpy()


def top_nodes(table: pa.Table) -> pa.Table:
    c, j, zeros, ones, weight, stop = Subtrees(*gram_arrays(table)).top
    return pa.table({"c": c, "j": j, "z": zeros, "o": ones, "pw": weight, "stop": stop})


def subtree_bits(grams: pa.Table, path: pa.Table) -> pa.Table:
    """(gram, bits) of a deal of grams, by the way down to their top nodes."""
    if not grams.num_rows:
        return pa.table({"gram": pa.array([], pa.int64()), "bits": pa.array([], pa.float64())})
    tree = Subtrees(*gram_arrays(grams))
    key = path["c"].to_numpy() << 8 | path["j"].to_numpy()
    order = np.argsort(key)
    at = order[np.searchsorted(key[order], tree.top[0] << 8 | tree.top[1])]
    return pa.table({"gram": grams["gram"], "bits": pa.array(tree.bits(path["p"].to_numpy()[at], path["left"].to_numpy()[at]))})


def gram_bits(grams: DataFrame) -> DataFrame:
    """Staged rows (gram, bits): code length in bits of the last byte of each gram after its context.

    grams: (gram long, n long), n the training count; grams that only unlearned texts hold come with n = 0. They are dealt
    by their last SPLIT context bytes, some DEAL_GRAMS a deal; the few nodes of less depth are added up across deals.
    """
    last = F.expr(f"shiftright(gram, 8) & {(1 << 8 * SPLIT) - 1}")
    grams = stage(grams, "ctw-grams")
    deals = F.lit(max(16, math.ceil(grams.count() / DEAL_GRAMS)))
    dealt = grams.withColumn("deal", F.pmod(F.xxhash64(last), deals))
    level = stage(dealt.groupBy("deal").applyInArrow(top_nodes, "c long, j long, z double, o double, pw double, stop double"), "ctw-top")
    levels = [level]
    for depth in range(SPLIT - 1, -1, -1):
        up = levels[-1].groupBy(F.col("c").bitwiseAND((1 << 8 * depth) - 1).alias("c"), "j").agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum("pw").alias("below"))
        own = up.withColumn("pe", weigh(F.col("z"), F.col("o"), F.log))
        top = F.greatest("pe", "below")
        mixed = top + F.log(0.5 * F.exp(F.col("pe") - top) + 0.5 * F.exp(F.col("below") - top))
        levels.append(stage(own.select("c", "j", "z", "o", mixed.alias("pw"), F.exp(F.col("pe") - mixed + math.log(0.5)).alias("stop")), f"ctw-{depth}"))
    # down again: what the depths so far give to a one, and the weight left for deeper ones
    kt = (F.col("o") + 0.5) / (F.col("z") + F.col("o") + 1)
    path = levels[-1].select("c", "j", (F.col("stop") * kt).alias("p"), (1 - F.col("stop")).alias("left"))
    for depth in range(1, SPLIT + 1):
        child = levels[SPLIT - depth].select("c", "j", F.col("c").bitwiseAND((1 << 8 * (depth - 1)) - 1).alias("s"), "stop", kt.alias("kt"))
        parent = path.select(F.col("c").alias("s"), "j", "p", "left")
        path = child.join(parent, ["s", "j"]).select("c", "j", (F.col("p") + F.col("left") * F.col("stop") * F.col("kt")).alias("p"), (F.col("left") * (1 - F.col("stop"))).alias("left"))
    path = path.withColumn("deal", F.pmod(F.xxhash64("c"), deals))
    bits = stage(dealt.groupBy("deal").cogroup(path.groupBy("deal")).applyInArrow(subtree_bits, "gram long, bits double"), "ctw-bits")
    discard(grams, *levels)
    return bits


SCORE_FIELDS = "id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double"


def block_scores(total: int, types: int, ends: int):
    """Scores the texts of a block by the slice of the model it was sent."""

    def of_word(count: int) -> float:
        return math.log10((count + 0.1) / (total + 0.1 * (types + 1)))

    def score(docs: pa.Table, keys: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("id", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes", "bits_per_byte"), (pa.int64(), pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * 2, pa.int64(), pa.float64()))})
        is_word = keys["word"].to_numpy()
        value = keys["value"].to_numpy()
        words = keys["key"].filter(keys["word"]).to_pylist()
        counts = value[is_word]
        logs = dict(zip(words, np.log10((counts + 0.1) / (total + 0.1 * (types + 1))).tolist()))
        unknown = {w for w, c in zip(words, counts.tolist()) if c == 0}
        gram_keys = np.frombuffer(b"".join(keys["key"].filter(pa.array(~is_word)).to_pylist()), ">u8").astype(np.uint64)
        order = np.argsort(gram_keys)
        gram_keys, gram_bits_ = gram_keys[order], value[~is_word][order]

        texts = [norm(t) for t in docs["text"].to_pylist()]
        n_tokens, n_known, base = [], [], []
        for t in texts:
            ws = t.split()
            n_tokens.append(len(ws) + 1)
            n_known.append(len(ws) - (sum(w in unknown for w in ws) if unknown else 0) + (ends > 0))
            base.append(math.fsum(map(logs.__getitem__, ws)) + of_word(ends))
        bits = np.zeros(len(texts))
        for a, b in pieces(texts):
            grams, offsets = text_grams(texts[a:b])
            bits[a:b] = np.add.reduceat(gram_bits_[np.searchsorted(gram_keys, grams)], offsets[:-1])
        size = np.array([len(t) for t in texts], np.int64)
        return pa.table({"id": docs["id"], "train": docs["train"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(-bits * math.log10(2)), "n_bytes": pa.array(size), "bits_per_byte": pa.array(bits / (size + 1))})

    return score


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    learn: whether the model learns from a row. Scores are log10 probabilities.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count_if("train")).first()
    n_blocks = max(1, math.ceil((size[0] or 0) / block_bytes))
    ends = size[1]
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("long"))

    keys = stage(rows.groupBy("block").applyInArrow(block_keys, KEY_FIELDS), "ctw-keys")
    totals = keys.groupBy("word", "key").agg(F.sum("n").alias("n"))
    totals = stage(totals, "ctw-totals")
    words = totals.filter("word")
    sums = words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    total, types = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    grams = totals.filter("not word").select(F.conv(F.hex("key"), 16, 10).cast("long").alias("gram"), "n")
    bits = gram_bits(grams)
    values = words.select("word", "key", F.col("n").cast("double").alias("value")).unionByName(
        bits.select(F.lit(False).alias("word"), F.unhex(F.lpad(F.hex("gram"), 2 * KEY_BYTES, "0")).alias("key"), F.col("bits").alias("value"))
    )
    needed = keys.select("block", "word", "key").join(values, ["word", "key"]).select("block", "word", "key", "value")
    scored = rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(block_scores(total, types, ends), SCORE_FIELDS)
    return scored.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        "bits_per_byte",
    )
