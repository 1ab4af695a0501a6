"""Training-order materialisation: a keyed permutation gives every sequence its global slot, and shards are written by slot.

A balanced Feistel network with cycle walking permutes [0, N) exactly, so no shuffle table and no sort by random number
is kept: anyone with the key and N can compute or invert a slot. Sequences are numbered by document id, then by place in
the document. Shard s holds slots [s * R, (s + 1) * R) as fixed-stride little-endian records, so a reader resumes at any
step by seeking to slot % R * stride in shard slot // R.

Texts are encoded by a given tokenizer, once, and its ids are written as little-endian numbers of two bytes, or of four for
vocabularies that need them. The number after the last id closes a document, and the one after that pads its last sequence.
Without a tokenizer the ids are UTF-8 bytes, one byte each, with 0xFF and 0xFE as marks; neither occurs in UTF-8.

The slots are a permutation, so ranges of slots are known without sampling: a partition is a run of whole shards, sorted by
slot and written from its first record to its last, whatever their number, in the memory of one batch. The range of all
slots is done in PASSES parts, one after the other and each half as large as the one before, so that shuffle files and the
shards written take about as much room in every part; a part that is done is in the shared folder, and a lost executor costs its own partitions only.

Null text counts as empty: one sequence that holds the closing mark alone. Repeated rows get slots of their own, however
many they are; which of them has which makes no difference. An empty table writes no shard and gives no row. A very long
document is many sequences. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import BROADCAST_ROWS, discard, fresh_path, small_batches, stage, text_of

SEQUENCE = 512
SLOTS_PER_SHARD = 4096
ROUNDS = 6
#: Parts in which the slots are shuffled and written, and shards of a partition.
PASSES, SHARDS_PER_PARTITION = 2, 16
#: Words in a worker's table of ids; beyond that the table is set aside for a new one.
WORD_TABLE = 400_000
#: New words that are encoded in one call.
WORDS_AT_ONCE = 512
BLANK = "\u2581"


class Words(dict):
    """Ids of words, written out, of a model whose pieces never go from one word to the next: words are then coded apart.

    A key is a word, or a newline with the text up to the next blank: what follows a newline has no blank before it. Words that
    are not in the table are encoded many at a time, with a blank between them: a word's ids begin at the piece that has the blank.
    A full table is set aside, and words that come again are taken from there.
    """

    def __init__(self, model, width: int):
        super().__init__()
        self.encode, self.kind, self.aside, self.new = model.encode, np.dtype(f"<u{width}"), {}, []
        self.first = np.array([model.id_to_piece(i).startswith(BLANK) for i in range(model.get_piece_size())])

    def __missing__(self, word: bytes) -> bytes | bytearray:
        out = self.aside.get(word)
        if out is None:
            # stands for the word's ids until they are known
            out = bytearray()
            self.new.append(word)
        self[word] = out
        return out

    def fill(self) -> None:
        """Encodes the words that came since the last call, and puts their ids where they are waited for."""
        width = self.kind.itemsize
        for i in range(0, len(self.new), WORDS_AT_ONCE):
            part = self.new[i : i + WORDS_AT_ONCE]
            ids = np.array(self.encode(b" ".join(part).decode()), self.kind)
            at = (np.flatnonzero(self.first[ids]) * width).tolist()
            if len(at) == len(part):
                data = ids.tobytes()
                coded = [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]
            else:
                coded = [np.array(self.encode(word.decode()), self.kind).tobytes() for word in part]
            for word, out in zip(part, coded):
                out = out[width:] if word[:1] == b"\n" else out
                self[word].extend(out)
                self[word] = out
        self.new = []

    @staticmethod
    def fit(model) -> bool:
        """Whether words are coded apart: no piece has a blank or a newline past its start, and texts are taken as they are."""
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        apart = all(BLANK not in p.lstrip(BLANK) and "\n" not in p for p in pieces)
        return apart and model.encode("\n")[:1] == model.encode("\na")[:1] and model.decode(model.encode(" \ufb01  \u2460\u0301\tx ")) == " \ufb01  \u2460\u0301\tx "

    def __call__(self, texts: list[bytes]) -> list[bytes | None]:
        """The texts' ids; None for a text with blanks that separate no words."""
        found = []
        for text in texts:
            spaced = text.replace(b"\n", b" \n")
            if not spaced or b"  " in spaced or spaced[:1] == b" " or spaced[-1:] == b" " or BLANK.encode() in text:
                found.append(None)
                continue
            if len(self) > WORD_TABLE:
                self.fill()
                self.aside = dict(self)
                self.clear()
            found.append(list(map(self.__getitem__, spaced.split(b" "))))
        self.fill()
        return [ids if ids is None else b"".join(ids) for ids in found]


class Ids:
    """Token ids of a text by the tokenizer's own library, and how they are written."""

    def __init__(self, path: str | None):
        if path is None:
            self.width, self.marks, self.words = 1, (0xFF, 0xFE), None
            return
        local = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.of, n = model.encode, model.get_piece_size()
            local = Words.fit(model)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.of, n = lambda text: model.encode(text, add_special_tokens=False).ids, 1 + max(model.get_vocab(with_added_tokens=True).values())
        self.width, self.marks = 2 if n + 1 < 1 << 16 else 4, (n, n + 1)
        self.words = Words(model, self.width) if local else None

    @property
    def close(self) -> bytes:
        return self.marks[0].to_bytes(self.width, "little")

    @property
    def pad(self) -> bytes:
        return self.marks[1].to_bytes(self.width, "little")

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        known = self.words(texts) if self.words is not None else [None] * len(texts)
        return [np.array(self.of(text.decode()), f"<u{self.width}").tobytes() if ids is None else ids for text, ids in zip(texts, known)]


def planes(data: bytes, width: int) -> bytes:
    """All first bytes of a row of numbers, then all second ones, and so on: that way they are stored in less."""
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes() if width > 1 else data


def in_order(data: np.ndarray, offset: np.ndarray, width: int) -> np.ndarray:
    """The rows of numbers that lie at these offsets as planes, put together again."""
    if width == 1:
        return data
    out = np.empty_like(data)
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist()):
        out[a:b].reshape(-1, width)[:] = data[a:b].reshape(width, -1).T
    return out


def encode_task(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([planes(x, ids.width) for x in ids(batch.column(2).to_pylist())], pa.binary())], ["id", "row", "data"])

    return task


class Permutation:
    """A keyed bijection of [0, n), and its inverse."""

    def __init__(self, n: int, key: bytes):
        self.n, self.half = n, max(1, math.ceil(max(1, (n - 1).bit_length()) / 2)) if n > 1 else 1
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(key + bytes([r]), digest_size=8).digest(), "big")) for r in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << np.uint64(self.half)) | right

    def __call__(self, index: np.ndarray, back: bool = False) -> np.ndarray:
        """Slots of indices (back: indices of slots); walks on while outside [0, n)."""
        x = self._once(np.asarray(index, np.uint64), back)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


def first_index(rows: DataFrame) -> DataFrame:
    """(id, row, base, copies) of distinct rows (id, row, n, copies): base is the sum of n before the row in the order (id, row).

    Rows are dealt to ranges; a range's start is the sum over the ranges before it, one number per range.
    """
    spark = rows.sparkSession
    ranged = stage(rows.repartitionByRange("id", "row").withColumn("part", F.spark_partition_id()), "ranges")
    starts, total = [], 0
    for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        starts.append((r["part"], total))
        total += r["n"]
    before = spark.createDataFrame(starts, "part int, start long")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("id", "row")) - F.col("n")
    out = stage(ranged.join(F.broadcast(before), "part").select("id", "row", (F.col("start") + inside).alias("base"), "copies"), "bases")
    discard(ranged)
    return out


def cut_task(permutation: Permutation, low: int, high: int, per_part: int, stride: int, close: bytes):
    """Documents to their sequences with slots in [low, high), and the partition each goes to."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bases, data = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
            width = np.int64 if pa.types.is_large_binary(data.type) else np.int32
            offset = np.frombuffer(data.buffers()[1], width)[data.offset : data.offset + len(data) + 1].astype(np.int64) if len(data) else np.zeros(1, np.int64)
            whole = memoryview(in_order(np.frombuffer(data.buffers()[2] or b"", np.uint8), offset, len(close)))
            count = np.diff(offset) // stride + 1
            of = np.repeat(np.arange(len(count)), count)
            seq = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            slot = permutation(bases[of] + seq) if len(of) else np.zeros(0, np.int64)
            here = np.flatnonzero((slot >= low) & (slot < high))
            start = offset[:-1][of] + seq * stride
            end = np.minimum(start + stride, offset[1:][of])
            last = seq == count[of] - 1
            for a in range(0, len(here), 8192):
                at = here[a : a + 8192]
                payload = [bytes(whole[i:k]) + close if z else whole[i:k] for i, k, z in zip(start[at].tolist(), end[at].tolist(), last[at].tolist())]
                part = ((slot[at] - low) // per_part).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(slot[at]), pa.array([ids[i] for i in of[at].tolist()], pa.int64()), pa.array(seq[at]), pa.array(payload, pa.binary())], ["part", "slot", "id", "seq", "payload"])

    return task


def file_system(folder: str):
    """The file system of a Spark path, by the names pyarrow knows, and the path there."""
    from pyarrow import fs

    for spark_name in ("s3a://", "s3n://"):
        if folder.startswith(spark_name):
            folder = "s3://" + folder[len(spark_name) :]
    return fs.FileSystem.from_uri(folder)


class ShardWriter:
    """Writes one shard; until it is closed, no reader sees it. A repeated task writes the same bytes again."""

    def __init__(self, folder: str, shard: int):
        from pyarrow import fs

        self.system, root = file_system(folder)
        self.shard, self.name = shard, f"{root}/shard-{shard:08d}.bin"
        # object stores show a file when it is closed, and need no name of their own for it
        self.renames = isinstance(self.system, (fs.LocalFileSystem, fs.HadoopFileSystem, fs.SubTreeFileSystem))
        self.own = f"{root}/.shard-{shard:08d}.{uuid.uuid4().hex}" if self.renames else self.name
        if self.renames:
            self.system.create_dir(root, recursive=True)
        self.out = self.system.open_output_stream(self.own)

    def close(self) -> None:
        from pyarrow import fs

        self.out.close()
        if self.renames:
            if isinstance(self.system, fs.HadoopFileSystem) and self.system.get_file_info(self.name).type != fs.FileType.NotFound:
                self.system.delete_file(self.name)  # a local rename replaces, one in HDFS does not
            self.system.move(self.own, self.name)

    def abandon(self) -> None:
        with contextlib.suppress(OSError):
            self.out.close()
            self.system.delete_file(self.own)


def write_task(folder: str, per_shard: int, stride: int, pad: bytes):
    """Writes the shards of a partition that is sorted by slot, and returns a row for each slot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        try:
            for batch in batches:
                slot = batch.column(1).to_numpy()
                shard = slot // per_shard
                payload = batch.column(4).to_pylist()
                full = [p + pad * ((stride - len(p)) // len(pad)) for p in payload]
                for a, b in zip(bounds := [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(slot)], bounds[1:]):
                    if a == b:
                        continue
                    if writer is None or writer.shard != shard[a]:
                        if writer is not None:
                            writer.close()
                        writer = ShardWriter(folder, int(shard[a]))
                    writer.out.write(b"".join(full[a:b]))
                sizes = np.array([len(p) // len(pad) for p in payload], np.int64)
                crc = pa.array([zlib.crc32(p) for p in full], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(1), pa.array(shard), pa.array((slot - shard * per_shard) * stride), pa.array(sizes), crc], MANIFEST)
            if writer is not None:
                writer.close()
                writer = None
        finally:
            if writer is not None:
                writer.abandon()

    return task


def part_bounds(n_shards: int, passes: int) -> list[int]:
    """First shards of the parts, and the end: each part is half as large as the one before, as the shards written lie beside its shuffle files."""
    whole = 1 << passes
    return sorted({n_shards * (whole - (whole >> k)) // (whole - 1) for k in range(passes + 1)})


#: Spark deletes a query's shuffle files when the query ends, not when the JVM next collects what refers to them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


MANIFEST = ["id", "seq", "slot", "shard", "byte_offset", "n_tokens", "record_crc32"]


def materialise(docs: DataFrame, key: bytes, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, per_shard: int = SLOTS_PER_SHARD, tokenizer: str | None = None, passes: int = PASSES) -> DataFrame:
    """Writes the shards; returns the manifest, one row per sequence: id, seq, slot, shard, byte_offset, n_tokens, record_crc32.

    length: ids of a sequence. tokenizer: path of a vocabulary; without one the ids are UTF-8 bytes.
    """
    # one part's records are in shuffle files at a time, also where several runs share a session
    with shuffles_end_with_their_query(docs.sparkSession):
        return _materialise(docs, key, folder, id_col, text_col, length, per_shard, tokenizer, passes)


def _materialise(docs: DataFrame, key: bytes, folder: str | None, id_col: str, text_col: str, length: int, per_shard: int, tokenizer: str | None, passes: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "training-order")
    kind = Ids(tokenizer)
    stride = length * kind.width
    # rows are told apart by what they hold; equal rows share the sum of their sequences
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col), F.octet_length(text_of(text_col))).alias("row"), text_of(text_col).cast("binary").alias("data"))
    if tokenizer:
        rows = stage(rows.mapInArrow(encode_task(tokenizer), "id long, row long, data binary"), "token-ids", compression="zstd")
    else:
        rows = stage(rows, "token-ids", compression="zstd")
    n = F.expr(f"cast(octet_length(data) div {stride} + 1 as long)")
    grouped = rows.select("id", "row", n.alias("n")).groupBy("id", "row").agg(F.sum("n").alias("n"), F.count("*").alias("copies"))
    counts = stage(grouped, "sequence-counts")
    total, repeats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("copies")).first()
    indexed = first_index(counts)
    bases = indexed.toDF("i", "r", "base", "copies")
    table = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases.hint("shuffle_hash")
    placed = rows.join(table, rows["id"].eqNullSafe(F.col("i")) & (rows["row"] == F.col("r"))).select("id", "row", "base", "copies", "data")
    if (repeats or 0) > 1:
        # of equal rows one is taken, and dealt out as often as it occurs
        again = placed.filter("copies > 1").dropDuplicates(["id", "row"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        again = again.repartition("id", "row", "copy").withColumn("base", F.col("base") + F.col("copy") * n)
        placed = placed.filter("copies = 1").select("id", "base", "data").unionByName(again.select("id", "base", "data"))
    permutation = Permutation(total, key)
    n_shards = max(1, math.ceil(total / per_shard))
    bounds = part_bounds(n_shards, passes)
    out = None
    for first, end in zip(bounds, bounds[1:]):
        step = end - first
        shards_each = max(1, min(SHARDS_PER_PARTITION, step // int(spark.conf.get("spark.sql.shuffle.partitions"))))
        low, high = first * per_shard, end * per_shard
        cut = placed.select("id", "base", "data").mapInArrow(cut_task(permutation, low, high, shards_each * per_shard, stride, kind.close), "part int, slot long, id long, seq long, payload binary")
        ranges = cut.repartitionById(math.ceil(step / shards_each), F.col("part")).sortWithinPartitions("slot")
        written = ranges.mapInArrow(write_task(folder, per_shard, stride, kind.pad), "id long, seq long, slot long, shard long, byte_offset long, n_tokens long, record_crc32 long")
        done = stage(written, "manifest")
        out = done if out is None else out.unionByName(done)
    discard(rows, counts, indexed)
    return out.withColumnRenamed("id", id_col)


def read_slots(folder: str, first: int, count: int, per_shard: int = SLOTS_PER_SHARD, length: int = SEQUENCE, width: int = 1) -> Iterator[bytes]:
    """Records of slots first .. first + count - 1, read by seeking: how a training run resumes. width: bytes of an id."""
    stride = length * width
    system, root = file_system(folder)
    slot, end = first, first + count
    while slot < end:
        shard, at = divmod(slot, per_shard)
        take = min(end - slot, per_shard - at)
        with system.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(at * stride)
            data = f.read(take * stride)
        for k in range(0, len(data), stride):
            yield data[k : k + stride]
        slot += take
