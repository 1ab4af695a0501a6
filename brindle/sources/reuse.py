"""Reads of a request that need not be made again: what was read is kept by path, length and time, up to a size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a request keeps. What would pass them is not kept, and nothing that is kept goes for it.
KEPT_BYTES = 64 << 20

SCHEMA = "request string, ord long, path string, hit boolean, retained long, bound_reached boolean"


class Kept:
    """What one request has read so far."""

    def __init__(self, most: int):
        self.most, self.entries, self.retained, self.bound = most, {}, 0, False

    def read(self, path: str, size: int, modified: int) -> bool:
        """Whether the file is at hand, looking as it did; else it is read, and kept if it fits."""
        if self.entries.get(path) == (size, modified):
            return True
        if self.retained + size > self.most:
            self.bound = True
        else:
            self.retained += size
            self.entries[path] = (size, modified)
        return False


def reads_task(most: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for batch in batches:
            out = []
            for request, at, path, size, modified in zip(*(c.to_pylist() for c in batch.columns)):
                if kept is None or request != now:
                    now, kept = request, Kept(most)
                hit = kept.read(path, size, modified)
                out.append((request, at, path, hit, kept.retained, kept.bound))
            types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], ["request", "ord", "path", "hit", "retained", "bound_reached"])

    return task


def reused(reads: DataFrame, most: int = KEPT_BYTES) -> DataFrame:
    """reads (request, ord, path, size, modified) in order, with whether each was a hit, the bytes kept, and whether the bound was met.

    Requests share nothing; a request's reads pass one task in order, which holds the names of what is kept.
    """
    rows = reads.select("request", "ord", "path", "size", "modified").repartition("request").sortWithinPartitions("request", "ord")
    return rows.mapInArrow(reads_task(most), SCHEMA)
