"""Bounded-space online packing: a fixed number of open windows per partition, best fit, the fullest goes when none fits.

A document is cut after every `size` ids; only its last piece has to find a place.  What is still open at a partition's end is
merged by the same rule over whole windows, `MERGED` partitions to a task, and closed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import arrow_schema, batch, pairs, per_process, sliced, stored
from convosieve.llm.subwords import ByteEncoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean, ids binary"
MERGE = "window long, sequence_id long, base long"
#: Partitions whose open windows one task merges.
MERGED = 64


class OpenWindows:
    """At most `limit` windows, found by the room left.  `put` returns (window, offset) and the window that had to close, if any."""

    def __init__(self, size: int, limit: int, first: int):
        self.size, self.limit, self.next = size, limit, first
        self.room: list[tuple[int, int]] = []

    def put(self, length: int) -> tuple[int, int, int | None]:
        closed, k = None, bisect_left(self.room, (length, -1))
        if k == len(self.room):
            if len(self.room) == self.limit:
                closed = self.room.pop(0)[1]
            left, window = self.size, self.new()
        else:
            left, window = self.room.pop(k)
        if left > length:
            insort(self.room, (left - length, window))
        return window, self.size - left, closed

    def new(self) -> int:
        self.next += 1
        return self.next - 1


def _pack(path: str, end_id: int, size: int, limit: int, keep_ids: bool):
    schema = arrow_schema(PIECE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = per_process(("byte encoder", path), lambda: ByteEncoder(path)), np.array([end_id], "<u4").tobytes()
        windows = OpenWindows(size, limit, TaskContext.get().partitionId() << 32)
        open_rows: dict[int, list[tuple]] = {}
        for own in sliced(batches):
            rows: list[tuple] = []
            for doc_id, text in pairs(own, "doc_id", "text"):
                ids = encoder.packed(text) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    head = (doc_id, start, length, zlib.crc32(part), total)
                    if length == size:
                        rows.append((*head, windows.new(), 0, False, part if keep_ids else None))
                        continue
                    window, offset, closed = windows.put(length)
                    open_rows.setdefault(window, []).append((*head, window, offset, False, part if keep_ids else None))
                    if offset + length == size:
                        rows += open_rows.pop(window)
                    if closed is not None:
                        rows += open_rows.pop(closed)
            if rows:
                yield batch(rows, schema)
        if open_rows:
            yield batch([(*r[:7], True, r[8]) for own in open_rows.values() for r in own], schema)

    return pack


def _merge(size: int, limit: int):
    schema = arrow_schema(MERGE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        windows = OpenWindows(size, limit, 1 << 62 | TaskContext.get().partitionId() << 32)
        for own in batches:
            yield batch([(window, *windows.put(fill)[:2]) for window, fill in pairs(own, "window", "fill")], schema)

    return merge


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, open_windows: int = 256, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the packed ids if asked for.

    A null text is empty, so its document is `end_id` alone; ids may be null or repeat, each row is packed by itself.  An empty table
    gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = stored(rows.mapInArrow(_pack(path, end_id, size, open_windows, keep_ids), PIECE))
    left = pieces.where("open")
    fills = left.groupBy("window").agg(F.sum("length").alias("fill"))
    partitions = fills.select(F.shiftright("window", 32).alias("p")).distinct().count()
    fills = fills.repartition(max(1, -(-partitions // MERGED)), "window").sortWithinPartitions(F.desc("fill"), "window")
    merged = stored(fills.mapInArrow(_merge(size, open_windows), MERGE))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    left = left.join(merged, "window").withColumn("offset", F.col("base") + F.col("offset"))
    return pieces.where("NOT open").withColumnRenamed("window", "sequence_id").select(columns).unionByName(left.select(columns))
