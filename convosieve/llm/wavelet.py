"""Token ids in wavelet-matrix shards: bit-planes with rank and select, for access, counting and occurrence lookup.

A shard is one row of a Parquet table: the ids of neighbouring documents as bit-planes from the highest bit to the lowest, each
stably sorted by the bits above it.  Ranks are a counter per 512 bits plus a population count.  No other copy of the ids is kept.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convosieve.llm.common import arrow_schema, batch, pairs, per_process, shared_folder, sliced
from convosieve.llm.subwords import WordEncoder

BLOCK = 512
#: A shard is closed with the document that takes it to this many ids.
SHARD_IDS = 1 << 20

SCHEMA = "shard long, n_ids long, width int, zeros array<long>, planes binary, ranks binary, doc_ids binary, id_nulls binary, ends binary"


class WaveletMatrix:
    """The sequence of one shard.  `bits[p]` are packed bits of plane p, `ranks[p]` the ones before each block of BLOCK bits."""

    def __init__(self, n: int, width: int, zeros: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.n, self.width, self.zeros, self.bits, self.ranks = n, width, zeros, bits, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        width = max(1, int(ids.max()).bit_length()) if n else 1
        ids = ids.astype(np.uint16) if width <= 16 else ids
        blocks = n // BLOCK + 1
        bits, ranks, zeros = np.zeros((width, blocks * BLOCK // 8), np.uint8), np.zeros((width, blocks), "<u4"), []
        for p in range(width):
            ones = (ids >> (width - 1 - p) & 1).astype(bool)
            packed = np.packbits(ones)
            bits[p, : len(packed)] = packed
            ranks[p, 1:] = np.cumsum(np.bitwise_count(bits[p].reshape(blocks, -1)).sum(axis=1, dtype=np.uint32))[:-1]
            ids = np.concatenate([ids[~ones], ids[ones]])
            zeros.append(n - int(ranks[p, -1]) - int(np.bitwise_count(bits[p].reshape(blocks, -1)[-1]).sum()))
        return cls(n, width, zeros, bits, ranks)

    def rank(self, plane: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        block, rest = divmod(at, BLOCK)
        row = self.bits[plane, block * BLOCK // 8 : block * BLOCK // 8 + (rest + 7) // 8]
        return int(self.ranks[plane, block]) + int(np.unpackbits(row)[:rest].sum())

    def select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane: block by bisection, then inside the block."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        row = np.unpackbits(self.bits[plane, block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(row == bit)[k - int(before[block])])

    def access(self, at: int) -> int:
        value = 0
        for p in range(self.width):
            bit = int(np.unpackbits(self.bits[p, at // 8 : at // 8 + 1])[at % 8])
            ones = self.rank(p, at)
            at = self.zeros[p] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among positions lo to hi - 1."""
        lo, hi = self._narrow(value, lo, self.n if hi is None else hi)
        return hi - lo

    def find(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        lo, hi = self._narrow(value, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for p in reversed(range(self.width)):
            bit = value >> (self.width - 1 - p) & 1
            at = self.select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def _narrow(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> self.width:
            return 0, 0
        for p in range(self.width):
            ones_lo, ones_hi = self.rank(p, lo), self.rank(p, hi)
            if value >> (self.width - 1 - p) & 1:
                lo, hi = self.zeros[p] + ones_lo, self.zeros[p] + ones_hi
            else:
                lo, hi = lo - ones_lo, hi - ones_hi
        return lo, hi

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest to the highest."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for p in reversed(range(self.width)):
            ones = np.unpackbits(self.bits[p])[: self.n].astype(bool)
            back = np.empty_like(value)
            back[~ones], back[ones] = value[: self.zeros[p]], value[self.zeros[p] :]
            value = back | ones.astype(kind) << kind(self.width - 1 - p)
        return value.astype("<u4")

    def payload(self) -> tuple[bytes, bytes]:
        return self.bits.tobytes(), self.ranks.tobytes()

    @classmethod
    def from_row(cls, row) -> WaveletMatrix:
        """From a row of the Parquet table (a Row or a dict)."""
        width = row["width"]
        bits = np.frombuffer(row["planes"], np.uint8).reshape(width, -1)
        return cls(row["n_ids"], width, list(row["zeros"]), bits, np.frombuffer(row["ranks"], "<u4").reshape(width, -1))


def _shard_row(shard: int, docs: list[tuple[int | None, bytes]]) -> tuple:
    lengths = np.array([len(b) // 4 for _, b in docs], np.int64)
    matrix = WaveletMatrix.build(np.frombuffer(b"".join(b for _, b in docs), "<u4"))
    planes, ranks = matrix.payload()
    ids, nulls = np.array([d or 0 for d, _ in docs], "<i8"), np.array([d is None for d, _ in docs], np.uint8)
    return shard, matrix.n, matrix.width, matrix.zeros, planes, ranks, ids.tobytes(), nulls.tobytes(), np.cumsum(lengths).astype("<i8").tobytes()


def _build(path: str, end_id: int, shard_ids: int):
    schema = arrow_schema(SCHEMA)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = per_process(("word encoder", path), lambda: WordEncoder(path)), np.array([end_id], "<u4").tobytes()
        part, made, docs, size = TaskContext.get().partitionId(), 0, [], 0
        for own in sliced(batches):
            for doc_id, text in pairs(own, "doc_id", "text"):
                ids = encoder.packed(text) + end
                docs.append((doc_id, ids))
                size += len(ids) // 4
                if size >= shard_ids:
                    yield batch([_shard_row(part << 32 | made, docs)], schema)
                    made, docs, size = made + 1, [], 0
        if docs:
            yield batch([_shard_row(part << 32 | made, docs)], schema)

    return build


def write_shards(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS, part_bytes: int = 32 << 20) -> str:
    """Encodes every text, appends `end_id` and writes the shards in ascending doc_id order; returns the folder.

    A null text is empty; a null id sorts first; rows of one id keep together, in the order of their texts' hashes.  Other columns are
    not read.  Texts are dealt out by id ranges, so only small (id, hash) keys are sampled; a shard never holds more than `shard_ids`
    ids and one document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    folder = folder or f"{shared_folder(spark)}/wavelet-{uuid.uuid4().hex}"
    rows.mapInArrow(_build(path, end_id, shard_ids), SCHEMA).write.parquet(folder, compression="none")
    return folder


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def first_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, first_id): the ids before each shard, summed in two steps (shards of a partition, then partitions)."""
    sizes = shards(spark, folder).select("shard", "n_ids", F.shiftright("shard", 32).alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).orderBy("part").collect()  # one row per 32 MB of text or more
    before, sums = 0, []
    for r in parts:
        sums.append((r["part"], before))
        before += r["ids"]
    order = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = spark.createDataFrame(sums, "part long, before long")
    firsts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).join(sums, "part")
    return firsts.select("shard", (F.col("before") + F.col("inside")).alias("first_id"))


DIGESTS = "shard long, doc_id long, start long, n_tokens long, ids_crc32 long"


def _digests(schema: pa.Schema):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for row in own.to_pylist():
                ids, ends = WaveletMatrix.from_row(row).decode(), np.frombuffer(row["ends"], "<i8").tolist()
                names = [None if null else d for d, null in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["id_nulls"])]
                spans = zip(names, [0, *ends], ends)
                yield batch([(row["shard"], d, a, b - a, zlib.crc32(ids[a:b].tobytes())) for d, a, b in spans], schema)

    return digests


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
    found = shards(spark, folder).mapInArrow(_digests(arrow_schema(DIGESTS)), DIGESTS).join(first_ids(spark, folder), "shard")
    return found.select("doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
