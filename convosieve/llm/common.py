"""Helpers shared by the operators: stored tables, word splitting, bounded memos, crc-based folds."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: a cut of the lineage that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps (it waits for the driver's garbage collection)."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes `stored` tables whose last reader has been stored, and the shuffle files of finished steps."""
    for one in tables:
        jvm, conf = one.sparkSession._jvm, one.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(one._stored_at)
        path.getFileSystem(conf).delete(path, True)
    release(tables[0].sparkSession)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _bytes(value) -> int:
    return sys.getsizeof(value) + (sum(map(_bytes, value)) if type(value) in (tuple, list) else 0)


#: Bytes of a dict's slot, and those that one memo may hold.
SLOT, MEMO_BYTES = 100, 24 << 20
#: The same for a tokenizer's words, which are many and costly; its worker holds little else.
WORD_BYTES = 96 << 20


class Memo(dict):
    """A function's results by argument, of at most about `limit` bytes.  `trim`, called between documents, sets the results aside once
    they take half of that, in place of those set aside before; what is asked for again comes back, so frequent arguments stay."""

    def __init__(self, fn: Callable, limit: int = MEMO_BYTES):
        super().__init__()
        self.fn, self.limit, self.held, self.aside = fn, limit, 0, {}

    def __missing__(self, key):
        value = self.aside.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        self.held += sys.getsizeof(key) + _bytes(value) + SLOT
        return value

    def trim(self) -> None:
        if 2 * self.held > self.limit:
            self.aside = dict(self)
            self.clear()
            self.held = 0


def give_back() -> None:
    """Returns memory that Arrow and, with glibc, the allocator of C libraries hold without use: the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of text that a task turns into Python values at a time.
SLICE_BYTES = 2 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterable[pa.RecordBatch]:
    """The batches in parts of about SLICE_BYTES of a text column, cut without a copy; a longer text is a part of its own.  At the end
    unused memory goes back."""
    for own in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(own.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        first = 0
        while first < len(ends):
            last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_BYTES, "right"))
            yield own.slice(first, max(1, last - first))
            first = max(first + 1, last)
    give_back()


def words(text: str | None) -> list[bytes]:
    r"""UTF-8 words `[^\x20\x09-\x0D]+`: splitting bytes knows no other white space."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same of the text with A-Z lower-cased (bytes.lower leaves everything but ASCII alone)."""
    return text.encode().lower().split() if text else []


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the text `null`."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).cast("binary")) % parts


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of `name type, ...` with plain types and arrays of them."""

    def of(kind: str) -> pa.DataType:
        return pa.list_(of(kind[6:-1])) if kind.startswith("array<") else _ARROW[kind]

    return pa.schema([(name, of(kind)) for name, kind in (c.split() for c in ddl.split(", "))])


def batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pairs(batch: pa.RecordBatch, *names: str) -> Iterable[tuple]:
    """The rows of some columns of a batch as tuples of Python values."""
    return zip(*(batch.column(n).to_pylist() for n in names))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_process(key: tuple, make: Callable):
    """`make()`, kept for the later tasks of this Python worker.  The functions of this package are unpickled for each task, so it
    is kept on `sys`.  Only the last one stays: a worker that goes on to another stage drops what the one before had built."""
    kept = sys.__dict__.setdefault("_convosieve_kept", [None, None])
    if kept[0] != key:
        kept[:] = None, None
        kept[:] = key, make()
    return kept[1]
