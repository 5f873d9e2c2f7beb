"""Incremental tagging of newly arriving documents with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from convosieve.operators.tags import heuristic_tags


def tag_batch(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Heuristic tags plus ``valid``: rows without a text are failures."""
    tagged = heuristic_tags(df, "text", df.columns)
    return tagged.withColumn("valid", F.col("text").isNotNull())


def first_seen(stream: DataFrame, id_col: str) -> DataFrame:
    """The rows of ids that the stream's state has not met yet, one per id; a null id is an id.

    Of equal ids that arrive in one batch the row with the least JSON text stays (one with a text comes before one without).  An id is
    in the state whether its tagging succeeded or not, so a failed one is not tried again.  A batch looks up its own ids only; with
    many ids, set spark.sql.streaming.stateStore.providerClass to the RocksDB provider, which keeps them out of memory.
    """
    packed = stream.select(F.col(id_col).cast("string").alias("key"), F.to_json(F.struct(*stream.columns)).alias("row"))

    def once(key, frames, state):
        rows = [frame["row"].min() for frame in frames]
        if not state.exists:
            state.update((True,))
            yield pd.DataFrame({"row": [min(rows)]})

    new = packed.groupBy("key").applyInPandasWithState(once, "row string", "met boolean", "append", GroupStateTimeout.NoTimeout)
    return new.select(F.from_json("row", stream.schema).alias("row")).select("row.*")


def tag_stream(
    spark: SparkSession, in_dir: str, out_path: str, failed_path: str, checkpoint: str, schema: str = "doc_id long, text string",
    tag: Callable[[DataFrame], DataFrame] = tag_batch, id_col: str = "doc_id", fmt: str = "json", max_files: int = 1000,
) -> StreamingQuery:
    """Process what has arrived, each id once, and stop (availableNow).

    The checkpoint has the files and, as keyed state, the ids that were met, so a batch's work does not grow with the output.  Each
    micro-batch writes into its own folder in overwrite mode: one that is repeated after a failure starts from the state before it
    and replaces its first attempt.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(in_dir)

    def write(batch: DataFrame, epoch: int) -> None:
        tagged = tag(batch).persist()
        try:
            good, bad = tagged.filter("valid").drop("valid"), tagged.filter("NOT valid").drop("valid")
            good.write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")
            bad.write.mode("overwrite").parquet(f"{failed_path}/batch={epoch}")
        finally:
            tagged.unpersist()

    return (
        first_seen(stream, id_col).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
