"""Parquet tables of a corpus folder and the labelled / unlabelled / scored views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores evenly: text work is CPU-bound, and the tasks of a scan follow files and row groups.

    A small input, of fewer scan tasks than cores, gets one task a core.  A larger one gets three for each scan task: a few row groups,
    or one scan task more than there are cores, would else keep most cores waiting for the last.
    """
    slots, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(slots if parts < slots else 3 * parts, key)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label): harmful when flagged toxic or of low quality."""
    flag = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "TRUE").otherwise("FALSE")
    return table(spark, folder, "labels").select("doc_id", flag.alias("label"))


def train(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", *(columns or ("text",)))
    return docs.join(labels(spark, folder), "doc_id")


def test(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", *(columns or ("text",)))
    return docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


# Multiplier and offset of the derived score sources.
SCORE_PARAMS = {1: (7919, 17), 2: (104729, 31), 3: (1299709, 57), 4: (15485863, 101)}


def noise(k: int) -> Column:
    a, b = SCORE_PARAMS[k]
    return ((F.col("doc_id") * a + b) % 10007) / F.lit(10007.0)


def labelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, y, p1..p4): a derived score per source for every labelled document."""
    y = F.when(F.col("label") == "TRUE", 1).otherwise(0)
    df = labels(spark, folder).withColumn("y", y)
    return df.select("doc_id", "label", "y", *[(0.30 * F.col("y") + 0.70 * noise(k)).alias(f"p{k}") for k in SCORE_PARAMS])


def unlabelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, p1..p4): scores of the documents without a label."""
    ids = table(spark, folder, "documents").select("doc_id")
    known = table(spark, folder, "labels").select("doc_id")
    df = ids.join(known, "doc_id", "left_anti")
    return df.select("doc_id", *[noise(k).alias(f"p{k}") for k in SCORE_PARAMS])


def long_scores(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Wide p1..p4 to (doc_id, source, prob)."""
    keep = keep or []
    sources = [c for c in df.columns if c.startswith("p") and c[1:].isdigit()]
    pairs = F.explode(F.array(*[F.struct(F.lit(f"s{c[1:]}").alias("source"), F.col(c).alias("prob")) for c in sources]))
    return df.select("doc_id", *keep, pairs.alias("_p")).select("doc_id", *keep, "_p.source", "_p.prob")


def conversation_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per conversation: ordered turns and their flattened text."""
    turns = table(spark, folder, "conversations")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return grouped.select("conv_id", "turns", F.array_join(lines, "\n").alias("text"))
