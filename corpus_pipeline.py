"""The corpus pipeline: filter, deduplicate, decontaminate and pack `documents`.

Every stage takes an empty table, and rows with a null in any column; texts are handled whole however long they are.  All but the
last return the columns that they got, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convosieve.llm import contamination, jaccard, packing, quality_rules, repeats
from convosieve.llm.common import stored, table
from convosieve.llm.queries import tokenizer_file


def filter_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules or the divergence from every language reject go; null and empty texts with them.  Repeated rows
    all stay or all go."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 stays, the least by id; rows without words stay too."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut out of the texts; a document of which no word is left goes.  The document
    with the least id has the first copy."""
    return repeats.cut(docs, length=50)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with benchmark passages on a twentieth of their words or more go.  Null texts have no words and stay."""
    return contamination.clean(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the documents in windows of 1024 ids; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), size=1024, end_id=0)


STAGES = [
    ("quality rules", filter_quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", decontaminate), ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
