import re

import corpus_pipeline
from convosieve.llm.common import stored


def test_stages_keep_columns_and_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.dtypes, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, data))
        left = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert docs.dtypes == columns and len(set(left)) == len(left) and set(left) <= ids
        ids = set(left)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r["doc_id"] for r in pieces} == ids


def test_stages_of_awkward_rows(spark, data, awkward, empty):
    for rows in (awkward, empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, data))
            assert docs.dtypes == rows.dtypes
        corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()


def test_every_query_is_registered():
    import __spark_entry__

    names = " ".join(__spark_entry__.queries())
    assert all(re.search(rf"\bop{n}_", names) for n in range(1, 14)) and "pipeline" in __spark_entry__.queries()
