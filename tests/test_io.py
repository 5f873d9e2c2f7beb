"""Readers, sinks, resumable append and the streaming job."""

import json

import pytest
from pyspark.sql import functions as F

from convosieve.sources import readers as R
from convosieve.sources import sinks as W
from convosieve.streaming.tagging import tag_batch, tag_stream


def test_jsonl_and_corpus(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": 1, "text": "a\\r\\nb ", "label": true}\n\n{"doc_id": 2, "text": null, "label": "F"}\n')
    rows = R.read_corpus(spark, str(tmp_path / "c.jsonl")).orderBy("doc_id").collect()
    assert [(r.norm_text, r.label, r.y) for r in rows] == [("a\nb", "TRUE", 1), ("", "FALSE", 0)]
    (tmp_path / "bad.jsonl").write_text('{"doc_id": 1, "text": "a"}\nnot json\n')
    kept = R.read_jsonl(spark, str(tmp_path / "bad.jsonl"), corrupt="_bad").cache()
    assert kept.filter("_bad is not null").count() == 1


def test_csv_round_trip_with_newlines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'he said "x",\nthen left', "0.5")], R.SCORE_SCHEMA)
    W.write_table(df, str(tmp_path / "s"), "csv")
    assert R.read_csv(spark, str(tmp_path / "s"), R.SCORE_SCHEMA).first()["text"] == 'he said "x",\nthen left'


def test_score_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "3"), (2, "1"), (3, "2")], "doc_id long, p string")
    got = {r.doc_id: r.s for r in R.score_source(df, "p", "s").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5}  # out of range: rank-normalised
    assert R.score_source(df.withColumn("p", F.lit("x")), "p", "s") is None
    with pytest.raises(ValueError, match="outside"):
        R.score_source(df, "p", "s", strict=True)
    W.write_table(df.withColumn("p", F.lit("0.25")), str(tmp_path / "one"))
    specs = [{"name": "one", "path": str(tmp_path / "one"), "column": "p", "format": "parquet"}, {"name": "two", "path": str(tmp_path / "none"), "column": "p"}]
    assert R.load_sources(spark, specs).filter("source = 'one' and prob = 0.25").count() == 3
    with pytest.raises(FileNotFoundError):
        R.load_sources(spark, [specs[1] | {"required": True}])


def test_metrics_threshold_fallbacks(spark, tmp_path):
    docs = {
        "a": {"threshold_tuning": {"selected_threshold": 0.32}, "selected_threshold": 0.9},
        "b": {"best_epoch": {"epoch": 2}, "epoch_metrics": [{"epoch": 1, "best_tuned_threshold": 0.1}, {"epoch": 2, "best_tuned_threshold": 0.2}]},
        "c": {"threshold_tuning": {"table": [{"threshold": 0.4, "f1": 0.7}, {"threshold": 0.5, "f1": 0.9}, {"threshold": 0.6, "f1": 0.9}]}},
        "d": {"oof": {"f1": 0.5, "roc_auc": 0.75}},
    }
    for k, v in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v, indent=1))
    df = R.metrics_text(spark, str(tmp_path)).orderBy("path")
    assert [r[0] for r in df.select(R.threshold_of("doc")).collect()] == [0.32, 0.2, 0.5, None]
    assert df.select(R.metric_bundle("doc").alias("m")).collect()[3]["m"]["roc_auc"] == 0.75


def test_submission_rejects_missing_labels(spark):
    template = spark.createDataFrame([(1, None), (2, None)], "doc_id long, label string")
    labels = spark.createDataFrame([(1, "TRUE")], "doc_id long, label string")
    with pytest.raises(Exception, match="invalid or missing label"):
        W.make_submission(template, labels).collect()


def test_append_resumes(spark, tmp_path):
    out, failed = str(tmp_path / "out"), str(tmp_path / "failed")
    rows = spark.createDataFrame([(1, "alpha beta gamma delta tool"), (2, None)], "doc_id long, text string")
    W.append_new(rows, tag_batch, out, failed)
    more = rows.unionByName(spark.createDataFrame([(3, "calm garden walk by the old river")], "doc_id long, text string"))
    W.append_new(more, tag_batch, out, failed)
    got = spark.read.parquet(out)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert W.latest(got.unionByName(got.withColumn("why", F.lit("new")).withColumn("tagged_at", F.expr("tagged_at + interval 1 day")))).filter("why = 'new'").count() == 2
    assert {r.doc_id for r in spark.read.parquet(failed).collect()} == {2}


def test_stream_processes_each_id_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "ck"))
    (src / "1.json").write_text('{"doc_id": 1, "text": "use the tool to query the database"}\n{"doc_id": 2}\n')
    tag_stream(*args).awaitTermination(60)
    (src / "2.json").write_text('{"doc_id": 1, "text": "again"}\n{"doc_id": 3, "text": "a calm walk in the green park"}\n')
    tag_stream(*args).awaitTermination(60)
    got = {r.doc_id: r.family for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "tool_or_workflow", 3: "clean_benign"}
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "failed")).collect()} == {2}


def test_append_remembers_failed_ids_and_reads_touched_folders_only(spark, tmp_path):
    out, failed, tried = str(tmp_path / "out"), str(tmp_path / "failed"), []

    def tag(df):
        tried.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect()))
        return df.withColumn("valid", F.col("text").isNotNull())

    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    W.append_new(make([(1, "b"), (1, "a"), (1, None), (2, None), (None, "null id")]), tag, out, failed)
    W.append_new(make([(1, "later"), (2, "has a text now"), (3, "c"), (None, "again")]), tag, out, failed)
    W.append_new(make([(1, "b"), (3, "d")]), tag, out, failed)
    assert tried == [[(False, 1), (False, 2), (True, 0)], [(False, 3)], []]
    assert {(r["doc_id"], r["text"]) for r in spark.read.parquet(out).collect()} == {(1, "a"), (3, "c"), (None, "null id")}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(W.ID_PARTS))
    assert spark.read.parquet(out).filter(F.col("id_part") != part).count() == 0
    # Folders of other ids are not read: a broken file there does no harm.
    mine = spark.createDataFrame([(50,)], "doc_id long").select(part.alias("p")).first()[0]
    broken = tmp_path / "out" / f"id_part={(mine + 1) % W.ID_PARTS}"
    broken.mkdir(exist_ok=True)
    (broken / "part-broken.parquet").write_bytes(b"not a table")
    W.append_new(make([(50, "e")]), tag, out, failed)
    assert tried[-1] == [(False, 50)]


def test_stream_keeps_ids_as_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    tried = []

    def tag(df):
        tried.append({r["doc_id"]: r["text"] for r in df.collect()})
        return tag_batch(df)

    run = lambda **how: tag_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "ck"), tag=tag, **how).awaitTermination(120)
    (src / "1.json").write_text('{"doc_id": 1, "text": "b"}\n{"doc_id": 1, "text": "a"}\n{"doc_id": 1}\n{"doc_id": 2}\n{"text": "null id"}\n')
    run()
    assert tried == [{1: "a", 2: None, None: "null id"}]
    # What was written is not asked: the state alone knows the ids, the failed one too.
    spark.createDataFrame([(7, "x")], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=0"))
    (src / "2.json").write_text('{"doc_id": 1, "text": "0"}\n{"doc_id": 2, "text": "now with a text"}\n{"doc_id": 3, "text": "c"}\n{"text": "again"}\n')
    run()
    run()
    assert tried[1:] == [{3: "c"}]


def test_stream_repeats_a_batch_that_failed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("".join(json.dumps({"doc_id": i, "text": f"text {i}"}) + "\n" for i in range(20)))
    broken = [True]

    def tag(df):
        if broken.pop() if broken else False:
            raise RuntimeError("stopped in the middle")
        return tag_batch(df)

    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "ck"))
    with pytest.raises(Exception, match="stopped in the middle"):
        tag_stream(*args, tag=tag).awaitTermination(120)
    tag_stream(*args, tag=tag).awaitTermination(120)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


def test_row_numbers_are_dense_in_file_order(spark, tmp_path):
    folder, expected = tmp_path / "files", []
    folder.mkdir()
    for name, n in (("b.jsonl", 700), ("a.jsonl", 3), ("c.jsonl", 0), ("d.jsonl", 41)):
        (folder / name).write_text("".join(json.dumps({"text": f"{name} {i} " + "x" * 200}) + "\n" + "\n" * (i % 5 == 0) for i in range(n)))
    for name, n in (("a.jsonl", 3), ("b.jsonl", 700), ("d.jsonl", 41)):
        expected += [f"{name} {i} " for i in range(n)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # several splits a file, several files a task
    try:
        rows = R.read_corpus(spark, str(folder), "text string, label string").select("doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["text"].rstrip("x") for r in sorted(rows)] == expected and sorted(r["doc_id"] for r in rows) == list(range(744))


def test_path_exists_asks_the_file_system(spark, tmp_path):
    from convosieve.sources.readers import path_exists

    (tmp_path / "a.csv").write_text("x\n")
    assert path_exists(spark, str(tmp_path)) and path_exists(spark, f"file:{tmp_path}/a.csv") and path_exists(spark, f"file://{tmp_path}/*.csv")
    assert not path_exists(spark, f"file:{tmp_path}/b.csv") and not path_exists(spark, f"{tmp_path}/*.json")


def test_metrics_document_has_one_row(spark, tmp_path):
    import pytest

    from convosieve.sources.sinks import write_metrics

    with pytest.raises(ValueError):
        write_metrics(spark.range(2), str(tmp_path / "m"))
    write_metrics(spark.range(1), str(tmp_path / "m"))
