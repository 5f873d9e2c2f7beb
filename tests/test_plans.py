"""Plan shape and oracle smoke checks on the smallest tables."""

import math
import re

import duckdb
import pytest

import catalog
from convosieve.functions.features import add_features
from convosieve.operators import ranking as K
from convosieve.sources import tables as V

catalog.load()
TABLES = "documents labels conversations embeddings benchmark pages events".split()
SMOKE = ["text_normalized", "hard_weight_summary", "threshold_sweep", "rank_ensemble_scores", "swap_actions", "stratified_folds", "cross_matches_exact_key", "embedding_neighbors", "teacher_soft_targets", "tag_counts", "first_per_text"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 120


def test_feature_scan_reads_two_columns_and_no_python(spark, data):
    text = plan(add_features(V.table(spark, data, "documents").select("doc_id", "text"), "noise"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "Python" not in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["route_summary", "label_noise_summary", "hard_weight_rows", "percentile_ranks", "rule_overrides", "feature_rare_tokens", "cross_matches_loose_key"])
def test_no_cartesian_product(spark, data, name):
    text = plan(catalog.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_rank_windows_are_partitioned(spark, data):
    ranked = K.add_rank(V.unlabelled_scores(spark, data).select("doc_id", "p1"), "p1")
    windows = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", plan(ranked))
    assert windows and all("_b" in w for w in windows)


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SMOKE)
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, data)
    rel = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted(tuple(_canon(r[c]) for c in sorted(cols)) for r in df.collect())
    want = sorted(tuple(_canon(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())
    assert got == want
