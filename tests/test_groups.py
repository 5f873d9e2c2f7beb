"""Groups of equal keys: every member is a row; keys cover whole texts; the calibrator's one scoring pass."""

from pyspark.sql import functions as F

from convosieve.functions import text as T
from convosieve.operators import models as O
from convosieve.operators import similarity as D


def test_all_members_of_a_hot_key(spark):
    rows = [(i, "same words", "TRUE" if i % 2 else "FALSE") for i in range(200)] + [(500, "alone", "TRUE"), (501, None, "FALSE"), (502, "", "TRUE")]
    df = D.add_keys(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    got = D.group_members(df, "exact_key", label="label").collect()
    assert sorted(r["id"] for r in got if r["id"] < 500) == list(range(200))
    assert all(r["label"] == ("TRUE" if r["id"] % 2 else "FALSE") for r in got if r["id"] < 500)
    assert 500 not in {r["id"] for r in got}
    assert D.group_members(df.limit(0), "exact_key").count() == 0


def test_members_of_both_sides(spark):
    a = D.add_keys(spark.createDataFrame([(1, "x y", "TRUE"), (2, "x y", "FALSE"), (3, "only here", "TRUE")], "doc_id long, text string, label string"))
    b = D.add_keys(spark.createDataFrame([(1, "X Y"), (9, "other")], "doc_id long, text string"))
    got = {(r["side"], r["id"], r["label"]) for r in D.cross_members(a, b, "exact_key").collect()}
    assert got == {("train", 1, "TRUE"), ("train", 2, "FALSE"), ("test", 1, None)}
    assert D.cross_members(a, b, "exact_key", min_train=3).count() == 0


def test_shape_key_reads_the_whole_text(spark):
    long = "a 1 " * 400
    df = spark.createDataFrame([(long + "b",), (long + "!",)], "text string")
    assert df.select(T.shape_key("text").alias("k")).distinct().count() == 2


def test_candidates_scored_as_their_own_models_would(spark):
    rows = [(i, float((i * 7919 % 13) > 5), float(i * 7919 % 13 + 4 * (i % 3)), float(i % 5), 1.0) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, y double, a double, b double, c double")
    out = O.calibrator_search(frame, {"one": ["a"], "all": ["a", "b", "c"]}, [0.1, 1.0], ("balanced",), k=2).collect()
    assert {(r["feature_set"], r["c"]) for r in out} == {("one", 0.1), ("one", 1.0), ("all", 0.1), ("all", 1.0)}
    data = O.folds(frame, "y", 2, "doc_id")
    parts = []
    for i in range(2):
        fit, held = data.filter(F.col("fold") != i), data.filter(F.col("fold") == i)
        scale = O._scaled(*O._moments(fit, ["a"]), ["a"])
        parts.append(O.predict(O.fit_logreg(scale(fit), c=1.0), scale(held)).select("doc_id", "y", "prob"))
    want = O.roc_auc(parts[0].union(parts[1]), "prob").first()["roc_auc"]
    got = next(r["roc_auc"] for r in out if (r["feature_set"], r["c"]) == ("one", 1.0))
    assert abs(got - want) < 1e-6
