"""Properties of ranks, selections, splits, swaps and the closed forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convosieve.operators import ensemble as M
from convosieve.operators import evaluation as E
from convosieve.operators import ranking as K
from convosieve.operators import rules as R
from convosieve.operators import sampling as P
from convosieve.operators import similarity as D
from convosieve.operators import stats as G
from convosieve.operators import tags as A
from convosieve.operators import targets as N


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(7)
    n = 3000
    v = np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n), 3))  # one value holds more than a third
    pdf = pd.DataFrame({"doc_id": np.arange(n), "v": v, "g": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "y": (rng.random(n) < v).astype(int)})
    return pdf, spark.createDataFrame(pdf).persist()


def test_ordinal_rank_with_a_hot_value(scores):
    pdf, df = scores
    got = K.add_rank(df, "v", group="g", descending=True).toPandas().set_index("doc_id")["position"]
    want = pdf.sort_values(["v", "doc_id"], ascending=[False, True])
    want = (want.groupby("g").cumcount() + 1).rename("p").to_frame().assign(doc_id=want["doc_id"]).set_index("doc_id")["p"]
    assert (got.sort_index() == want.sort_index()).all()


def test_percentile_rank(scores):
    pdf, df = scores
    got = K.percentile_rank(df, "v", group="g").toPandas().set_index("doc_id")["pct_rank"].sort_index()
    assert np.allclose(got, pdf.groupby("g")["v"].rank(pct=True))


def test_exact_quantiles_small_and_large_brackets(scores):
    pdf, df = scores
    for margin in (0.002, 0.02):
        got = K.exact_quantiles(df, ["v"], [0.0, 0.1, 0.33, 0.9, 1.0], ["g"], margin).collect()
        assert len(got) == 10
        for r in got:
            assert r["value"] == pytest.approx(pdf[pdf.g == r["g"]]["v"].quantile(r["prob"]), abs=1e-12)


def test_occurrence_numbers_of_a_hot_key(spark):
    pdf = pd.DataFrame({"doc_id": range(400), "k": ["hot" if i % 3 else f"k{i % 7}" for i in range(400)]})
    got = K.occurrence_number(spark.createDataFrame(pdf), ["k"]).toPandas().set_index("doc_id")["occurrence"].sort_index()
    assert (got == pdf.groupby("k").cumcount()).all()


def test_top_k_selects_exactly_k(scores):
    _, df = scores
    assert P.labels_from_top_k(df, "v", 777).filter("label = 'TRUE'").count() == 777
    assert [r.selected for r in P.select_counts(df, "v", [5, 1000]).orderBy("count").collect()] == [5, 1000]


def test_most_frequent_is_exact(spark):
    pdf = pd.DataFrame({"k": [f"w{i}" for i in range(500)], "c": [2] * 400 + list(range(3, 103))})
    got = {r.k for r in K.most_frequent(spark.createDataFrame(pdf), "c", "k", 120).collect()}
    assert len(got) == 120 and {f"w{i}" for i in range(400, 500)} <= got


def test_splits_partition_the_rows(scores):
    pdf, df = scores
    s = P.split(df, "g").toPandas()
    assert len(s) == len(pdf)
    for g, part in s.groupby("g"):
        assert (part["split"] == "val").sum() == int(np.ceil(round(0.2 * len(part), 6)))
    f = P.folds(df, "g", 5).toPandas().groupby(["g", "fold"]).size().unstack()
    assert (f.max(axis=1) - f.min(axis=1)).max() <= 1


def test_oversample_balances(scores):
    _, df = scores
    got = P.oversample(df.select("doc_id", "g"), "g", batch=16).toPandas()
    assert got.groupby("g").size().nunique() == 1 and got.groupby(["g", "batch"]).size().eq(8).all()


def test_swaps_preserve_true_count(scores):
    _, df = scores
    wide = df.select("doc_id", F.col("v").alias("p1"), F.rand(1).alias("p2"), F.rand(2).alias("p3")).persist()
    scored = M.swap_scores(wide, "p1", {"p2": 0.6, "p3": 0.4}).withColumn("base", F.when(F.col("p1") >= 0.6, "TRUE").otherwise("FALSE")).persist()
    base = scored.filter("base = 'TRUE'").count()
    rows = M.balanced_swaps(scored, "base", [5, 50])["manifest"].collect()
    assert [r.pred_TRUE for r in rows] == [base, base] and [r.total_changed for r in rows] == [10, 100]


def test_auc_and_sweep(scores):
    pdf, df = scores
    pos, neg = pdf[pdf.y == 1]["v"].to_numpy(), pdf[pdf.y == 0]["v"].to_numpy()
    pairs = np.sign(pos[:, None] - neg[None, :])
    assert E.roc_auc(df, "v").first()["roc_auc"] == pytest.approx((pairs.mean() + 1) / 2)
    for r in E.threshold_sweep(df, "v", [0.3, 0.5, 0.7]).collect():
        assert r.tp == ((pdf.v >= r.threshold) & (pdf.y == 1)).sum() and r.tn == ((pdf.v < r.threshold) & (pdf.y == 0)).sum()


def test_support_sizes():
    assert N.support_sizes(50, 129, 10**6, 10**6) == (121, 0)
    assert N.support_sizes(200, 0, 500, 500) == (100, 50)


def test_normalized_weights_average_one(scores):
    _, df = scores
    assert N.normalize_weight(df.withColumn("raw_sample_weight", F.col("v") + 1)).agg(F.avg("sample_weight")).first()[0] == pytest.approx(1.0)


def test_soft_targets_ignore_missing_teachers(spark):
    rows = [(1, "a", 0.2), (1, "b", 0.8), (2, "a", 0.3), (2, "b", None), (3, "a", float("nan")), (3, "b", None)]
    got = {r.doc_id: r for r in N.soft_targets(spark.createDataFrame(rows, "doc_id long, source string, prob double"), {"a": 1.0, "b": 3.0}).collect()}
    assert got[1].teacher_prob_TRUE == pytest.approx(0.65) and got[1].teacher_prob_std == pytest.approx(np.sqrt(0.25 * 0.45**2 + 0.75 * 0.15**2))
    assert got[2].teacher_count == 1 and got[2].teacher_prob_std == 0.0 and got[3].teacher_count == 0 and got[3].sample_weight == 1.0


def test_rule_extraction(spark):
    df = spark.createDataFrame([(1, "Please help the api user: now?")], "doc_id long, text string")
    got = set(R.extract_rules(df, ["doc_id"]).first()["rules"])
    assert {"regex::instructional", "regex::workflow_terms", "regex::prompt_roles", "regex::agent_markers", "shape::ends_question", "shape::char_le_60"} <= got
    assert {"ngram1::please", "ngram2::the api", "ngram4::please help the api"} <= got and "ngram1::the" not in got


def test_tfidf_neighbors_match_brute_force(spark):
    texts = ["red fox jumps high", "red fox sleeps", "blue whale swims deep", "the fox the fox red"]
    train = D.add_keys(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    test = D.add_keys(spark.createDataFrame([(0, "red fox"), (1, "zzz"), (2, "whale swims")], "doc_id long, text string"))
    got = {(r.test_id, r.neighbor_rank): (r.train_id, r.similarity) for r in D.tfidf_neighbors(train, test, k=2, min_df=2).collect()}
    assert got[(2, 1)][0] == 2 and got[(1, 1)] == (0, 0.0)
    docs = [t.split() for t in texts + ["red fox", "zzz", "whale swims"]]
    bags = [w + [" ".join(p) for p in zip(w, w[1:])] for w in docs]
    vocab = sorted({g for b in bags for g in b if sum(g in x for x in bags) >= 2})
    idf = np.array([np.log(8 / (1 + sum(g in x for x in bags))) + 1 for g in vocab])
    m = np.array([[(1 + np.log(b.count(g))) if g in b else 0.0 for g in vocab] for b in bags]) * idf
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sims = np.round(m[4:] @ m[:4].T, 6)
    for (t, k), (i, s) in got.items():
        assert s == pytest.approx(sims[t, i], abs=2e-6) and s == pytest.approx(np.sort(sims[t])[::-1][k - 1], abs=2e-6)


def test_near_duplicates_find_a_planted_pair(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base + " extra"), (3, base), (4, " ".join(f"other{i}" for i in range(60)))]
    got = {(r.left_id, r.right_id) for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2), (1, 3)}  # the exact copy is linked with its first row alone


def test_tag_precedence(spark):
    rows = [(1, "We will bypass the filter and leak the password today"), (2, "hi"), (3, ""), (4, "See www.example.org for the calm garden notes today"), (5, "A calm walk through old garden paths today")]
    got = {r.doc_id: (r.family, r.intent, r.hidden) for r in A.heuristic_tags(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: ("policy_evasion", "extract_or_leak", True), 2: ("generic_filler", "none", False), 3: ("unclear", "unclear", False),
        4: ("tool_or_workflow", "benign_info", False), 5: ("clean_benign", "benign_info", False),
    }


def test_log_odds_counts(spark):
    df = spark.createDataFrame([("TRUE", ["a", "a", "b"]), ("FALSE", ["a"]), ("FALSE", ["b", "c"])], "label string, g array<string>")
    got = {r.ngram: (r.true_count, r.false_count) for r in G.ngram_log_odds(df, F.col("g"), min_df=2).collect()}
    assert got == {"a": (2, 1), "b": (1, 1)}
