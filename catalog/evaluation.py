"""Metrics, sweeps, AUC, errors and outcomes of the scored labelled corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from convosieve.functions import lexicons as lex
from convosieve.functions.features import add_features
from convosieve.operators import evaluation as E
from convosieve.operators import labeling as L
from convosieve.operators import sampling as P
from convosieve.operators import stats as G
from convosieve.sources import tables as V

LONG = (f"{S.SCORED}, long AS (" + " UNION ALL ".join(f"SELECT doc_id, label, y, 's{k}' AS source, p{k} AS prob FROM scored" for k in range(1, 5)) + ")")
_metrics = f"""{S.r('coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0)')} AS accuracy, {S.r('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS "precision",
 {S.r('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)')} AS recall, {S.r('coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)')} AS f1"""
_conf = """count(*) FILTER (y = 1 AND h) AS tp, count(*) FILTER (y = 0 AND h) AS fp, count(*) FILTER (y = 1 AND NOT h) AS fn, count(*) FILTER (y = 0 AND NOT h) AS tn"""
METRICS = ["accuracy", "precision", "recall", "f1"]


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def long(spark, folder):
    return V.long_scores(V.labelled_scores(spark, folder), ["label", "y"])


@query("metrics_at_threshold", f"""
WITH {LONG}, c AS (SELECT source, {_conf} FROM (SELECT *, prob >= 0.32 AS h FROM long) GROUP BY source)
SELECT source, tp, fp, fn, tn, {_metrics}, tp + fp AS "pred_TRUE", fn + tn AS "pred_FALSE" FROM c""")
def metrics(spark, folder):
    return rounded(E.metrics_at(long(spark, folder), "prob", 0.32, group="source"), METRICS)


@query("roc_auc_by_source", f"""
WITH {LONG}, rk AS (SELECT source, y, rank() OVER w + (count(*) OVER (PARTITION BY source, prob) - 1) / 2.0::DOUBLE AS ar FROM long WINDOW w AS (PARTITION BY source ORDER BY prob))
SELECT source, {S.r('(sum(ar) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))')} AS roc_auc,
  count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM rk GROUP BY source""")
def auc(spark, folder):
    return rounded(E.roc_auc(long(spark, folder), "prob", group="source"), ["roc_auc"])


_grid = "[" + ", ".join(map(str, lex.THRESHOLD_GRID)) + "]"
_SWEEP = f"""{LONG}, g AS (SELECT unnest({_grid})::DOUBLE AS threshold), c AS (SELECT source, threshold, {_conf} FROM (SELECT *, prob >= threshold AS h FROM long, g) GROUP BY source, threshold)"""


@query("threshold_sweep", f"""WITH {_SWEEP} SELECT source, threshold, tp, fp, fn, tn, {_metrics}, tp + fp AS "pred_TRUE", fn + tn AS "pred_FALSE" FROM c""")
def sweep(spark, folder):
    return rounded(E.threshold_sweep(long(spark, folder), "prob", lex.THRESHOLD_GRID, group="source"), METRICS)


_wide = "[" + ", ".join(map(str, lex.THRESHOLD_GRID_WIDE)) + "]"


def _best(grid, target):
    return f"""
WITH {_SWEEP.replace(_grid, grid)}, m AS (SELECT source, threshold, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS rc,
  coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(f, 9) DESC, round(abs(threshold - {target}), 9), threshold) AS n FROM m)
SELECT source, threshold, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(f, 6) AS f1 FROM o WHERE n = 1"""


@query("best_threshold", _best(_grid, "0.5::DOUBLE"))
def best(spark, folder):
    s = E.threshold_sweep(long(spark, folder), "prob", lex.THRESHOLD_GRID, group="source")
    return rounded(E.best_threshold(s, 0.5, "source"), ["precision", "recall", "f1"])


@query("best_threshold_wide_grid", _best(_wide, "0.32::DOUBLE"))
def best_wide(spark, folder):
    s = E.threshold_sweep(long(spark, folder), "prob", lex.THRESHOLD_GRID_WIDE, group="source")
    return rounded(E.best_threshold(s, 0.32, "source"), ["precision", "recall", "f1"])


PRED = f"{S.SCORED}, pred AS (SELECT doc_id, label, y, p1 AS prob, CASE WHEN p1 >= 0.32 THEN 'TRUE' ELSE 'FALSE' END AS pred_label FROM scored)"


def predicted(spark, folder, threshold=0.32):
    df = V.labelled_scores(spark, folder)
    return df.select("doc_id", "label", "y", F.col("p1").alias("prob"), L.apply_threshold("p1", threshold).alias("pred_label"))


OUTCOME = """CASE WHEN label = 'TRUE' AND pred_label = 'TRUE' THEN 'true_positive' WHEN label = 'FALSE' AND pred_label = 'FALSE' THEN 'true_negative'
 WHEN label = 'FALSE' THEN 'false_positive' ELSE 'false_negative' END"""


@query("prediction_outcomes", f"WITH {PRED} SELECT {OUTCOME} AS outcome, count(*) AS row_count FROM pred GROUP BY 1")
def outcomes(spark, folder):
    df = predicted(spark, folder).withColumn("outcome", L.outcome("label", "pred_label"))
    return G.value_counts(df, "outcome")


ERR = f"""{PRED}, err AS (SELECT *, CASE WHEN pred_label = 'TRUE' THEN 'false_positive' ELSE 'false_negative' END AS error_type,
  CASE WHEN pred_label = 'TRUE' THEN prob ELSE 1.0 - prob END AS confidence FROM pred WHERE label <> pred_label)"""


@query("top_errors", f"""
WITH {ERR}, o AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY confidence DESC, doc_id) AS rank FROM err)
SELECT doc_id, label, pred_label, {S.r('prob')} AS prob, error_type, {S.r('confidence')} AS confidence, rank FROM o WHERE rank <= 200""")
def top_errors(spark, folder):
    err = L.errors(predicted(spark, folder))
    top = P.top_per_group(err, ["error_type"], [F.desc("confidence"), F.col("doc_id")], 200)
    return rounded(top, ["prob", "confidence"]).select("doc_id", "label", "pred_label", "prob", "error_type", "confidence", F.col("rank").cast("long").alias("rank"))


_style = S.feature_names("style")


@query("style_by_outcome", f"""
WITH {PRED}, d AS (SELECT p.*, t.text FROM pred p JOIN documents t USING (doc_id)), {S.feature_ctes('style', 'd', 'f', keep='doc_id, label, pred_label')}
SELECT {OUTCOME} AS outcome, {', '.join(f'{S.r(f"avg({c})")} AS {c}_mean, {S.r(f"median({c})")} AS {c}_median, {S.r(f"stddev_samp({c})")} AS {c}_std' for c in _style)}
FROM f GROUP BY 1""")
def style_by_outcome(spark, folder):
    docs = V.documents(spark, folder).select("doc_id", "text").join(predicted(spark, folder), "doc_id")
    feats = add_features(docs, "style").withColumn("outcome", L.outcome("label", "pred_label")).drop("text").persist()
    return G.summarize(feats, "outcome", _style, ("mean", "median", "std"))


_error_join = "d AS (SELECT p.*, t.text FROM err p JOIN documents t USING (doc_id))"
_FC = """CASE WHEN prompt_code_hits >= 1 THEN 'PROMPT_OR_CODE_LEAKAGE' WHEN non_ascii_ratio >= 0.08 THEN 'MULTILINGUAL_OR_ENCODING'
 WHEN repeated_token_ratio >= 0.20 OR repeated_phrase_count >= 1 OR (word_count >= 25 AND unique_word_ratio <= 0.72) THEN 'REPETITIVE_OR_SPAM'
 WHEN pred_label = 'TRUE' THEN CASE WHEN noisy THEN 'NOISY_FALSE' WHEN prob >= 0.85 THEN 'LIKELY_LABEL_NOISE' ELSE 'BORDERLINE_AMBIGUOUS' END
 WHEN NOT noisy THEN CASE WHEN prob <= 0.05 AND word_count >= 8 THEN 'LIKELY_LABEL_NOISE' ELSE 'CLEAN_SEMANTIC_TRUE' END
 WHEN prob <= 0.15 THEN 'LIKELY_LABEL_NOISE' ELSE 'BORDERLINE_AMBIGUOUS' END"""
_NOISY = """(weird_token_ratio >= 0.08 OR punctuation_ratio >= 0.08 OR long_token_count >= 1 OR mixed_alnum_token_count >= 1 OR symbol_heavy_token_count >= 1
 OR newline_count >= 2 OR repeated_char_count >= 1)"""
_FAIL = f"""{ERR}, {_error_join}, {S.feature_ctes('error', 'd', 'f', keep='doc_id, label, pred_label, prob, confidence')},
fn AS (SELECT *, {_NOISY} AS noisy FROM f), fc AS (SELECT *, {_FC} AS failure_category FROM fn)"""


def failures(spark, folder):
    err = L.errors(predicted(spark, folder))
    docs = V.documents(spark, folder).select("doc_id", "text").join(err, "doc_id")
    return add_features(docs, "error").withColumn("failure_category", L.failure_category())


@query("failure_categories", f"WITH {_FAIL} SELECT doc_id, failure_category FROM fc")
def failure_rows(spark, folder):
    return failures(spark, folder).select("doc_id", "failure_category")


_means = {"mean_pred_prob_TRUE": "prob", "mean_confidence": "confidence", "mean_word_count": "word_count", "mean_weird_token_ratio": "weird_token_ratio",
          "mean_repeated_token_ratio": "repeated_token_ratio", "mean_non_ascii_ratio": "non_ascii_ratio"}


@query("failure_summary", f"""
WITH {_FAIL} SELECT failure_category, label, pred_label, count(*) AS row_count, {', '.join(f'{S.r(f"avg({c})")} AS "{n}"' for n, c in _means.items())} FROM fc GROUP BY ALL""")
def failure_summary(spark, folder):
    return failures(spark, folder).groupBy("failure_category", "label", "pred_label").agg(
        F.count(F.lit(1)).alias("row_count"), *[F.round(F.avg(c), 6).alias(n) for n, c in _means.items()])


@query("failure_examples", f"""
WITH {_FAIL}, o AS (SELECT doc_id, failure_category, confidence, row_number() OVER (PARTITION BY failure_category ORDER BY confidence DESC, doc_id) AS rank FROM fc)
SELECT doc_id, failure_category, {S.r('confidence')} AS confidence, rank FROM o WHERE rank <= 5""")
def failure_examples(spark, folder):
    top = P.top_per_group(failures(spark, folder).select("doc_id", "failure_category", "confidence"), ["failure_category"], [F.desc("confidence"), F.col("doc_id")], 5)
    return top.select("doc_id", "failure_category", F.round("confidence", 6).alias("confidence"), F.col("rank").cast("long").alias("rank"))


from catalog.flagship import _TAGS, quantile_cte  # noqa: E402


@query("failure_buckets", f"""
WITH {ERR}, {S.LAB.replace('lab AS', 'lab2 AS')}, tr AS (SELECT d.doc_id, d.text FROM documents d JOIN lab2 USING (doc_id)),
{S.feature_ctes('review', 'tr', 'f')}, {quantile_cte('f', L.ABNORMAL_THRESHOLDS)},
tg AS (SELECT doc_id, {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c, _ in _TAGS)} AS s FROM f, thr)
SELECT e.doc_id, e.error_type, CASE WHEN abs(e.prob - 0.32) <= 0.10 THEN 'borderline/probability' WHEN s >= 3 THEN 'stylistic/noise-driven'
  WHEN s <= 1 AND error_type = 'false_negative' THEN 'semantic/subtle' WHEN s <= 1 THEN 'semantic/label-noise-or-overread' ELSE 'mixed' END AS failure_bucket
FROM err e JOIN tg USING (doc_id)""")
def failure_buckets(spark, folder):
    feats = add_features(V.train(spark, folder), "review").drop("text", "label").persist()
    thr = L.fit_thresholds(feats, L.ABNORMAL_THRESHOLDS)
    scored = feats.select("doc_id", L.review_score(L.review_tags(thr)).alias("review_score"))
    err = L.errors(predicted(spark, folder)).join(scored, "doc_id")
    return err.select("doc_id", "error_type", L.failure_bucket(0.32).alias("failure_bucket"))


@query("error_length_stats", f"""
WITH {PRED}, d AS (SELECT p.*, t.text FROM pred p JOIN documents t USING (doc_id)), {S.feature_ctes('lengths', 'd', 'f', keep='doc_id, label, pred_label, prob')}, o AS (SELECT *, {OUTCOME} AS outcome FROM f)
SELECT outcome, count(*) AS token_count, {S.r('avg(word_count)')} AS token_mean, {S.r('stddev_pop(word_count)')} AS token_std, min(word_count) AS token_min, max(word_count) AS token_max,
  {', '.join(f"{S.r(f'quantile_cont(word_count, {p})')} AS token_{n}" for n, p in G.DESCRIBE_PROBS.items())},
  count(*) FILTER (word_count > 254) AS truncated_at_256_count, {S.r('100.0 * count(*) FILTER (word_count > 254) / count(*)')} AS truncated_at_256_pct,
  count(*) FILTER (word_count > 382) AS truncated_at_384_count, {S.r('100.0 * count(*) FILTER (word_count > 382) / count(*)')} AS truncated_at_384_pct, {S.r('avg(prob)')} AS "mean_pred_prob_TRUE"
FROM o GROUP BY outcome""")
def error_lengths(spark, folder):
    docs = V.documents(spark, folder).select("doc_id", "text").join(predicted(spark, folder), "doc_id")
    feats = add_features(docs, "lengths").withColumn("outcome", L.outcome("label", "pred_label")).drop("text").persist()
    base = G.describe_lengths(feats, {"token": "word_count"}, "outcome", with_all=False)
    aggs = [F.round(F.avg("prob"), 6).alias("mean_pred_prob_TRUE")]
    for m in (256, 384):
        cut = F.count_if(F.col("word_count") > m - 2)
        aggs += [cut.alias(f"truncated_at_{m}_count"), F.round(100.0 * cut / F.count(F.lit(1)), 6).alias(f"truncated_at_{m}_pct")]
    out = base.join(feats.groupBy("outcome").agg(*aggs), "outcome")
    return rounded(out, ["token_mean", "token_std", *[f"token_{n}" for n in G.DESCRIBE_PROBS]])
