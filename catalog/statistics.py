"""Group summaries, effect sizes, correlations, lengths, log-odds, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from catalog.evaluation import rounded
from catalog.texts import char_wb_sql
from convosieve.functions import lexicons as lex
from convosieve.functions import text as T
from convosieve.functions import tokens as K
from convosieve.functions.features import add_features
from convosieve.operators import stats as G
from convosieve.sources import tables as V


def feats(spark, folder, family):
    return add_features(V.train(spark, folder), family).drop("text").persist()


def _agg(names, stats, digits):
    fn = {"count": "count({0})", "mean": "avg({0})", "median": "median({0})", "std": "stddev_samp({0})", "min": "min({0})", "max": "max({0})"}
    return ", ".join(f"count({n}) AS {n}_count" if s == "count" else f"{S.r(fn[s].format(n), digits)} AS {n}_{s}" for n in names for s in stats)


_basic = S.feature_names("basic")
_FULL = ("count", "mean", "median", "std", "min", "max")


@query("text_stats_by_label", f"WITH {S.TRAIN}, {S.feature_ctes('basic', 'train', 'f', keep='label')} SELECT label, {_agg(_basic, _FULL, 4)} FROM f GROUP BY label")
def text_stats(spark, folder):
    return G.summarize(feats(spark, folder, "basic"), "label", _basic, _FULL, 4)


_style = S.feature_names("style")


@query("style_summary_by_label", f"WITH {S.TRAIN}, {S.feature_ctes('style', 'train', 'f', keep='label')} SELECT label, {_agg(_style, _FULL[1:], 6)} FROM f GROUP BY label")
def style_summary(spark, folder):
    return G.summarize(feats(spark, folder, "style"), "label", _style)


_review = S.feature_names("review")


@query("review_summary_long", f"""
WITH {S.TRAIN}, {S.feature_ctes('review', 'train', 'f', keep='label')}, u AS (UNPIVOT f ON {', '.join(_review)} INTO NAME feature VALUE v)
SELECT label, feature, {S.r('avg(v)')} AS mean, {S.r('median(v)')} AS median, {S.r('quantile_cont(v, 0.9)')} AS p90, {S.r('max(v)')} AS max FROM u GROUP BY label, feature""")
def review_summary(spark, folder):
    return rounded(G.summarize_long(feats(spark, folder, "review"), "label", _review), ["mean", "median", "p90", "max"])


_DESC = {"char": "char_length", "word": "word_count"}
_desc_cols = ", ".join(
    f"count({c}) AS {p}_count, {S.r(f'avg({c})')} AS {p}_mean, {S.r(f'stddev_pop({c})')} AS {p}_std, min({c}) AS {p}_min, max({c}) AS {p}_max, "
    + ", ".join(f"{S.r(f'quantile_cont({c}, {q})')} AS {p}_{n}" for n, q in G.DESCRIBE_PROBS.items()) for p, c in _DESC.items())
_desc_round = [f"{p}_{n}" for p in _DESC for n in ("mean", "std", *G.DESCRIBE_PROBS)]


@query("length_describe", f"""
WITH {S.TRAIN}, {S.TEST}, {S.feature_ctes('lengths', 'train', 'f', keep='label')}, {S.feature_ctes('lengths', 'test', 'g')},
a AS (SELECT label, char_length, word_count FROM f UNION ALL SELECT 'ALL', char_length, word_count FROM f UNION ALL SELECT 'UNKNOWN', char_length, word_count FROM g)
SELECT label, {_desc_cols} FROM a GROUP BY label""")
def length_describe(spark, folder):
    tr = add_features(V.train(spark, folder), "lengths").select("label", "char_length", "word_count").persist()
    te = add_features(V.test(spark, folder), "lengths").select(F.lit("UNKNOWN").alias("label"), "char_length", "word_count").persist()
    both = G.describe_lengths(tr, _DESC, "label").unionByName(G.describe_lengths(te, _DESC, "label", with_all=False))
    return rounded(both, _desc_round)


_cand = lex.LENGTH_CANDIDATES


@query("length_coverage", f"""
WITH {S.TRAIN}, {S.feature_ctes('lengths', 'train', 'f', keep='label')}, a AS (SELECT label, word_count AS n FROM f UNION ALL SELECT 'ALL', word_count FROM f),
c AS (SELECT *, least(n, m - 2) / greatest(n, 1) AS k FROM a, (SELECT unnest({_cand}) AS m))
SELECT label, m AS max_length, m - 2 AS content_capacity, count(*) AS total_count, count(*) FILTER (n > m - 2) AS truncated_count, {S.r('100.0 * count(*) FILTER (n > m - 2) / count(*)')} AS truncated_pct,
  {S.r('100.0 * avg(k)')} AS mean_retained_pct, {S.r('100.0 * quantile_cont(k, 0.05)')} AS p05_retained_pct FROM c GROUP BY label, m""")
def coverage(spark, folder):
    f = add_features(V.train(spark, folder), "lengths").select("label", "word_count")
    f = f.withColumn("label", F.explode(F.array("label", F.lit("ALL")))).persist()
    return rounded(G.length_coverage(f, "word_count", "label", _cand), ["truncated_pct", "mean_retained_pct", "p05_retained_pct"])


def _two(sd):
    return ", ".join(f"avg(v) FILTER (label = '{v}') AS m{t}, {sd}(v) FILTER (label = '{v}') AS s{t}" for v, t in (("TRUE", "t"), ("FALSE", "f")))


def _long(family):
    return f"{S.TRAIN}, {S.feature_ctes(family, 'train', 'f', keep='label')}, u AS (UNPIVOT f ON {', '.join(S.feature_names(family))} INTO NAME feature VALUE v)"


@query("style_effect_sizes", f"""
WITH {_long('style')}, e AS (SELECT feature, {_two('stddev_samp')} FROM u GROUP BY feature)
SELECT feature, {S.r('mt')} AS true_mean, {S.r('mf')} AS false_mean, {S.r('mt - mf')} AS diff_true_minus_false, {S.r('coalesce(mt / nullif(mf, 0), 0)')} AS ratio_true_over_false,
  {S.r('coalesce((mt - mf) / nullif(sqrt((st * st + sf * sf) / 2), 0), 0)')} AS standardized_diff FROM e""")
def effects(spark, folder):
    return rounded(G.effect_sizes(feats(spark, folder, "style"), _style), ["true_mean", "false_mean", "diff_true_minus_false", "ratio_true_over_false", "standardized_diff"])


_eff = "CASE WHEN sqrt((st * st + sf * sf) / 2) > 1e-12 THEN (mt - mf) / sqrt((st * st + sf * sf) / 2) ELSE 0 END"


@query("review_effect_sizes", f"""
WITH {_long('review')}, e AS (SELECT feature, {_two('stddev_pop')} FROM u GROUP BY feature)
SELECT feature, {S.r('mf')} AS false_mean, {S.r('mt')} AS true_mean, {S.r('mt - mf')} AS difference_true_minus_false, {S.r(_eff)} AS effect_size,
  CASE WHEN {_eff} > 0 THEN 'higher_TRUE' ELSE 'higher_FALSE' END AS direction FROM e""")
def review_effects(spark, folder):
    return rounded(G.effect_sizes_population(feats(spark, folder, "review"), _review), ["false_mean", "true_mean", "difference_true_minus_false", "effect_size"])


_noise = S.feature_names("noise")
_rr = "CASE WHEN sx < 1e-12 OR sy < 1e-12 THEN 0 ELSE cv / (sx * sy) END"


@query("noise_correlations", f"""
WITH {_long('noise')}, e AS (SELECT feature, {_two('stddev_pop')}, median(v) FILTER (label = 'TRUE') AS dt, median(v) FILTER (label = 'FALSE') AS df, stddev_pop(v) AS sx,
  stddev_pop((label = 'TRUE')::INTEGER) AS sy, covar_pop(v, (label = 'TRUE')::INTEGER) AS cv, count(*) AS n FROM u GROUP BY feature),
c AS (SELECT *, {_rr} AS r FROM e), t AS (SELECT *, CASE WHEN abs(r) < 1 THEN r * sqrt(greatest(n - 2, 1) / greatest(1 - r * r, 1e-12)) ELSE sign(r) * 1e9 END AS t FROM c)
SELECT feature, {S.r('mf')} AS "mean_FALSE", {S.r('mt')} AS "mean_TRUE", {S.r('df')} AS "median_FALSE", {S.r('dt')} AS "median_TRUE", {S.r('sf')} AS "std_FALSE", {S.r('st')} AS "std_TRUE",
  {S.r('r')} AS "pearson_corr_with_TRUE", {S.r('abs(r)')} AS abs_corr, {S.r(_eff)} AS "cohen_d_TRUE_minus_FALSE", {S.r(S.two_sided_p('t'))} AS approx_p_value,
  CASE WHEN r > 0 THEN 'higher_TRUE' ELSE 'higher_FALSE' END AS direction FROM t""")
def correlations(spark, folder):
    cols = ["mean_FALSE", "mean_TRUE", "median_FALSE", "median_TRUE", "std_FALSE", "std_TRUE", "pearson_corr_with_TRUE", "abs_corr", "cohen_d_TRUE_minus_FALSE", "approx_p_value"]
    return rounded(G.correlations(feats(spark, folder, "noise"), _noise), cols)


def _odds_sql(src, grams, top):
    return f"""
WITH {S.TRAIN}, n AS (SELECT doc_id, label, {S.norm('text')} AS t FROM train), {src}
g AS (SELECT doc_id, label, unnest({grams}) AS ngram FROM w), v AS (SELECT ngram, count(DISTINCT doc_id) AS df, count(*) FILTER (label = 'TRUE') AS true_count,
  count(*) FILTER (label = 'FALSE') AS false_count FROM g GROUP BY ngram HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT count(*)::DOUBLE AS m, sum(true_count) + count(*) AS tt, sum(false_count) + count(*) AS ft FROM v),
o AS (SELECT ngram, true_count, false_count, ln((true_count + 1.0::DOUBLE) / tt) - ln((false_count + 1.0::DOUBLE) / ft) AS lo FROM v, s)
SELECT ngram, true_count, false_count, {S.r('lo')} AS log_odds_true_minus_false FROM o"""


@query("word_log_odds", _odds_sql(rf"w AS (SELECT doc_id, label, regexp_extract_all(lower(t), {S.q(rf'[{S.AN}_]{{2,}}')}) AS w FROM n),", f"list_concat(w, {S.grams('w', 2)})", 150))
def word_log_odds(spark, folder):
    out = G.ngram_log_odds(V.train(spark, folder), K.word_ngrams(T.normalize_text("text"), 1, 2))
    return rounded(out, ["log_odds_true_minus_false"])


@query("word_log_odds_extremes", f"""
WITH b AS ({_odds_sql(rf"w AS (SELECT doc_id, label, regexp_extract_all(lower(t), {S.q(rf'[{S.AN}_]{{2,}}')}) AS w FROM n),", f"list_concat(w, {S.grams('w', 2)})", 150)})
(SELECT *, 'TRUE' AS direction FROM b ORDER BY log_odds_true_minus_false DESC, ngram LIMIT 150) UNION ALL (SELECT *, 'FALSE' AS direction FROM b ORDER BY log_odds_true_minus_false, ngram LIMIT 150)""")
def word_extremes(spark, folder):
    out = rounded(G.ngram_log_odds(V.train(spark, folder), K.word_ngrams(T.normalize_text("text"), 1, 2)), ["log_odds_true_minus_false"])
    return G.top_each_direction(out.persist(), "log_odds_true_minus_false", "ngram", 150)


@query("char_log_odds", _odds_sql("w AS (SELECT doc_id, label, t AS w FROM n),", char_wb_sql("w", 3, 5), 150))
def char_log_odds(spark, folder):
    out = G.ngram_log_odds(V.train(spark, folder), K.char_wb_ngrams(T.normalize_text("text"), 3, 5))
    return rounded(out, ["log_odds_true_minus_false"])


@query("label_crosstab", f"""
WITH {S.TRAIN} SELECT lang, count(*) FILTER (label = 'TRUE') AS "TRUE", count(*) FILTER (label = 'FALSE') AS "FALSE" FROM train GROUP BY lang""")
def crosstab(spark, folder):
    return G.crosstab(V.train(spark, folder, "lang"), "lang", "label", ["TRUE", "FALSE"])


@query("label_enrichment", f"""
WITH {S.TRAIN}, c AS (SELECT lang, count(*) FILTER (label = 'TRUE') AS label_count, count(*) FILTER (label <> 'TRUE') AS other_count FROM train GROUP BY lang),
s AS (SELECT *, label_count::DOUBLE / greatest(sum(label_count) OVER (), 1) AS ls, other_count::DOUBLE / greatest(sum(other_count) OVER (), 1) AS os FROM c)
SELECT lang, label_count, other_count, {S.r('ls')} AS label_share, {S.r('os')} AS other_share, {S.r('ls / greatest(os, 1e-9)')} AS enrichment FROM s""")
def enrichment(spark, folder):
    return rounded(G.enrichment(V.train(spark, folder, "lang"), "lang", "label", "TRUE"), ["label_share", "other_share", "enrichment"])


@query("label_share", f"""
WITH {S.SCORED} SELECT label, count(*) AS row_count, {S.r('avg(p1)')} AS mean_prob, {S.r('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct,
  {S.r('max(100.0 * count(*)) OVER () / sum(count(*)) OVER ()')} AS majority_pct FROM scored GROUP BY label""")
def label_share(spark, folder):
    return rounded(G.label_share(V.labelled_scores(spark, folder), "label", "p1"), ["mean_prob", "pct", "majority_pct"])


@query("submission_counts_vs_score", f"""
WITH {S.UNSCORED}, l AS ({' UNION ALL '.join(f"SELECT 's{k}' AS submission, p{k} >= 0.32 AS h FROM unscored" for k in range(1, 5))}),
{S.SCORED}, f AS ({' UNION ALL '.join(f"SELECT 's{k}' AS submission, 2.0::DOUBLE * count(*) FILTER (p{k} >= 0.32 AND y = 1) / (count(*) FILTER (p{k} >= 0.32) + count(*) FILTER (y = 1)) AS score FROM scored" for k in range(1, 5))})
SELECT submission, count(*) FILTER (h) AS true_count, count(*) FILTER (NOT h) AS false_count, {S.r('any_value(score)')} AS known_score FROM l JOIN f USING (submission) GROUP BY submission""")
def submission_counts(spark, folder):
    from convosieve.operators.evaluation import metrics_at

    long = V.long_scores(V.unlabelled_scores(spark, folder)).withColumnRenamed("source", "submission")
    h = F.col("prob") >= 0.32
    counts = long.groupBy("submission").agg(F.count_if(h).alias("true_count"), F.count_if(~h).alias("false_count"))
    known = metrics_at(V.long_scores(V.labelled_scores(spark, folder), ["y"]), "prob", 0.32, group="source")
    known = known.select(F.col("source").alias("submission"), F.round("f1", 6).alias("known_score"))
    return counts.join(known, "submission").orderBy(F.desc("known_score"), "submission")
