"""Blends, votes, rank ensembles, swaps and routing over the scores of unlabelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from catalog.evaluation import rounded
from convosieve.functions import lexicons as lex
from convosieve.operators import ensemble as M
from convosieve.operators import labeling as L
from convosieve.operators.ranking import percentile_rank
from convosieve.operators import sampling as P
from convosieve.sources import readers as R
from convosieve.sources import tables as V

ULONG = f"{S.UNSCORED}, long AS (" + " UNION ALL ".join(f"SELECT doc_id, 's{k}' AS source, p{k} AS prob FROM unscored" for k in range(1, 5)) + ")"


@query("blend_grid", f"""
WITH {S.UNSCORED}, w AS (SELECT unnest({lex.BLEND_WEIGHTS})::DOUBLE AS w), t AS (SELECT unnest({lex.BLEND_THRESHOLDS})::DOUBLE AS t)
SELECT w AS first_weight, round(1.0::DOUBLE - w, 6) AS second_weight, t AS threshold, count(*) FILTER (w * p1 + (1.0::DOUBLE - w) * p2 >= t) AS "pred_TRUE",
  count(*) FILTER (w * p1 + (1.0::DOUBLE - w) * p2 < t) AS "pred_FALSE" FROM unscored, w, t GROUP BY w, t""")
def grid(spark, folder):
    return M.blend_grid(V.unlabelled_scores(spark, folder), "p1", "p2")


_named = ", ".join(f"('{n}', {w}::DOUBLE, {t}::DOUBLE)" for n, w, t in lex.NAMED_BLENDS)


@query("named_blends", f"""
WITH {S.UNSCORED}, c AS (SELECT * FROM (VALUES {_named}) v(candidate, w, t)), x AS (SELECT *, w * p1 + (1.0::DOUBLE - w) * p2 >= t AS h FROM unscored, c)
SELECT candidate, w AS first_weight, t AS threshold, count(*) FILTER (h) AS "pred_TRUE", count(*) FILTER (NOT h) AS "pred_FALSE",
  count(*) FILTER (h <> (p1 >= 0.32)) AS changed_vs_first, count(*) FILTER (h <> (p2 >= 0.32)) AS changed_vs_second FROM x GROUP BY ALL""")
def named(spark, folder):
    return M.named_blends(V.unlabelled_scores(spark, folder), "p1", "p2")


@query("two_run_blend", f"""
WITH {S.UNSCORED}, c AS (SELECT unnest({lex.TWO_RUN_WEIGHTS})::DOUBLE AS w), x AS (SELECT *, w * p3 + (1.0::DOUBLE - w) * p4 >= 0.32 AS h FROM unscored, c)
SELECT w AS main_weight, round(1.0::DOUBLE - w, 6) AS other_weight, count(*) FILTER (h) AS "pred_TRUE", count(*) FILTER (NOT h) AS "pred_FALSE",
  count(*) FILTER (h <> (p3 >= 0.32)) AS changed_vs_main, count(*) FILTER (h <> (p4 >= 0.32)) AS changed_vs_other, {S.r('avg(abs(p3 - p4))')} AS avg_abs_delta,
  {S.r('max(abs(p3 - p4))')} AS max_abs_delta FROM x GROUP BY w""")
def two_run(spark, folder):
    return rounded(M.two_run_blend(V.unlabelled_scores(spark, folder), "p3", "p4"), ["avg_abs_delta", "max_abs_delta"])


_votes = "v AS (SELECT p1 >= 0.5 AS a, p2 >= 0.5 AS b FROM unscored)"


@query("hard_label_votes", f"WITH {S.UNSCORED}, {_votes} " + " UNION ALL ".join(
    f"SELECT 'vote_{n}' AS rule, count(*) FILTER ({c}) AS \"pred_TRUE\", count(*) FILTER (NOT ({c})) AS \"pred_FALSE\", count(*) FILTER (a = b) AS agree_count, "
    f"count(*) FILTER (a <> b) AS disagree_count, {S.r('count(*) FILTER (a = b)::DOUBLE / count(*)')} AS agree_ratio FROM v"
    for n, c in (("or", "a OR b"), ("and", "a AND b"), ("anchor", "a"))))
def votes(spark, folder):
    df = V.unlabelled_scores(spark, folder).select("doc_id", L.apply_threshold("p1", 0.5).alias("a"), L.apply_threshold("p2", 0.5).alias("b"))
    return rounded(M.vote_report(M.vote(df, "a", "b")), ["agree_ratio"])


_pr = "(rank() OVER (PARTITION BY source ORDER BY prob) + (count(*) OVER (PARTITION BY source, prob) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY source)"
RANKED = f"{ULONG}, rk AS (SELECT *, {_pr} AS pr FROM long)"


@query("percentile_ranks", f"WITH {RANKED} SELECT doc_id, source, {S.r('pr', 9)} AS pct_rank FROM rk")
def pct(spark, folder):
    df = V.long_scores(V.unlabelled_scores(spark, folder))
    return percentile_rank(df, "prob", "doc_id", "source").select("doc_id", "source", F.round("pct_rank", 9).alias("pct_rank"))


# Recipe weights of the rank ensemble; the last source is never available.
RECIPES = {
    "anchor_rank_light": {"s1": 0.80, "s2": 0.08, "s3": 0.04, "s4": 0.04, "s5": 0.02},
    "anchor_rank_balanced": {"s1": 0.70, "s2": 0.10, "s3": 0.07, "s4": 0.06, "s5": 0.03},
    "anchor_rank_calibrator": {"s1": 0.78, "s2": 0.14, "s3": 0.08, "s4": 0.00, "s5": 0.00},
    "anchor_rank_second": {"s1": 0.82, "s2": 0.00, "s3": 0.00, "s4": 0.10, "s5": 0.05},
}
_AVAILABLE = ["s1", "s2", "s3", "s4"]
WEIGHTS = {r: M.normalize_weights(w, _AVAILABLE) for r, w in RECIPES.items()}
_rec = ", ".join(f"('{r}', '{s}', {w!r}::DOUBLE)" for r, ws in WEIGHTS.items() for s, w in ws.items())
ENS = f"{RANKED}, rec AS (SELECT * FROM (VALUES {_rec}) v(recipe, source, w)), ens AS (SELECT doc_id, recipe, round(sum(w * pr), 12) AS score FROM rk JOIN rec USING (source) GROUP BY ALL)"


@query("rank_ensemble_scores", f"WITH {ENS} SELECT doc_id, recipe, {S.r('score', 9)} AS score FROM ens")
def ensemble_scores(spark, folder):
    long = V.long_scores(V.unlabelled_scores(spark, folder))
    return M.rank_ensemble(long, WEIGHTS).withColumn("score", F.round("score", 9))


@query("rank_ensemble_manifest", f"""
WITH {ENS}, pos AS (SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY score DESC, doc_id) AS n FROM ens), a AS (SELECT doc_id, prob AS ap, pr AS ar, prob >= 0.5 AS al FROM rk WHERE source = 's1'),
k AS (SELECT unnest({lex.ENSEMBLE_COUNTS}) AS k), x AS (SELECT recipe, k, n <= k AS sel, ap, ar, al FROM pos JOIN a USING (doc_id), k)
SELECT recipe, k AS requested, count(*) FILTER (sel) AS true_count, count(*) FILTER (NOT sel) AS false_count, count(*) FILTER (al) AS anchor_true_count,
  count(*) FILTER (sel <> al) AS changed_vs_anchor, {S.r('avg(ap) FILTER (sel)')} AS mean_anchor_prob, {S.r('min(ap) FILTER (sel)')} AS min_anchor_prob,
  {S.r('avg(ar) FILTER (sel)')} AS mean_anchor_rank FROM x GROUP BY recipe, k""")
def ensemble_manifest(spark, folder):
    wide = V.unlabelled_scores(spark, folder)
    scores = M.rank_ensemble(V.long_scores(wide), WEIGHTS).persist()
    anchor = percentile_rank(wide.select("doc_id", F.col("p1").alias("anchor_prob")), "anchor_prob", out="anchor_rank")
    anchor = anchor.withColumn("anchor_label", L.apply_threshold("anchor_prob", 0.5))
    out = M.ensemble_manifest(scores, anchor, lex.ENSEMBLE_COUNTS)
    return rounded(out, ["mean_anchor_prob", "min_anchor_prob", "mean_anchor_rank"])


@query("source_summary", f"""
WITH {ULONG} SELECT source, count(*) AS row_count, {S.r('min(prob)')} AS min, {S.r('avg(prob)')} AS mean, {S.r('max(prob)')} AS max, {S.r('quantile_cont(prob, 0.95)')} AS p95 FROM long GROUP BY source""")
def source_summary(spark, folder):
    return rounded(M.source_summary(V.long_scores(V.unlabelled_scores(spark, folder))), ["min", "mean", "max", "p95"])


@query("joined_sources", f"WITH {S.UNSCORED} SELECT doc_id, {', '.join(f'{S.r(f"p{k}", 9)} AS s{k}' for k in range(1, 5))} FROM unscored")
def joined(spark, folder):
    long = V.long_scores(V.unlabelled_scores(spark, folder))
    return rounded(R.join_sources(long, _AVAILABLE), _AVAILABLE, 9)


_RBLEND = f"""{S.UNSCORED}, rb AS (SELECT doc_id, (rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0::DOUBLE) / count(*) OVER () AS r1,
  (rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0::DOUBLE) / count(*) OVER () AS r2 FROM unscored)"""
_RBL = ", ".join(f"round({w}::DOUBLE * r1 + (1.0::DOUBLE - {w}::DOUBLE) * r2, 12) AS rank_blend_{int(round(w * 100)):03d}" for w in lex.RANK_BLEND_WEIGHTS)


@query("rank_blends", f"WITH {_RBLEND} SELECT doc_id, {_RBL.replace(', 12)', ', 9)')} FROM rb")
def rank_blends(spark, folder):
    names = [f"rank_blend_{int(round(w * 100)):03d}" for w in lex.RANK_BLEND_WEIGHTS]
    return rounded(M.rank_blends(V.unlabelled_scores(spark, folder), "p1", "p2"), names, 9).select("doc_id", *names)


@query("rank_blend_selection", f"""
WITH {_RBLEND}, b AS (SELECT doc_id, {_RBL} FROM rb), o AS (SELECT *, row_number() OVER (ORDER BY rank_blend_090 DESC, doc_id) AS n FROM b)
SELECT k AS count, count(*) FILTER (n <= k) AS selected, {S.r('min(rank_blend_090) FILTER (n <= k)')} AS threshold_floor FROM o, (SELECT unnest({lex.CALIBRATOR_COUNTS}) AS k) GROUP BY k""")
def rank_blend_selection(spark, folder):
    df = M.rank_blends(V.unlabelled_scores(spark, folder), "p1", "p2").select("doc_id", "rank_blend_090").persist()
    return rounded(P.select_counts(df, "rank_blend_090", lex.CALIBRATOR_COUNTS), ["threshold_floor"])


# Signal weights of the consensus.
SIGNALS = {"p2": 0.5, "p3": 0.3, "p4": 0.2}
SWAPS = [5, 10, 20, 40]
_r01 = {k: f"(row_number() OVER (ORDER BY p{k}, doc_id) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1)" for k in range(1, 5)}
SWAP = f"""{S.UNSCORED}, q AS (SELECT *, {', '.join(f'{e} AS r{k}' for k, e in _r01.items())}, CASE WHEN p1 >= 0.5 THEN 'TRUE' ELSE 'FALSE' END AS base_label FROM unscored),
c AS (SELECT *, (r2 * 0.5::DOUBLE + r3 * 0.3::DOUBLE + r4 * 0.2::DOUBLE) / 1.0::DOUBLE AS cons, (p2 + p3 + p4) / 3 AS mn, greatest(p2, p3, p4) AS hi, least(p2, p3, p4) AS lo FROM q),
sw AS (SELECT *, round(0.45::DOUBLE * cons + 0.25::DOUBLE * r1 + 0.20::DOUBLE * mn + 0.10::DOUBLE * hi, 12) AS f2t,
  round(0.45::DOUBLE * (1 - cons) + 0.30::DOUBLE * (1 - r1) + 0.15::DOUBLE * (1 - mn) + 0.10::DOUBLE * (1 - lo), 12) AS t2f FROM c),
ord AS (SELECT *, CASE WHEN base_label = 'FALSE' THEN f2t ELSE t2f END AS swap_score FROM sw),
sr AS (SELECT *, row_number() OVER (PARTITION BY base_label ORDER BY swap_score DESC, doc_id) AS swap_rank FROM ord)"""


def _swaps(spark, folder):
    df = V.unlabelled_scores(spark, folder)
    return M.swap_scores(df, "p1", SIGNALS).withColumn("base_label", L.apply_threshold("p1", 0.5)).persist()


@query("swap_scores", f"WITH {SWAP} SELECT doc_id, base_label, {S.r('cons')} AS consensus_true_rank, {S.r('f2t')} AS false_to_true_score, {S.r('t2f')} AS true_to_false_score FROM sw")
def swap_scores(spark, folder):
    cols = ["consensus_true_rank", "false_to_true_score", "true_to_false_score"]
    return rounded(_swaps(spark, folder), cols).select("doc_id", "base_label", *cols)


@query("swap_actions", f"""
WITH {SWAP} SELECT doc_id, swap_rank, {', '.join(f"CASE WHEN swap_rank > {n} THEN 'keep' WHEN base_label = 'FALSE' THEN 'FALSE_to_TRUE' ELSE 'TRUE_to_FALSE' END AS swap_{n:02d}_action" for n in SWAPS)} FROM sr""")
def swap_actions(spark, folder):
    return M.balanced_swaps(_swaps(spark, folder), "base_label", SWAPS)["diagnostics"].select("doc_id", "swap_rank", *[f"swap_{n:02d}_action" for n in SWAPS])


@query("swap_manifest", f"""
WITH {SWAP} SELECT k AS swap_count, count(*) FILTER (swap_rank <= k) AS total_changed, count(*) FILTER ((base_label = 'TRUE') <> (swap_rank <= k)) AS "pred_TRUE",
  count(*) FILTER ((base_label = 'TRUE') = (swap_rank <= k)) AS "pred_FALSE", {S.r("avg(swap_score) FILTER (swap_rank <= k AND base_label = 'FALSE')")} AS mean_false_to_true_score,
  {S.r("avg(swap_score) FILTER (swap_rank <= k AND base_label = 'TRUE')")} AS mean_true_to_false_score FROM sr, (SELECT unnest({SWAPS}) AS k) GROUP BY k""")
def swap_manifest(spark, folder):
    return M.balanced_swaps(_swaps(spark, folder), "base_label", SWAPS)["manifest"]


_bands = ", ".join(f"('low_{lo:.2f}_high_{hi:.2f}', {lo}::DOUBLE, {hi}::DOUBLE)".replace("0.", "0p", 2) for lo, hi in lex.ROUTER_BANDS)
ROUTE = f"""{S.UNSCORED}, bd AS (SELECT * FROM (VALUES {_bands}) v(route_band, lo, hi)),
rt AS (SELECT doc_id, route_band, lo, hi, p1, CASE WHEN p1 < lo THEN 'base_low_confident_FALSE' WHEN p1 > hi THEN 'base_high_confident_TRUE' ELSE 'specialist_uncertain_band' END AS route_used,
  CASE WHEN p1 < lo OR p1 > hi THEN p1 >= 0.32 ELSE p2 >= 0.5 END AS f FROM unscored, bd)"""


def _routed(spark, folder):
    return M.route(V.unlabelled_scores(spark, folder), "p1", "p2", 0.32, 0.5)


@query("routed_labels", f"WITH {ROUTE} SELECT doc_id, route_band, route_used, CASE WHEN f THEN 'TRUE' ELSE 'FALSE' END AS final_label FROM rt")
def routed(spark, folder):
    return _routed(spark, folder).select("doc_id", "route_band", "route_used", "final_label")


@query("route_summary", f"""
WITH {ROUTE} SELECT route_band, lo, hi, count(*) FILTER (route_used = 'base_low_confident_FALSE') AS base_low_rows, count(*) FILTER (route_used = 'base_high_confident_TRUE') AS base_high_rows,
  count(*) FILTER (route_used = 'specialist_uncertain_band') AS specialist_rows, count(*) FILTER (f) AS "pred_TRUE", count(*) FILTER (NOT f) AS "pred_FALSE",
  count(*) FILTER (f <> (p1 >= 0.32)) AS changed_vs_base FROM rt GROUP BY ALL""")
def route_summary(spark, folder):
    return M.route_summary(_routed(spark, folder), "p1", 0.32)
