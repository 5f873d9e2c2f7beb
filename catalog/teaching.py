"""Teacher targets, pseudo-labels, label cleaning, hard subsets, alignment by occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from catalog.ensembles import ULONG
from catalog.evaluation import LONG, PRED, predicted, rounded
from catalog.flagship import WEIGHTED
from convosieve.functions import text as T
from convosieve.operators import labeling as L
from convosieve.operators import stats as G
from convosieve.operators import targets as N
from convosieve.operators.evaluation import metrics_at, roc_auc
from convosieve.plans import hard_weights as H
from convosieve.sources import tables as V

# Weights of the four teachers.
TEACHERS = {"s1": 1.0, "s2": 0.9, "s3": 0.8, "s4": 0.7}
_tw = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TEACHERS.items())


@query("teacher_quality_weights", f"""
WITH {LONG}, w AS (SELECT * FROM (VALUES {_tw}) v(source, manual_weight)), f AS (SELECT source, 2.0::DOUBLE * count(*) FILTER (y = 1 AND prob >= 0.32) / (count(*) FILTER (prob >= 0.32) + count(*) FILTER (y = 1)) AS f1 FROM long GROUP BY source),
rk AS (SELECT source, y, rank() OVER w2 + (count(*) OVER (PARTITION BY source, prob) - 1) / 2.0::DOUBLE AS ar FROM long WINDOW w2 AS (PARTITION BY source ORDER BY prob)),
a AS (SELECT source, (sum(ar) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc FROM rk GROUP BY source)
SELECT source, {S.r('(f1 + roc_auc) / 2')} AS quality_weight, {S.r('manual_weight * (f1 + roc_auc) / 2')} AS weight FROM w JOIN f USING (source) JOIN a USING (source)""")
def quality(spark, folder):
    long = V.long_scores(V.labelled_scores(spark, folder), ["y"])
    m = metrics_at(long, "prob", 0.32, group="source").select("source", "f1").join(roc_auc(long, "prob", group="source").select("source", "roc_auc"), "source")
    manual = F.element_at(F.create_map(*[F.lit(x) for kv in TEACHERS.items() for x in kv]), F.col("source"))
    return rounded(N.quality_weights(m.withColumn("manual_weight", manual)), ["quality_weight", "weight"]).select("source", "quality_weight", "weight")


def _partial(df):
    """Teachers of uneven coverage: the third and fourth skip some rows."""
    skip = ((F.col("source") == "s3") & (F.col("doc_id") % 3 == 0)) | ((F.col("source") == "s4") & (F.col("doc_id") % 40 != 0))
    return df.withColumn("prob", F.when(~skip, F.col("prob")))


_part = "CASE WHEN (source = 's3' AND doc_id % 3 = 0) OR (source = 's4' AND doc_id % 40 <> 0) THEN NULL ELSE prob END"
TEACH = f"{ULONG}, pt AS (SELECT doc_id, source, {_part} AS prob FROM long)"


@query("teacher_source_coverage", f"""
WITH {TEACH}, n AS (SELECT count(DISTINCT doc_id) AS n FROM pt) SELECT source, count(prob) AS scored_rows, {S.r('count(prob)::DOUBLE / any_value(n)')} AS coverage, count(prob)::DOUBLE / any_value(n) >= 0.05 AS included FROM pt, n GROUP BY source""")
def source_coverage(spark, folder):
    wide = V.unlabelled_scores(spark, folder)
    return rounded(N.usable_sources(_partial(V.long_scores(wide)), wide.count()), ["coverage"])


_ent = "-(c * ln(c) + (1 - c) * ln(1 - c)) / ln(2.0::DOUBLE)"
SOFT = f"""{TEACH}, w AS (SELECT * FROM (VALUES {_tw}) v(source, w)), m AS (SELECT doc_id, sum(w * prob) / sum(w) AS mu, count(*) AS tc FROM pt JOIN w USING (source) WHERE prob IS NOT NULL GROUP BY doc_id),
sd AS (SELECT doc_id, any_value(mu) AS mu, any_value(tc) AS tc, sqrt(sum(w * (prob - mu) * (prob - mu)) / sum(w)) AS sd FROM pt JOIN w USING (source) JOIN m USING (doc_id) WHERE prob IS NOT NULL GROUP BY doc_id),
so AS (SELECT *, greatest(least(mu, 1 - 1e-6), 1e-6) AS c, least(sd / 0.25, 1.0) AS dis FROM sd)"""
_SOFT = ["teacher_prob_TRUE", "teacher_prob_std", "teacher_entropy", "agreement_score", "disagreement_score", "sample_weight"]


def _soft(spark, folder):
    return N.soft_targets(_partial(V.long_scores(V.unlabelled_scores(spark, folder))), TEACHERS)


@query("teacher_soft_targets", f"""
WITH {SOFT} SELECT doc_id, tc AS teacher_count, {S.r('mu')} AS "teacher_prob_TRUE", {S.r('sd')} AS teacher_prob_std, CASE WHEN mu >= 0.5 THEN 'TRUE' ELSE 'FALSE' END AS teacher_pred_label, {S.r(_ent)} AS teacher_entropy,
 {S.r('1 - dis')} AS agreement_score, {S.r('dis')} AS disagreement_score, {S.r(f'1 + 0.6 * ({_ent}) + 0.6 * dis')} AS sample_weight FROM so""")
def soft(spark, folder):
    return rounded(_soft(spark, folder), _SOFT)


@query("teacher_count_distribution", f"WITH {SOFT} SELECT tc AS teacher_count, count(*) AS row_count FROM so GROUP BY tc")
def teacher_counts(spark, folder):
    return G.value_counts(_soft(spark, folder), "teacher_count")


@query("consensus_pseudo_labels", f"""
WITH {SOFT}, ok AS (SELECT * FROM so WHERE tc >= 2 AND sd <= 0.25), p AS (SELECT *, row_number() OVER (ORDER BY mu DESC, tc DESC, doc_id) AS n FROM ok WHERE mu >= 0.60), g AS (SELECT *, row_number() OVER (ORDER BY mu, tc DESC, doc_id) AS n FROM ok WHERE mu <= 0.30),
k AS (SELECT least(150, (SELECT count(*) FROM p), (SELECT count(*) FROM g)) AS k)
SELECT doc_id, {S.r('mu')} AS "pseudo_prob_TRUE", 'TRUE' AS pseudo_label, 1 AS pseudo_label_int FROM p, k WHERE n <= k UNION ALL SELECT doc_id, {S.r('mu')}, 'FALSE', 0 FROM g, k WHERE n <= k""")
def consensus(spark, folder):
    got = N.consensus_pseudo_labels(_soft(spark, folder).persist(), "teacher_prob_TRUE", positive=0.60, negative=0.30, max_std=0.25)
    return rounded(got, ["pseudo_prob_TRUE"]).select("doc_id", "pseudo_prob_TRUE", "pseudo_label", "pseudo_label_int")


@query("threshold_pseudo_labels", f"WITH {S.UNSCORED} SELECT doc_id, CASE WHEN p1 >= 0.95 THEN 'TRUE' ELSE 'FALSE' END AS pseudo_label FROM unscored WHERE p1 >= 0.95 OR p1 <= 0.05")
def pseudo(spark, folder):
    return N.threshold_pseudo_labels(V.unlabelled_scores(spark, folder), "p1").select("doc_id", "pseudo_label")


@query("pseudo_label_summary", f"""
WITH {S.UNSCORED} SELECT count(*) FILTER (p1 >= 0.95) AS pseudo_true, count(*) FILTER (p1 <= 0.05) AS pseudo_false, count(*) FILTER (p1 >= 0.95 OR p1 <= 0.05) AS pseudo_total,
 count(*) FILTER (p1 < 0.95 AND p1 > 0.05) AS ignored_rows FROM unscored""")
def pseudo_summary(spark, folder):
    return N.pseudo_summary(V.unlabelled_scores(spark, folder), "p1")


@query("augmented_training_rows", f"""
WITH {S.UNSCORED}, {S.TRAIN} SELECT doc_id, label, 'train' AS origin FROM train UNION ALL SELECT doc_id, CASE WHEN p1 >= 0.95 THEN 'TRUE' ELSE 'FALSE' END, 'pseudo' FROM unscored WHERE p1 >= 0.95 OR p1 <= 0.05""")
def augmented(spark, folder):
    extra = N.threshold_pseudo_labels(V.unlabelled_scores(spark, folder), "p1").select("doc_id", F.col("pseudo_label").alias("label"), F.lit("pseudo").alias("origin"))
    return V.labels(spark, folder).withColumn("origin", F.lit("train")).unionByName(extra)


_reason = "CASE WHEN label = 'TRUE' AND p1 <= 0.35 THEN 'TRUE_prob_TRUE_le_0.35' WHEN label = 'FALSE' AND p1 >= 0.65 THEN 'FALSE_prob_TRUE_ge_0.65' END"


def _cleaned(spark, folder):
    return N.clean_labels(V.labelled_scores(spark, folder).select("doc_id", "label", F.col("p1").alias("prob")), true_max=0.35, false_min=0.65)


@query("label_noise_removed", f"WITH {S.SCORED}, r AS (SELECT doc_id, label, {S.r('p1')} AS prob, {_reason} AS removal_reason FROM scored) SELECT * FROM r WHERE removal_reason IS NOT NULL")
def removed(spark, folder):
    return rounded(_cleaned(spark, folder)["removed"], ["prob"])


@query("label_noise_summary", f"WITH {S.SCORED}, r AS (SELECT label, {_reason} IS NOT NULL AS g FROM scored) " + " UNION ALL ".join(
    f"SELECT '{n}' AS stage, count(*) FILTER (label = 'TRUE' AND {c}) AS \"TRUE\", count(*) FILTER (label = 'FALSE' AND {c}) AS \"FALSE\" FROM r" for n, c in (("original", "TRUE"), ("removed", "g"), ("final", "NOT g"))))
def noise_summary(spark, folder):
    return _cleaned(spark, folder)["summary"]


# A steep transform of the scores, so that all conflict levels occur.
_steep = "greatest(least((p1 - 0.5) * 1.6 + 0.5, 1.0), 0.0)"
_sev = """CASE WHEN label = 'TRUE' THEN CASE WHEN tp <= 0.05 THEN {s} WHEN tp <= 0.10 THEN {m} ELSE {o} END ELSE CASE WHEN tp >= 0.95 THEN {s} WHEN tp >= 0.90 THEN {m} ELSE {o} END END"""
_mult = _sev.format(s="0.25", m="0.55", o="1.0")
_cc = """CASE WHEN label = 'TRUE' THEN CASE WHEN tp <= 0.05 THEN 'severe_TRUE_label_teacher_FALSE' WHEN tp <= 0.10 THEN 'moderate_TRUE_label_teacher_FALSE' ELSE 'teacher_supported_TRUE' END
 ELSE CASE WHEN tp >= 0.95 THEN 'severe_FALSE_label_teacher_TRUE' WHEN tp >= 0.90 THEN 'moderate_FALSE_label_teacher_TRUE' ELSE 'teacher_supported_FALSE' END END"""
_CONF = f"{S.SCORED}, tq AS (SELECT doc_id, label, {_steep} AS tp FROM scored)"


def _steep_scores(spark, folder):
    p = F.greatest(F.least((F.col("p1") - 0.5) * 1.6 + 0.5, F.lit(1.0)), F.lit(0.0))
    return V.labelled_scores(spark, folder).select("doc_id", "label", p.alias("teacher_prob"))


@query("label_conflicts", f"""
WITH {_CONF} SELECT doc_id, CASE WHEN tp >= 0.5 THEN 'TRUE' ELSE 'FALSE' END AS teacher_label, {S.r("CASE WHEN label = 'TRUE' THEN tp ELSE 1 - tp END")} AS teacher_label_support_prob, ({_mult})::DOUBLE AS label_cleaning_multiplier,
 {_cc} AS label_cleaning_category, ({_mult}) < 1.0 AS likely_label_conflict FROM tq""")
def conflicts(spark, folder):
    out = _steep_scores(spark, folder).select("doc_id", L.conflict_severity().alias("c")).select("doc_id", "c.*")
    return rounded(out, ["teacher_label_support_prob"])


@query("combined_weight_summary", f"""
{WEIGHTED}, {S.SCORED.replace('lab AS', 'lab8 AS').replace('FROM lab)', 'FROM lab8)')}, cw AS (SELECT wt.label, cat, s, rw, {_steep} AS tp FROM wt JOIN scored USING (doc_id)),
cx AS (SELECT *, ({_mult})::DOUBLE AS mu, {_cc} AS cc FROM cw), cy AS (SELECT *, rw * mu AS w, rw * mu / avg(rw * mu) OVER () AS nw FROM cx)
SELECT label, cat AS hard_category, cc AS label_cleaning_category, count(*) AS row_count, {S.r('avg(s)')} AS mean_abnormal_score, {S.r('avg(tp)')} AS "mean_teacher_prob_TRUE", {S.r('avg(mu)')} AS mean_label_cleaning_multiplier,
 {S.r('avg(rw)')} AS mean_base_raw_weight, {S.r('avg(w)')} AS mean_raw_weight, {S.r('avg(nw)')} AS mean_normalized_weight FROM cy GROUP BY ALL""")
def combined_weights(spark, folder):
    rows = H.weighted_rows(V.train(spark, folder)).drop("sample_weight").withColumnRenamed("raw_sample_weight", "base_weight")
    both = rows.join(_steep_scores(spark, folder).drop("label"), "doc_id").withColumn("c", L.conflict_severity())
    both = both.select("label", "hard_category", "abnormal_score", "teacher_prob", "base_weight", "c.label_cleaning_multiplier", "c.label_cleaning_category")
    both = N.normalize_weight(both.withColumn("raw_sample_weight", F.col("base_weight") * F.col("label_cleaning_multiplier")).persist())
    means = {
        "mean_abnormal_score": "abnormal_score", "mean_teacher_prob_TRUE": "teacher_prob", "mean_label_cleaning_multiplier": "label_cleaning_multiplier", "mean_base_raw_weight": "base_weight",
        "mean_raw_weight": "raw_sample_weight", "mean_normalized_weight": "sample_weight",
    }
    return both.groupBy("label", "hard_category", "label_cleaning_category").agg(F.count(F.lit(1)).alias("row_count"), *[F.round(F.avg(c), 6).alias(n) for n, c in means.items()])


# --- hard subset -------------------------------------------------------------------

# Band, target sizes relative to the fixture.
_LOW, _HIGH, _MIN, _MAX = 0.30, 0.40, 150, 180
_HARD = f"""{PRED}, tx AS (SELECT p.*, md5({S.norm('text')}) AS tk FROM pred p JOIN documents USING (doc_id)),
rs AS (SELECT *, concat_ws('+', CASE WHEN prob BETWEEN {_LOW} AND {_HIGH} THEN 'uncertain_band' END, CASE WHEN label <> pred_label THEN 'wrong_prediction' END) AS source_reason FROM tx),
co AS (SELECT * FROM rs WHERE source_reason <> '' QUALIFY row_number() OVER (PARTITION BY tk ORDER BY doc_id) = 1),
po AS (SELECT *, round(abs(prob - 0.32::DOUBLE), 12) AS d FROM tx WHERE tk NOT IN (SELECT tk FROM co) QUALIFY row_number() OVER (PARTITION BY tk ORDER BY doc_id) = 1),
sz AS (SELECT (SELECT count(*) FROM co) AS n0, (SELECT count(*) FROM co WHERE label = 'FALSE') AS f0, (SELECT count(*) FROM po WHERE label = 'FALSE') AS pf, (SELECT count(*) FROM po WHERE label = 'TRUE') AS pt),
kf AS (SELECT *, least(pf, greatest(0, least({_MAX} - n0, greatest({_MIN} - n0, ceil((0.35 * n0 - f0) / 0.65 - 1e-9))))) AS kf FROM sz),
kt AS (SELECT *, least(pt, greatest(0, least({_MAX} - (n0 + kf), ceil((0.35 * (n0 + kf) - (n0 - f0)) / 0.65 - 1e-9)))) AS kt FROM kf),
fs AS (SELECT *, row_number() OVER (ORDER BY d, prob DESC, doc_id) AS n FROM po WHERE label = 'FALSE'), ts AS (SELECT *, row_number() OVER (ORDER BY d, prob, doc_id) AS n FROM po WHERE label = 'TRUE'),
hard AS (SELECT doc_id, tk, label, source_reason, prob FROM co UNION ALL SELECT doc_id, tk, label, 'support_FALSE_near_boundary', prob FROM fs, kt WHERE n <= kf UNION ALL SELECT doc_id, tk, label, 'support_TRUE_near_boundary', prob FROM ts, kt WHERE n <= kt)"""


def _hard(spark, folder):
    keyed = V.documents(spark, folder).select("doc_id", F.md5(T.normalize_text("text")).alias("text_key"))
    scored = predicted(spark, folder).drop("y").join(keyed, "doc_id").persist()
    return N.hard_subset(scored, 0.32, _LOW, _HIGH, min_rows=_MIN, max_rows=_MAX), scored


@query("hard_subset", f"WITH {_HARD} SELECT doc_id, label, source_reason FROM hard")
def hard_subset(spark, folder):
    return _hard(spark, folder)[0].select("doc_id", "label", "source_reason")


@query("hard_subset_reasons", f"""
WITH {_HARD} SELECT 'exact' AS kind, source_reason AS reason, count(*) AS row_count FROM hard GROUP BY 2 UNION ALL SELECT 'token', r, count(*) FROM (SELECT unnest(string_split(source_reason, '+')) AS r FROM hard) GROUP BY r""")
def hard_reasons(spark, folder):
    return G.reason_counts(_hard(spark, folder)[0], "source_reason")


@query("hard_subset_consistency", f"""
WITH {_HARD}, kn AS (SELECT tk, min_by(label, doc_id) AS tl FROM tx GROUP BY tk)
SELECT count(*) AS row_count, count(*) FILTER (tl IS NULL) AS missing_rows, count(*) FILTER (tl <> label) AS mismatched_rows FROM hard LEFT JOIN kn USING (tk)""")
def hard_consistency(spark, folder):
    hard, scored = _hard(spark, folder)
    return N.label_consistency(hard, scored)


# --- alignment ---------------------------------------------------------------------

_ALIGN = f"""{S.UNSCORED}, tg AS (SELECT doc_id, md5({S.norm('text')}) AS k FROM documents), pr AS (SELECT doc_id AS pid, p1 AS prob FROM unscored),
tk AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS o FROM tg), pk AS (SELECT pid, prob, k, row_number() OVER (PARTITION BY k ORDER BY pid) AS o FROM pr JOIN tg ON tg.doc_id = pid),
aj AS (SELECT doc_id, pid, prob FROM tk FULL JOIN pk USING (k, o))"""


def _aligned(spark, folder):
    docs = V.documents(spark, folder).select("doc_id", "text")
    preds = docs.join(V.unlabelled_scores(spark, folder).select("doc_id", F.col("p1").alias("prob")), "doc_id")
    return N.align_by_occurrence(docs, preds, "prob")


@query("occurrence_alignment", f"WITH {_ALIGN} SELECT doc_id, pid AS _pid, {S.r('prob')} AS aligned_prob FROM aj")
def aligned(spark, folder):
    return rounded(_aligned(spark, folder), ["aligned_prob"])


@query("occurrence_alignment_report", f"""
WITH {_ALIGN} SELECT count(doc_id) AS target_rows, count(pid) AS prediction_rows, count(*) FILTER (doc_id IS NOT NULL AND pid IS NOT NULL) AS matched_rows, count(*) FILTER (doc_id IS NULL) AS unmatched_rows,
 {S.r('count(*) FILTER (doc_id IS NOT NULL AND pid IS NOT NULL)::DOUBLE / count(doc_id)')} AS coverage FROM aj""")
def alignment_report(spark, folder):
    return rounded(N.alignment_report(_aligned(spark, folder)), ["coverage"])
