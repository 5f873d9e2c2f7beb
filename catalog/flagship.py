"""Sample-weight flow over the labelled corpus and the labels derived from features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from convosieve.functions.features import add_features
from convosieve.operators import labeling as L
from convosieve.plans import hard_weights as H
from convosieve.sources import tables as V


def quantile_cte(src: str, specs: dict, out: str = "thr") -> str:
    return f"{out} AS (SELECT " + ", ".join(f"quantile_cont({c}, {p}) AS {n}" for n, (c, p) in specs.items()) + f" FROM {src})"


_flags = {
    "long_chars": "char_length >= char_length_p90", "long_words": "word_count >= word_count_p90",
    "punctuation": "punctuation_ratio >= punctuation_ratio_p90", "special": "special_char_ratio >= special_char_ratio_p90",
    "weird": "(weird_token_ratio >= weird_token_ratio_p90 AND weird_token_ratio > 0)",
    "repetitive": "(repeated_token_count >= repeated_token_count_p90 AND repeated_token_count > 0)",
    "long_token": "max_word_length >= max_word_length_p95", "low_stopword": "(stopword_ratio <= stopword_ratio_p10 AND word_count >= 8)",
    "multi_line": "newline_count >= 2", "url": "url_count > 0",
}
SCORE_SQL = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _flags.values())
WEIGHT_SQL = """CASE WHEN label = 'TRUE' THEN CASE WHEN s <= 1 THEN {a} WHEN s = 2 THEN {b} WHEN s >= 4 THEN {c} ELSE {d} END
 ELSE CASE WHEN s >= 3 THEN {e} WHEN s = 2 THEN {f} WHEN s = 0 THEN {g} ELSE {h} END END"""
_w = WEIGHT_SQL.format(a=2.5, b=1.5, c=0.85, d=1.0, e=2.0, f=1.4, g=0.85, h=1.0)
_cat = WEIGHT_SQL.format(a="'hard_clean_TRUE'", b="'medium_clean_TRUE'", c="'easy_noisy_TRUE'", d="'standard_TRUE'", e="'hard_messy_FALSE'",
                         f="'medium_messy_FALSE'", g="'easy_clean_FALSE'", h="'standard_FALSE'")
WEIGHTED = (
    f"WITH {S.TRAIN}, {S.feature_ctes('hard_weight', 'train', 'f', keep='doc_id, label')}, {quantile_cte('f', L.ABNORMAL_THRESHOLDS)}, "
    f"sc AS (SELECT f.*, {SCORE_SQL} AS s FROM f, thr), wt AS (SELECT *, ({_w})::DOUBLE AS rw, {_cat} AS cat FROM sc)"
)


@query("hard_weight_rows", f"""{WEIGHTED}
SELECT doc_id, label, s AS abnormal_score, rw AS raw_sample_weight, cat AS hard_category, {S.r('rw / avg(rw) OVER ()')} AS sample_weight FROM wt""")
def weight_rows(spark, folder):
    rows = H.weighted_rows(V.train(spark, folder))
    return rows.select("doc_id", "label", "abnormal_score", "raw_sample_weight", "hard_category", F.round("sample_weight", 6).alias("sample_weight"))


@query("hard_weight_summary", f"""{WEIGHTED}, nw AS (SELECT *, rw / avg(rw) OVER () AS nw FROM wt)
SELECT label, cat AS hard_category, count(*) AS row_count, {S.r('avg(s)')} AS mean_abnormal_score, {S.r('avg(rw)')} AS mean_raw_weight,
  {S.r('avg(nw)')} AS mean_normalized_weight FROM nw GROUP BY label, cat""")
def weight_summary(spark, folder):
    return H.weight_summary(H.weighted_rows(V.train(spark, folder)))


@query("hard_weight_thresholds", f"""
WITH {S.TRAIN}, {S.feature_ctes('hard_weight', 'train', 'f', keep='doc_id, label')}, {quantile_cte('f', L.ABNORMAL_THRESHOLDS)}
SELECT {', '.join(f'{S.r(n)} AS {n}' for n in L.ABNORMAL_THRESHOLDS)} FROM thr""")
def thresholds(spark, folder):
    feats = add_features(V.train(spark, folder), "hard_weight").drop("text")
    thr = L.fit_thresholds(feats, L.ABNORMAL_THRESHOLDS)
    return spark.createDataFrame([tuple(round(thr[n], 6) for n in L.ABNORMAL_THRESHOLDS)], ", ".join(f"{n} double" for n in L.ABNORMAL_THRESHOLDS))


@query("unlabelled_abnormal_scores", f"""
WITH {S.TRAIN}, {S.TEST}, {S.feature_ctes('hard_weight', 'train', 'f')}, {quantile_cte('f', L.ABNORMAL_THRESHOLDS)},
{S.feature_ctes('hard_weight', 'test', 'g')}, sc AS (SELECT g.*, {SCORE_SQL} AS s FROM g, thr)
SELECT doc_id, s AS abnormal_score, CASE WHEN s <= 1 THEN 'low' WHEN s = 2 THEN 'mid' ELSE 'high' END AS level FROM sc""")
def test_scores(spark, folder):
    thr = L.fit_thresholds(add_features(V.train(spark, folder), "hard_weight").drop("text"), L.ABNORMAL_THRESHOLDS)
    feats = add_features(V.test(spark, folder), "hard_weight").select("doc_id", L.abnormal_score(thr).alias("abnormal_score"))
    return feats.withColumn("level", L.level_bucket())


_cue = ("least(CASE WHEN manipulation_term_count > 0 THEN 2 ELSE 0 END + CASE WHEN coordination_term_count > 0 THEN 1 ELSE 0 END"
        " + CASE WHEN insurance_term_count > 0 THEN 1 ELSE 0 END + CASE WHEN cryptic_term_count > 0 THEN 1 ELSE 0 END"
        " + CASE WHEN agent_marker_count > 0 AND (coordination_term_count > 0 OR cryptic_term_count > 0) THEN 1 ELSE 0 END, 6)")
_CW = [
    ("label = 'TRUE' AND q >= 2 AND s <= 2", 1.9, "hard_ais_clean_TRUE"), ("label = 'TRUE' AND s <= 1", 1.7, "hard_clean_TRUE"),
    ("label = 'TRUE' AND q >= 2", 1.4, "ais_signal_TRUE"), ("label = 'TRUE' AND s >= 4 AND q = 0", 0.95, "easy_artifact_noisy_TRUE"),
    ("label = 'TRUE'", 1.05, "standard_TRUE"), ("q >= 2 AND s <= 2", 1.6, "hard_benign_coordination_FALSE"), ("s >= 3", 1.45, "hard_messy_FALSE"),
    ("s = 2", 1.2, "medium_messy_FALSE"), ("s = 0 AND q = 0", 0.9, "easy_clean_FALSE"), ("TRUE", 1.0, "standard_FALSE"),
]


@query("cue_weight_rows", f"""
WITH {S.TRAIN}, {S.feature_ctes('domain_cues', 'train', 'f', keep='doc_id, label')}, {quantile_cte('f', L.ABNORMAL_THRESHOLDS)},
sc AS (SELECT f.*, {SCORE_SQL} AS s, {_cue} AS q FROM f, thr)
SELECT doc_id, s AS abnormal_score, q AS cue_score, (CASE {' '.join(f'WHEN {c} THEN {w}' for c, w, _ in _CW)} END)::DOUBLE AS raw_sample_weight,
  CASE {' '.join(f"WHEN {c} THEN '{n}'" for c, _, n in _CW)} END AS hard_category FROM sc""")
def cue_weights(spark, folder):
    return H.weighted_rows(V.train(spark, folder), cues=True).select("doc_id", "abnormal_score", "cue_score", "raw_sample_weight", "hard_category")


_TAGS = [
    (f"{_flags['long_chars']} OR {_flags['long_words']}", "long"), (_flags["punctuation"], "punctuation-heavy"), (_flags["weird"], "weird-token"),
    (_flags["repetitive"], "repetitive"), (_flags["long_token"], "long-token"), (_flags["low_stopword"], "low-stopword"), (_flags["special"], "formatting-noise"),
    (_flags["multi_line"], "multi-line"), (_flags["url"], "url"),
]


@query("review_tags", f"""
WITH {S.TRAIN}, {S.feature_ctes('review', 'train', 'f', keep='doc_id, label')}, {quantile_cte('f', L.ABNORMAL_THRESHOLDS)},
tg AS (SELECT doc_id, label, list_filter([{', '.join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _TAGS)}], lambda z: z IS NOT NULL) AS tg FROM f, thr)
SELECT doc_id, label, CASE WHEN len(tg) = 0 THEN 'plain/coherent-looking' ELSE array_to_string(tg, ', ') END AS tags, len(tg)::INTEGER AS review_score FROM tg""")
def tags(spark, folder):
    feats = add_features(V.train(spark, folder), "review").drop("text").persist()
    thr = L.fit_thresholds(feats, L.ABNORMAL_THRESHOLDS)
    tagged = feats.select("doc_id", "label", L.review_tags(thr).alias("tags"))
    return tagged.select("doc_id", "label", F.array_join("tags", ", ").alias("tags"), L.review_score().alias("review_score"))


_AB = """CASE WHEN decode_error_flag > 0 THEN 'decode_error' WHEN prompt_or_code_flag > 0 THEN 'prompt_code' WHEN multilingual_or_encoding_flag > 0 THEN 'multilingual'
 WHEN char_length <= char_length_p10 AND word_count <= word_count_p10 AND weird_token_ratio <= weird_token_ratio_p50 AND repeated_token_ratio <= repeated_token_ratio_p50 THEN 'short_clean'
 WHEN repeated_token_ratio >= repeated_token_ratio_p90 THEN 'repetitive'
 WHEN char_length >= char_length_p90 OR word_count >= word_count_p90 OR weird_token_ratio >= weird_token_ratio_p90 OR non_ascii_ratio >= non_ascii_ratio_p90 THEN 'long_noisy'
 ELSE 'plain_other' END"""
ARTIFACT = (f"{S.feature_ctes('artifact', 'train', 'f', keep='doc_id, label')}, {quantile_cte('f', L.ARTIFACT_THRESHOLDS)}, "
            f"ab AS (SELECT doc_id, label, {_AB} AS bucket FROM f, thr)")


def artifact_rows(spark, folder):
    feats = add_features(V.train(spark, folder), "artifact").drop("text").persist()
    thr = L.fit_thresholds(feats, L.ARTIFACT_THRESHOLDS)
    return feats.select("doc_id", "label", L.artifact_bucket(thr).alias("bucket"))


@query("artifact_buckets", f"WITH {S.TRAIN}, {ARTIFACT} SELECT * FROM ab")
def artifact(spark, folder):
    return artifact_rows(spark, folder)


