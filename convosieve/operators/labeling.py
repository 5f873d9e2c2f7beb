"""Conditional labels: outcomes, abnormality scores, weights, buckets, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convosieve.operators.ranking import quantiles_wide


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def outcome(true_label, pred_label) -> Column:
    t, p = _c(true_label), _c(pred_label)
    return (
        F.when((t == "TRUE") & (p == "TRUE"), "true_positive")
        .when((t == "FALSE") & (p == "FALSE"), "true_negative")
        .when((t == "FALSE") & (p == "TRUE"), "false_positive")
        .when((t == "TRUE") & (p == "FALSE"), "false_negative")
        .otherwise("unknown")
    )


def apply_threshold(prob, threshold: float) -> Column:
    return F.when(_c(prob) >= threshold, "TRUE").otherwise("FALSE")


def errors(df: DataFrame, true_label: str = "label", pred_label: str = "pred_label", prob: str = "prob") -> DataFrame:
    """Wrong predictions with their type and the confidence of the wrong side."""
    wrong = df.filter(F.col(true_label) != F.col(pred_label))
    fp = F.col(pred_label) == "TRUE"
    return wrong.withColumn("error_type", F.when(fp, "false_positive").otherwise("false_negative")).withColumn(
        "confidence", F.when(fp, F.col(prob)).otherwise(1.0 - F.col(prob))
    )


# --- fitted thresholds ------------------------------------------------------------

# Threshold name to (feature, quantile).
ABNORMAL_THRESHOLDS = {
    "char_length_p90": ("char_length", 0.90),
    "word_count_p90": ("word_count", 0.90),
    "punctuation_ratio_p90": ("punctuation_ratio", 0.90),
    "special_char_ratio_p90": ("special_char_ratio", 0.90),
    "weird_token_ratio_p90": ("weird_token_ratio", 0.90),
    "repeated_token_count_p90": ("repeated_token_count", 0.90),
    "max_word_length_p95": ("max_word_length", 0.95),
    "stopword_ratio_p10": ("stopword_ratio", 0.10),
}
ARTIFACT_THRESHOLDS = {
    "char_length_p10": ("char_length", 0.10),
    "char_length_p90": ("char_length", 0.90),
    "word_count_p10": ("word_count", 0.10),
    "word_count_p90": ("word_count", 0.90),
    "repeated_token_ratio_p50": ("repeated_token_ratio", 0.50),
    "repeated_token_ratio_p90": ("repeated_token_ratio", 0.90),
    "weird_token_ratio_p50": ("weird_token_ratio", 0.50),
    "weird_token_ratio_p90": ("weird_token_ratio", 0.90),
    "non_ascii_ratio_p90": ("non_ascii_ratio", 0.90),
}


def fit_thresholds(features: DataFrame, specs: dict[str, tuple[str, float]]) -> dict[str, float]:
    """Exact interpolated percentiles of the fitting split, as a small dict of floats."""
    return quantiles_wide(features, specs).first().asDict()


def abnormal_flags(thr: dict[str, float]) -> dict[str, Column]:
    c = F.col
    return {
        "long_chars": c("char_length") >= thr["char_length_p90"],
        "long_words": c("word_count") >= thr["word_count_p90"],
        "punctuation": c("punctuation_ratio") >= thr["punctuation_ratio_p90"],
        "special": c("special_char_ratio") >= thr["special_char_ratio_p90"],
        "weird": (c("weird_token_ratio") >= thr["weird_token_ratio_p90"]) & (c("weird_token_ratio") > 0),
        "repetitive": (c("repeated_token_count") >= thr["repeated_token_count_p90"]) & (c("repeated_token_count") > 0),
        "long_token": c("max_word_length") >= thr["max_word_length_p95"],
        "low_stopword": (c("stopword_ratio") <= thr["stopword_ratio_p10"]) & (c("word_count") >= 8),
        "multi_line": c("newline_count") >= 2,
        "url": c("url_count") > 0,
    }


def abnormal_score(thr: dict[str, float]) -> Column:
    """0..10: how many abnormality conditions hold."""
    return sum((f.cast("int") for f in abnormal_flags(thr).values()), F.lit(0))


def sample_weight(label="label", score="abnormal_score") -> Column:
    """struct(raw_sample_weight, hard_category)."""
    is_true, s = _c(label) == "TRUE", _c(score)

    def pick(w: float, name: str) -> Column:
        return F.struct(F.lit(w).alias("raw_sample_weight"), F.lit(name).alias("hard_category"))

    return (
        F.when(is_true & (s <= 1), pick(2.5, "hard_clean_TRUE"))
        .when(is_true & (s == 2), pick(1.5, "medium_clean_TRUE"))
        .when(is_true & (s >= 4), pick(0.85, "easy_noisy_TRUE"))
        .when(is_true, pick(1.0, "standard_TRUE"))
        .when(s >= 3, pick(2.0, "hard_messy_FALSE"))
        .when(s == 2, pick(1.4, "medium_messy_FALSE"))
        .when(s == 0, pick(0.85, "easy_clean_FALSE"))
        .otherwise(pick(1.0, "standard_FALSE"))
    )


def cue_score() -> Column:
    """0..6 from the five domain-cue counts."""
    has = {n: F.col(f"{n}_term_count") > 0 for n in ("manipulation", "coordination", "insurance", "cryptic")}
    agent = (F.col("agent_marker_count") > 0) & (has["coordination"] | has["cryptic"])
    total = has["manipulation"].cast("int") * 2
    for part in (has["coordination"], has["insurance"], has["cryptic"], agent):
        total = total + part.cast("int")
    return F.least(total, F.lit(6))


def cue_sample_weight(label="label", score="abnormal_score", cue="cue_score") -> Column:
    """struct(raw_sample_weight, hard_category) that also looks at the domain cues."""
    is_true, s, q = _c(label) == "TRUE", _c(score), _c(cue)

    def pick(w: float, name: str) -> Column:
        return F.struct(F.lit(w).alias("raw_sample_weight"), F.lit(name).alias("hard_category"))

    return (
        F.when(is_true & (q >= 2) & (s <= 2), pick(1.9, "hard_ais_clean_TRUE"))
        .when(is_true & (s <= 1), pick(1.7, "hard_clean_TRUE"))
        .when(is_true & (q >= 2), pick(1.4, "ais_signal_TRUE"))
        .when(is_true & (s >= 4) & (q == 0), pick(0.95, "easy_artifact_noisy_TRUE"))
        .when(is_true, pick(1.05, "standard_TRUE"))
        .when((q >= 2) & (s <= 2), pick(1.6, "hard_benign_coordination_FALSE"))
        .when(s >= 3, pick(1.45, "hard_messy_FALSE"))
        .when(s == 2, pick(1.2, "medium_messy_FALSE"))
        .when((s == 0) & (q == 0), pick(0.9, "easy_clean_FALSE"))
        .otherwise(pick(1.0, "standard_FALSE"))
    )


PLAIN_TAG = "plain/coherent-looking"


def review_tags(thr: dict[str, float]) -> Column:
    """Array of review tags; character and word length share one tag."""
    f = abnormal_flags(thr)
    named = [
        (f["long_chars"] | f["long_words"], "long"),
        (f["punctuation"], "punctuation-heavy"),
        (f["weird"], "weird-token"),
        (f["repetitive"], "repetitive"),
        (f["long_token"], "long-token"),
        (f["low_stopword"], "low-stopword"),
        (f["special"], "formatting-noise"),
        (f["multi_line"], "multi-line"),
        (f["url"], "url"),
    ]
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for cond, tag in named]))
    return F.when(F.size(tags) == 0, F.array(F.lit(PLAIN_TAG))).otherwise(tags)


def review_score(tags="tags") -> Column:
    return F.when(F.array_contains(_c(tags), PLAIN_TAG), 0).otherwise(F.size(_c(tags)))


def level_bucket(score="abnormal_score") -> Column:
    return F.when(_c(score) <= 1, "low").when(_c(score) == 2, "mid").otherwise("high")


def failure_category(true_label="label", pred_label="pred_label", prob="prob") -> Column:
    """Ordered precedence over the error feature family of the same row."""
    c = F.col
    t, p, pr = _c(true_label), _c(pred_label), _c(prob)
    noisy = (
        (c("weird_token_ratio") >= 0.08)
        | (c("punctuation_ratio") >= 0.08)
        | (c("long_token_count") >= 1)
        | (c("mixed_alnum_token_count") >= 1)
        | (c("symbol_heavy_token_count") >= 1)
        | (c("newline_count") >= 2)
        | (c("repeated_char_count") >= 1)
    )
    repetitive = (
        (c("repeated_token_ratio") >= 0.20)
        | (c("repeated_phrase_count") >= 1)
        | ((c("word_count") >= 25) & (c("unique_word_ratio") <= 0.72))
    )
    confident = ((p == "TRUE") & (pr >= 0.85)) | ((p == "FALSE") & (pr <= 0.15))
    false_pos = (t == "FALSE") & (p == "TRUE")
    # Below the three artifact categories a row is clean exactly when it is not noisy.
    return (
        F.when(t == p, "BORDERLINE_AMBIGUOUS")
        .when(c("prompt_code_hits") >= 1, "PROMPT_OR_CODE_LEAKAGE")
        .when(c("non_ascii_ratio") >= 0.08, "MULTILINGUAL_OR_ENCODING")
        .when(repetitive, "REPETITIVE_OR_SPAM")
        .when(false_pos & noisy, "NOISY_FALSE")
        .when(false_pos & confident, "LIKELY_LABEL_NOISE")
        .when(false_pos, "BORDERLINE_AMBIGUOUS")
        .when(~noisy & (pr <= 0.05) & (c("word_count") >= 8), "LIKELY_LABEL_NOISE")
        .when(~noisy, "CLEAN_SEMANTIC_TRUE")
        .when(confident, "LIKELY_LABEL_NOISE")
        .otherwise("BORDERLINE_AMBIGUOUS")
    )


def failure_bucket(threshold: float, error_type="error_type", score="review_score", prob="prob") -> Column:
    e, s = _c(error_type), _c(score)
    return (
        F.when(F.abs(_c(prob) - threshold) <= 0.10, "borderline/probability")
        .when(s >= 3, "stylistic/noise-driven")
        .when((e == "false_negative") & (s <= 1), "semantic/subtle")
        .when((e == "false_positive") & (s <= 1), "semantic/label-noise-or-overread")
        .otherwise("mixed")
    )


def artifact_bucket(thr: dict[str, float]) -> Column:
    c = F.col
    short_clean = (
        (c("char_length") <= thr["char_length_p10"])
        & (c("word_count") <= thr["word_count_p10"])
        & (c("weird_token_ratio") <= thr["weird_token_ratio_p50"])
        & (c("repeated_token_ratio") <= thr["repeated_token_ratio_p50"])
    )
    long_noisy = (
        (c("char_length") >= thr["char_length_p90"])
        | (c("word_count") >= thr["word_count_p90"])
        | (c("weird_token_ratio") >= thr["weird_token_ratio_p90"])
        | (c("non_ascii_ratio") >= thr["non_ascii_ratio_p90"])
    )
    return (
        F.when(c("decode_error_flag") > 0, "decode_error")
        .when(c("prompt_or_code_flag") > 0, "prompt_code")
        .when(c("multilingual_or_encoding_flag") > 0, "multilingual")
        .when(short_clean, "short_clean")
        .when(c("repeated_token_ratio") >= thr["repeated_token_ratio_p90"], "repetitive")
        .when(long_noisy, "long_noisy")
        .otherwise("plain_other")
    )


def hard_reason(low: float = 0.05, high: float = 0.95, prob="prob", true_label="label", pred_label="pred_label", listed=None) -> Column:
    """Reasons a row is hard, joined by ``+``; empty when it is not."""
    if not 0.0 <= low <= high <= 1.0:
        raise ValueError("need 0 <= low <= high <= 1")
    parts = [
        F.when(_c(prob).between(low, high), "uncertain_band"),
        F.when(_c(true_label) != _c(pred_label), "wrong_prediction"),
    ]
    if listed is not None:
        parts.append(F.when(_c(listed), "error_analysis"))
    return F.concat_ws("+", *parts)


def conflict_severity(label="label", teacher="teacher_prob") -> Column:
    """struct of the label-cleaning columns: support probability, multiplier, category, conflict flag."""
    is_true, p = _c(label) == "TRUE", _c(teacher)
    severe = (is_true & (p <= 0.05)) | (~is_true & (p >= 0.95))
    moderate = (is_true & (p <= 0.10)) | (~is_true & (p >= 0.90))
    mult = F.when(severe, 0.25).when(moderate, 0.55).otherwise(1.0)
    word = F.when(severe, "severe").when(moderate, "moderate")
    conflict = F.when(is_true, F.concat(word, F.lit("_TRUE_label_teacher_FALSE"))).otherwise(
        F.concat(word, F.lit("_FALSE_label_teacher_TRUE"))
    )
    supported = F.when(is_true, "teacher_supported_TRUE").otherwise("teacher_supported_FALSE")
    return F.struct(
        apply_threshold(p, 0.5).alias("teacher_label"),
        F.when(is_true, p).otherwise(1.0 - p).alias("teacher_label_support_prob"),
        mult.alias("label_cleaning_multiplier"),
        F.coalesce(conflict, supported).alias("label_cleaning_category"),
        (severe | moderate).alias("likely_label_conflict"),
    )


def noise_removal_reason(label="label", prob="prob", true_max: float = 0.05, false_min: float = 0.95) -> Column:
    """Why a training row is dropped as label noise; null when it is kept."""
    return F.when((_c(label) == "TRUE") & (_c(prob) <= true_max), f"TRUE_prob_TRUE_le_{true_max}").when(
        (_c(label) == "FALSE") & (_c(prob) >= false_min), f"FALSE_prob_TRUE_ge_{false_min}"
    )
