"""Teacher targets, pseudo-labels, label cleaning, hard subsets, occurrence-key alignment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convosieve.functions import text as T
from convosieve.functions.scalar import probability_entropy
from convosieve.operators import labeling as L
from convosieve.operators.ranking import occurrence_number
from convosieve.operators.stats import stack


def keep_first(df: DataFrame, keys: list[str], order: Column | str, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``; combines map-side, so hot keys are cheap."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    o = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick(row, o).alias("_r")).select("_r.*")


# --- alignment by occurrence ------------------------------------------------------


def _occurrence_keys(df: DataFrame, text: str, label: str | None, id_col: str) -> DataFrame:
    parts = [T.normalize_text(text)]
    if label:
        parts = [T.normalize_label(label), *parts]
    keyed = df.withColumn("_key", F.sha2(F.concat_ws("::", *parts), 256))
    return occurrence_number(keyed, ["_key"], id_col, "_occ")


def align_by_occurrence(
    targets: DataFrame, predictions: DataFrame, prob: str, text: str = "text", label: str | None = None,
    id_col: str = "doc_id", pred_id: str = "doc_id",
) -> DataFrame:
    """Attach a score to each target row: copies of a text pair up 1:1 in id order."""
    left = _occurrence_keys(targets.select(id_col, text, *([label] if label else [])), text, label, id_col).select(id_col, "_key", "_occ")
    preds = predictions.filter(F.col(prob).isNotNull() & ~F.isnan(F.col(prob)))
    right = _occurrence_keys(preds.select(F.col(pred_id).alias("_pid"), text, prob, *([label] if label else [])), text, label, "_pid")
    right = right.select("_key", "_occ", "_pid", F.col(prob).alias("aligned_prob"))
    return left.join(right, ["_key", "_occ"], "full_outer").select(id_col, "_pid", "aligned_prob")


def alignment_report(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """matched, coverage and unmatched prediction rows of an alignment."""
    hit = F.col(id_col).isNotNull() & F.col("_pid").isNotNull()
    got = aligned.agg(
        F.count(F.col(id_col)).alias("target_rows"), F.count(F.col("_pid")).alias("prediction_rows"),
        F.count_if(hit).alias("matched_rows"), F.count_if(F.col(id_col).isNull()).alias("unmatched_rows"),
    )
    return got.withColumn("coverage", F.col("matched_rows") / F.greatest(F.col("target_rows"), F.lit(1)))


# --- teachers ---------------------------------------------------------------------


def quality_weights(metrics: DataFrame, manual: str = "manual_weight") -> DataFrame:
    """manual weight x mean(f1, roc_auc) of the metrics that are present (1 when none is)."""
    vals = F.filter(F.array("f1", "roc_auc"), lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals)
    quality = F.when(F.size(vals) > 0, mean).otherwise(1.0)
    return metrics.withColumn("quality_weight", quality).withColumn("weight", F.col(manual) * F.col("quality_weight"))


def usable_sources(long: DataFrame, total_rows: int, min_coverage: float = 0.05, exclude_partial: bool = False) -> DataFrame:
    """(source, coverage, included) by the share of rows a source scores."""
    got = long.groupBy("source").agg(F.count("prob").alias("scored_rows"))
    got = got.withColumn("coverage", F.col("scored_rows") / F.lit(max(total_rows, 1)))
    keep = (F.col("coverage") > 0) & (F.col("coverage") >= min_coverage)
    if exclude_partial:
        keep = keep & (F.col("coverage") >= 0.999)
    return got.withColumn("included", keep)


def soft_targets(
    long: DataFrame, weights: dict[str, float], id_col: str = "doc_id", entropy_weight: float = 0.6, disagreement_weight: float = 0.6,
) -> DataFrame:
    """Weighted mean, spread, entropy, agreement and sample weight over the available teachers of each row.

    ``long`` is (id, source, prob); one aggregate of sum(w), sum(wp), sum(wp^2).
    """
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source"))
    p = F.col("prob")
    ok = p.isNotNull() & ~F.isnan(p) & w.isNotNull()
    sums = long.groupBy(id_col).agg(
        F.sum(F.when(ok, w)).alias("sw"), F.sum(F.when(ok, w * p)).alias("swp"), F.sum(F.when(ok, w * p * p)).alias("swpp"),
        F.count_if(ok).alias("teacher_count"),
    )
    mean = F.try_divide("swp", "sw")
    # The variance of equal scores is 0; the difference of squares may leave rounding dust.
    var = F.greatest(F.round(F.try_divide("swpp", "sw") - mean * mean, 14), F.lit(0.0))
    out = sums.select(id_col, "teacher_count", mean.alias("teacher_prob_TRUE"), F.sqrt(var).alias("teacher_prob_std"))
    entropy = probability_entropy("teacher_prob_TRUE") / math.log(2.0)
    disagreement = F.least(F.col("teacher_prob_std") / 0.25, F.lit(1.0))
    has = F.col("teacher_count") > 0
    return out.withColumns({
        "teacher_pred_label": L.apply_threshold("teacher_prob_TRUE", 0.5),
        "teacher_entropy": F.when(has, entropy),
        "agreement_score": F.when(has, 1.0 - disagreement),
        "disagreement_score": F.when(has, disagreement).otherwise(1.0),
        "sample_weight": F.when(has, 1.0 + entropy_weight * entropy + disagreement_weight * disagreement).otherwise(1.0),
    })


# --- pseudo-labels ----------------------------------------------------------------


def consensus_pseudo_labels(
    scores: DataFrame, prob: str = "consensus_prob_TRUE", count: str = "teacher_count", std: str = "teacher_prob_std",
    positive: float = 0.83, negative: float = 0.03, max_per_class: int = 150, min_teachers: int = 2, max_std: float = 0.15,
    id_col: str = "doc_id",
) -> DataFrame:
    """Confident rows of both classes, the same number of each (a bounded top-k per class)."""
    ok = scores.filter(
        F.col(prob).isNotNull() & (F.col(count) >= min_teachers) & (F.col(std).isNull() | F.isnan(std) | (F.col(std) <= max_std))
    )
    pos, neg = ok.filter(F.col(prob) >= positive), ok.filter(F.col(prob) <= negative)
    sizes = ok.agg(F.count_if(F.col(prob) >= positive), F.count_if(F.col(prob) <= negative)).first()
    quota = min(max_per_class, sizes[0], sizes[1])
    p = pos.orderBy(F.desc(prob), F.desc(count), id_col).limit(quota).withColumn("pseudo_label", F.lit("TRUE"))
    n = neg.orderBy(F.asc(prob), F.desc(count), id_col).limit(quota).withColumn("pseudo_label", F.lit("FALSE"))
    both = p.unionByName(n).withColumn("pseudo_prob_TRUE", F.col(prob))
    return both.withColumn("pseudo_label_int", F.when(F.col("pseudo_label") == "TRUE", 1).otherwise(0))


def threshold_pseudo_labels(scores: DataFrame, prob: str, high: float = 0.95, low: float = 0.05) -> DataFrame:
    hit = F.when(F.col(prob) >= high, "TRUE").when(F.col(prob) <= low, "FALSE")
    return scores.withColumn("pseudo_label", hit).filter("pseudo_label is not null")


def pseudo_summary(scores: DataFrame, prob: str, high: float = 0.95, low: float = 0.05) -> DataFrame:
    c = F.col(prob)
    got = scores.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c >= high).alias("pseudo_true"), F.count_if((c <= low) & ~(c >= high)).alias("pseudo_false")
    )
    total = F.col("pseudo_true") + F.col("pseudo_false")
    return got.select("pseudo_true", "pseudo_false", total.alias("pseudo_total"), (F.col("n") - total).alias("ignored_rows"))


# --- cleaning and combined weights ------------------------------------------------


def clean_labels(df: DataFrame, label: str = "label", prob: str = "prob", true_max: float = 0.05, false_min: float = 0.95) -> dict[str, DataFrame]:
    """Kept rows, removed rows with their reason, and the three label distributions."""
    tagged = df.withColumn("removal_reason", L.noise_removal_reason(label, prob, true_max, false_min))
    gone = F.col("removal_reason").isNotNull()
    one = tagged.agg(*[
        F.count_if((F.col(label) == v) & cond).alias(f"{k}_{v}")
        for k, cond in (("original", F.lit(True)), ("removed", gone), ("final", ~gone)) for v in ("TRUE", "FALSE")
    ])
    summary = stack(one, [
        {"stage": F.lit(k), "TRUE": F.col(f"{k}_TRUE"), "FALSE": F.col(f"{k}_FALSE")} for k in ("original", "removed", "final")
    ])
    return {"kept": tagged.filter(~gone).drop("removal_reason"), "removed": tagged.filter(gone), "summary": summary}


def normalize_weight(df: DataFrame, raw: str = "raw_sample_weight", out: str = "sample_weight") -> DataFrame:
    """Divide by the mean weight of the table."""
    mean = df.agg(F.avg(raw)).first()[0] or 0.0
    return df.withColumn(out, F.col(raw) / max(mean, 1e-12))


# --- hard subset ------------------------------------------------------------------


def support_sizes(false0: int, true0: int, pool_false: int, pool_true: int, min_rows: int = 300, max_rows: int = 350, fraction: float = 0.35) -> tuple[int, int]:
    """How many support rows each class gets, in closed form."""
    n = false0 + true0
    short = math.ceil((fraction * n - false0) / (1 - fraction) - 1e-9)
    add_false = min(pool_false, max(0, min(max_rows - n, max(min_rows - n, short))))
    n += add_false
    short_true = math.ceil((fraction * n - true0) / (1 - fraction) - 1e-9)
    add_true = min(pool_true, max(0, min(max_rows - n, short_true)))
    return add_false, add_true


def hard_subset(
    scored: DataFrame, threshold: float, low: float = 0.05, high: float = 0.95, listed: str | None = None, key: str = "text_key",
    id_col: str = "doc_id", min_rows: int = 300, max_rows: int = 350, fraction: float = 0.35,
) -> DataFrame:
    """Uncertain, wrong or listed rows, topped up with the nearest-to-boundary rows of each class.

    ``scored`` has (id, key, label, pred_label, prob).  Support rows are a bounded top-k.
    """
    tagged = scored.withColumn("source_reason", L.hard_reason(low, high, "prob", "label", "pred_label", listed))
    core = keep_first(tagged.filter(F.col("source_reason") != ""), [key], id_col)
    pool = keep_first(scored.join(core.select(key), key, "left_anti"), [key], id_col)
    pool = pool.withColumn("_d", F.round(F.abs(F.col("prob") - threshold), 12))
    n = core.agg(F.count_if(F.col("label") == "FALSE"), F.count_if(F.col("label") == "TRUE")).first()
    m = pool.agg(F.count_if(F.col("label") == "FALSE"), F.count_if(F.col("label") == "TRUE")).first()
    kf, kt = support_sizes(n[0], n[1], m[0], m[1], min_rows, max_rows, fraction)
    cols = core.columns
    f = pool.filter(F.col("label") == "FALSE").orderBy("_d", F.desc("prob"), id_col).limit(kf).withColumn("source_reason", F.lit("support_FALSE_near_boundary"))
    t = pool.filter(F.col("label") == "TRUE").orderBy("_d", F.asc("prob"), id_col).limit(kt).withColumn("source_reason", F.lit("support_TRUE_near_boundary"))
    return core.unionByName(f.select(cols)).unionByName(t.select(cols))


def label_consistency(hard: DataFrame, train: DataFrame, key: str = "text_key", id_col: str = "doc_id") -> DataFrame:
    """Hard rows missing from the training table, and rows whose labels disagree."""
    known = keep_first(train.select(key, id_col, "label"), [key], id_col).select(key, F.col("label").alias("train_label"))
    return hard.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("train_label").isNull()).alias("missing_rows"),
        F.count_if(F.col("train_label").isNotNull() & (F.col("train_label") != F.col("label"))).alias("mismatched_rows"),
    )
