"""Sample-weight flow: features, fitted percentiles, abnormality score, weight, normalisation, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.functions.features import add_features
from convosieve.functions.scalar import r6
from convosieve.operators import labeling as L
from convosieve.operators.targets import normalize_weight


def weighted_rows(train: DataFrame, cues: bool = False, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Features, abnormal_score, raw_sample_weight, hard_category, sample_weight (mean 1) per labelled row.

    The text is scanned once: features are persisted without it, since fitting the
    percentiles and normalising the weights each need another pass over the numbers.
    """
    feats = add_features(train, "domain_cues" if cues else "hard_weight").drop("text").persist()
    thr = thresholds or L.fit_thresholds(feats, L.ABNORMAL_THRESHOLDS)
    scored = feats.withColumn("abnormal_score", L.abnormal_score(thr))
    if cues:
        scored = scored.withColumn("cue_score", L.cue_score())
    picked = scored.withColumn("_w", L.cue_sample_weight() if cues else L.sample_weight())
    return normalize_weight(picked.select(*scored.columns, "_w.*"))


def weight_summary(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.groupBy("label", "hard_category", *extra).agg(
        F.count(F.lit(1)).alias("row_count"),
        r6(F.avg("abnormal_score")).alias("mean_abnormal_score"),
        r6(F.avg("raw_sample_weight")).alias("mean_raw_weight"),
        r6(F.avg("sample_weight")).alias("mean_normalized_weight"),
    )
