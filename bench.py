"""Headline queries, timed end to end on one machine.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog
from convosieve.session import local_session

HEADLINE = [
    "hard_weight_summary", "features_basic", "features_style", "features_hard_weight", "features_noise", "features_error",
    "features_engineered", "feature_rare_tokens", "text_match_keys", "profile_duplicates", "metrics_at_threshold", "roc_auc_by_source", "threshold_sweep", "failure_summary",
    "percentile_ranks", "rank_ensemble_manifest", "swap_manifest", "route_summary", "stratified_folds", "style_effect_sizes", "word_log_odds",
    "word_ngram_counts", "duplicate_groups_all_documents", "cross_matches_template_key", "word_tfidf_neighbors", "embedding_neighbors", "strong_patterns",
    "teacher_soft_targets", "hard_subset", "occurrence_alignment_report", "heuristic_tags",
    "char_tfidf_neighbors", "duplicate_group_members_all_documents", "char_log_odds", "near_duplicate_pairs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", int(cores))
    catalog.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
