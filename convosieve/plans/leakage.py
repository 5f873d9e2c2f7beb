"""Leakage inspection of a labelled corpus against an unlabelled one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.operators import similarity as D
from convosieve.session import checkpoint


def inspect(train: DataFrame, test: DataFrame, train_id: str = "doc_id", test_id: str = "doc_id", label: str = "label", char_min: float = 0.85, word_min: float = 0.80) -> dict[str, DataFrame]:
    """Key matches, duplicates, neighbours by both n-gram views and the resulting leakage cases.

    Both inputs carry the match keys (see ``similarity.add_keys``).
    """
    flags = {f"has_{k}_match": D.matched_rows(train, test, f"{k}_key", test_id) for k in ("exact", "loose", "template")}
    labels = train.select(F.col(train_id).alias("train_id"), F.col(label).alias("train_label"))
    best = {
        m: checkpoint(D.tfidf_neighbors(train, test, m, 1, train_id, test_id).join(labels, "train_id"))
        for m in ("char_tfidf_3_5", "word_tfidf_1_2")
    }
    return {
        **{f"cross_{k}": D.cross_matches(train, test, f"{k}_key", train_id, label, test_id, 2 if k == "shape" else 1) for k in ("exact", "loose", "template", "shape")},
        "train_duplicates": D.duplicate_groups(train, "exact_key", train_id, label),
        "test_duplicates": D.duplicate_groups(test, "exact_key", test_id),
        "char_best": best["char_tfidf_3_5"],
        "word_best": best["word_tfidf_1_2"],
        "leakage_cases": D.leakage_cases(best["char_tfidf_3_5"], best["word_tfidf_1_2"], flags, char_min, word_min),
    }
