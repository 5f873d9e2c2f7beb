"""Bradley-Terry quality scores.

Every document has a strength, linear in its features; a document labelled 1 beats one labelled 0 with the logistic of the difference of
their strengths.  Weights maximise that likelihood (with a small ridge) over preference pairs, by Newton steps on the feature
differences.  The threshold is a quantile of strengths: the share of label 0 among the rows fitted on.

Fitting takes a documented, bounded sample: about `fit_rows` labelled rows, chosen by the hash of their id; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import arrow_schema, batch, fold, pairs, sliced, stored
from convosieve.llm.hashing import word_hashes
from convosieve.llm.profiles import Profile

FEATURES = "doc_id long, features array<double>"
#: Pairs per row of label 0.
OPPONENTS = 20


def features(profile: Profile) -> list[float]:
    """Shares and logarithms that do not depend on the language."""
    n, chars = max(1, profile.n_words), max(1, int(profile.classes.sum()))
    shares = (profile.classes / chars).tolist()
    return [
        *shares, shares[5] > 0.02, shares[1] > 0.3, np.log1p(profile.n_words), profile.word_chars / n, len(set(profile.words)) / n, profile.n_repeat_words / n,
        profile.n_repeat_words > 0.5 * n, profile.n_dup_lines / max(1, profile.n_lines), np.log1p(chars / max(1, profile.n_lines)),
    ]


def _features(schema: pa.Schema):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for own in sliced(batches):
            yield batch([(d, [float(x) for x in features(Profile(t, memo))]) for d, t in pairs(own, "doc_id", "text")], schema)

    return of


@dataclass
class Strength:
    """Standardised features times weights; `threshold` is the strength at the quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def of(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.zeros(len(x))
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, seed: int = 7) -> Strength:
    """Without rows of both labels all strengths are 0."""
    width = x.shape[1] if x.ndim == 2 else 1
    if not len(y) or y.min() == y.max():
        return Strength(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    losers = np.repeat(bad, OPPONENTS)
    differences = z[np.random.default_rng(seed).choice(good, len(losers))] - z[losers]
    w = np.zeros(width)
    for _ in range(50):
        p = 1 / (1 + np.exp(-differences @ w))
        gradient = differences.T @ (p - 1) + ridge * w
        hessian = (differences * (p * (1 - p))[:, None]).T @ differences + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strengths = z @ w
    return Strength(mean, scale, w, float(np.quantile(strengths, (y == 0).mean())))


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, folds: int = 5, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted per row of `docs`; labels of held-out ids are never read.

    The score is a logistic of strength, moved so that the threshold strength scores `cut`.  Null and empty texts are scored from
    their (zero) counts; null ids are never labelled; labels other than 0 and 1 are left out.  Without labels every score is `cut`.
    Very long texts are scored whole, repeated rows each have a row, an empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(rows.mapInArrow(_features(arrow_schema(FEATURES)), FEATURES))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(fold("doc_id", folds) != 0).where("quality IN (0, 1)")
    rate = min(1.0, fit_rows / max(1, usable.count()))
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).limit(2 * fit_rows)
    fitted = found.join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id", "quality", "features")).limit(2 * fit_rows).collect()
    strength = fit(np.array([r["features"] for r in fitted], float), np.array([r["quality"] for r in fitted]))
    shift = strength.threshold - np.log(cut / (1 - cut))
    schema = arrow_schema("doc_id long, score double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            x = np.array(own.column("features").to_pylist(), float)
            if len(x):
                p = 1 / (1 + np.exp(-np.clip(strength.of(x) - shift, -700, 700)))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(p)], schema=schema)

    scored = found.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
