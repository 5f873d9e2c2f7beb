"""Classification on dense features with pyspark.ml; `text_models` has the n-gram models."""

from __future__ import annotations

import itertools
import warnings
from multiprocessing.pool import ThreadPool

from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.functions import lexicons as lex
from convosieve.functions.features import add_features
from convosieve.functions.scalar import safe_logit
from convosieve.operators.evaluation import best_threshold, roc_auc, threshold_sweep
from convosieve.operators.sampling import folds
from convosieve.session import checkpoint


#: The tolerance ends a fit; one that gets here is reported as not converged.
MAX_ITER = 2_000


class EngineeredFeatures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that appends the 15 engineered text features."""

    def __init__(self, inputCol: str = "text"):
        super().__init__()
        self._set(inputCol=inputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return add_features(df, "engineered", self.getInputCol())


def class_weights(df: DataFrame, y: str = "y") -> dict[int, float]:
    """n / (2 n_c) per class."""
    sizes = {r[0]: r[1] for r in df.groupBy(y).agg(F.count(F.lit(1))).collect()}
    total = sum(sizes.values())
    return {int(k): total / (len(sizes) * v) for k, v in sizes.items()}


def _weight_col(weights: dict[int, float], y: str):
    return F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (int(k), float(v))]), F.col(y).cast("int"))


def fit_logreg(train: DataFrame, y: str = "y", c: float = 1.0, balanced: bool = True, max_iter: int = MAX_ITER, standardize: bool = False):
    """L2 logistic regression; ``c`` is the inverse penalty of the summed loss."""
    weights = class_weights(train, y) if balanced else {0: 1.0, 1: 1.0}
    weighted = train.withColumn("_w", _weight_col(weights, y))
    n = weighted.agg(F.sum("_w")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=y, weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=max_iter, standardization=standardize)
    model = lr.fit(weighted)
    if model.summary.totalIterations >= max_iter:
        warnings.warn(f"logistic regression did not converge in {max_iter} iterations", stacklevel=2)
    return model


def predict(model, df: DataFrame, out: str = "prob") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fold_average(scores: DataFrame, id_col: str = "doc_id", prob: str = "prob") -> DataFrame:
    """Mean and population deviation over folds or seeds."""
    return scores.groupBy(id_col).agg(F.avg(prob).alias("prob_mean"), F.stddev_pop(prob).alias("prob_std"), F.count(prob).alias("models"))


def embedding_baseline(train: DataFrame, test: DataFrame, vec: str = "embedding", id_col: str = "vec_id", max_iter: int = MAX_ITER) -> DataFrame:
    to = lambda d: d.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return predict(fit_logreg(to(train), max_iter=max_iter), to(test)).select(id_col, "prob")


# --- style calibrator -------------------------------------------------------------


def _moments(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations (1 for a constant feature)."""
    s = df.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    return [m or 0.0 for m in s[: len(features)]], [d or 1.0 for d in s[len(features) :]]


def _scaled(mean: list[float], dev: list[float], features: list[str]):
    vec = F.array(*[(F.col(f) - m) / d for f, m, d in zip(features, mean, dev)])
    return lambda d: d.withColumn("features", array_to_vector(vec))


def calibrator_frame(scored: DataFrame, text: str = "text", prob: str = "prob") -> DataFrame:
    """Score logit next to the style features."""
    return add_features(scored, "style", text).withColumn("score_logit", safe_logit(prob))


def calibrator_search(
    frame: DataFrame, feature_sets=None, c_values=None, class_weight=("none", "balanced"), k: int = 5, id_col: str = "doc_id", grid=None,
    max_iter: int = MAX_ITER, parallelism: int = 8,
) -> DataFrame:
    """One row per candidate: tuned threshold (ties towards 0.32), F1, AUC over inner out-of-fold scores.

    Features are scaled once per fold and feature set; candidates are fitted ``parallelism`` at a time on all rows of
    the other folds.  All rows are then scored by all candidates in one pass over the models of their fold, a table of one row per
    candidate and fold.
    """
    feature_sets = feature_sets or lex.CALIBRATOR_FEATURE_SETS
    columns = sorted({c for cols in feature_sets.values() for c in cols})
    # Every candidate runs many small jobs over this table: cut its lineage once.
    data = checkpoint(folds(frame.select(id_col, "y", *columns), "y", k, id_col))
    tables = {}
    for (name, cols), i in itertools.product(feature_sets.items(), range(k)):
        fit = data.filter(F.col("fold") != i)
        mean, dev = _moments(fit, cols)
        tables[name, i] = mean, dev, checkpoint(_scaled(mean, dev, cols)(fit).select("y", "features"))

    def candidate(task) -> tuple:
        (name, i), c, cw = task
        mean, dev, scaled = tables[name, i]
        model = fit_logreg(scaled, c=c, balanced=cw == "balanced", max_iter=max_iter)
        raw = {f: float(w) / s for f, w, s in zip(feature_sets[name], model.coefficients.toArray(), dev)}
        start = float(model.intercept) - sum(raw[f] * m for f, m in zip(feature_sets[name], mean))
        return f"{name}|{c}|{cw}", i, start, [raw.get(f, 0.0) for f in columns]

    tasks = list(itertools.product(tables, c_values or lex.CALIBRATOR_C, class_weight))
    with ThreadPool(parallelism) as pool:
        models = pool.map(candidate, tasks, chunksize=1)
    models = frame.sparkSession.createDataFrame(models, "candidate string, fold int, start double, w array<double>")
    scored = data.withColumn("x", F.array(*[F.col(c).cast("double") for c in columns])).join(F.broadcast(models), "fold")
    margin = F.aggregate(F.zip_with("x", "w", lambda x, w: x * w), F.col("start"), lambda a, b: a + b)
    oof = checkpoint(scored.select(id_col, "y", "candidate", (1.0 / (1.0 + F.exp(-margin))).alias("prob")))
    best = best_threshold(threshold_sweep(oof, "prob", grid or lex.THRESHOLD_GRID_WIDE, group="candidate"), 0.32, "candidate")
    auc = roc_auc(oof, "prob", group="candidate").select("candidate", "roc_auc")
    split = F.split("candidate", r"\|")
    return best.join(auc, "candidate").select(
        split[0].alias("feature_set"), split[1].cast("double").alias("c"), split[2].alias("class_weight"), "threshold", "precision", "recall", "f1", "roc_auc"
    ).orderBy(F.desc("f1"), F.desc("roc_auc"), "feature_set", "c", "class_weight")


def fit_calibrator(frame: DataFrame, test: DataFrame, features: list[str], c: float, balanced: bool, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Final model: calibrated test scores and the coefficients by absolute size."""
    scale = _scaled(*_moments(frame, features), features)
    model = fit_logreg(checkpoint(scale(frame).select("y", "features")), c=c, balanced=balanced)
    scores = predict(model, scale(test), "calibrated_prob_TRUE")
    coefs = [(f, float(w), abs(float(w))) for f, w in zip(features, model.coefficients.toArray())]
    table = frame.sparkSession.createDataFrame(coefs, "feature string, coefficient double, abs_coefficient double")
    return {"scores": scores.drop("features"), "coefficients": table.orderBy(F.desc("abs_coefficient"), "feature")}


