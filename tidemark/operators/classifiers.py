"""Distributed model fits. Each ``fit_*`` returns a function that adds the predictions to a frame.

Training frames carry a feature vector and an integer ``label`` (0 or 1). All optimizers are
Spark's own: gradients are summed over the partitions and only the coefficients come back.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.margins import STEPS, LinearMargin, Passes, margins_of, svm_weights
from tidemark.operators.naive_bayes import decide
from tidemark.operators.split import hash_bucket
from tidemark.session import in_parallel, written

Scorer = Callable[[DataFrame], DataFrame]

def class_sizes(train: DataFrame) -> dict[int, int]:
    return {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def _as_double(train: DataFrame, *keep: str) -> DataFrame:
    return train.select(*keep, F.col("label").cast("double").alias("__y"))


def logistic_model(train: DataFrame, features: str, iterations: int = 1000, tolerance: float = 1e-5):
    """L2 logistic regression. A penalty of 1/2 |w|^2 on the sum of the losses equals
    ``regParam`` = 1/n on their mean; features are not rescaled, the intercept is free."""
    n = train.count()
    return LogisticRegression(
        maxIter=iterations,
        tol=tolerance,
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        featuresCol=features,
        labelCol="__y",
    ).fit(_as_double(train, features))


def fit_logistic(train: DataFrame, features: str, iterations: int = 1000, tolerance: float = 1e-5) -> Scorer:
    model = logistic_model(train, features, iterations, tolerance)
    model.setRawPredictionCol("__raw").setProbabilityCol("__prob").setPredictionCol("__pred")

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        p = F.get(vector_to_array("__prob"), F.lit(1))
        return out.withColumn("y_pred", F.col("__pred").cast("int")).withColumn("score", p).drop("__raw", "__prob", "__pred")

    return score


# Spark's normal-equation solver takes at most this many features.
NORMAL_WIDTH = 4096


def _wide_margin(
    train: DataFrame, features: str, sizes: dict[int, int], width: int, penalty: float, rounds: int, tolerance: float
) -> LinearMargin:
    """``svm_margin`` for more than ``NORMAL_WIDTH`` features: ridge regressions are solved iteratively."""
    signed = train.select(features, (2 * F.col("label") - 1).cast("double").alias("__y"))
    rows, balance = sum(sizes.values()), sizes.get(1, 0) - sizes.get(0, 0)
    objective = penalty * rows
    current = LinearMargin(features, np.zeros(width), 0.0)
    for _ in range(rounds):
        spread = math.sqrt(max(0.0, 1 - (balance / rows) ** 2)) if rows else 0.0
        if spread == 0:
            break  # one class left inside the margin: no regression to fit
        near = current.add(signed, "__f").filter(F.col("__y") * F.col("__f") < 1)
        # Spark divides the penalty by the standard deviation of the target.
        ridge = LinearRegression(
            solver="l-bfgs", maxIter=1000, tol=1e-10, regParam=spread / (2 * penalty * rows), elasticNetParam=0.0, standardization=False,
            featuresCol=features, labelCol="__y",
        ).fit(near.select(features, "__y"))
        end = LinearMargin(features, ridge.coefficients.toArray(), float(ridge.intercept))
        moved = signed.withColumn("__m", margins_of([current, end]))
        sums = []
        for i, step in enumerate(STEPS):
            slack = 1 - F.col("__y") * ((1 - step) * F.get("__m", F.lit(0)) + step * F.get("__m", F.lit(1)))
            inside = F.when(slack > 0, 1.0).otherwise(0.0)
            sums += [
                F.sum(inside * slack * slack).alias(f"loss{i}"),
                F.sum(inside).alias(f"rows{i}"),
                F.sum(inside * F.col("__y")).alias(f"balance{i}"),
            ]
        found = moved.agg(*sums).first()
        options = [
            LinearMargin(
                features, (1 - s) * current.coefficients + s * end.coefficients, (1 - s) * current.intercept + s * end.intercept
            )
            for s in STEPS
        ]
        values = [
            0.5 * float(np.dot(o.coefficients, o.coefficients)) + penalty * found[f"loss{i}"] for i, o in enumerate(options)
        ]
        best = min(range(len(STEPS)), key=values.__getitem__)
        gain = objective - values[best]
        if gain <= 0:
            break
        current, objective = options[best], values[best]
        rows, balance = found[f"rows{best}"], found[f"balance{best}"]
        if gain <= tolerance * objective:
            break
    else:
        warnings.warn(f"the linear SVM still improves after {rounds} steps", stacklevel=3)
    return current


def _width(train: DataFrame, features: str) -> int:
    one = train.select(features).first()
    return 0 if one is None else len(one[0])


def svm_margin(
    train: DataFrame, features: str, sizes: dict[int, int], penalty: float = 1.0, rounds: int = 30, tolerance: float = 1e-4
) -> LinearMargin:
    """Linear SVM with squared hinge loss: minimizes 1/2 |w|^2 + penalty * sum max(0, 1 - y f(x))^2.

    On the rows inside the margin the loss is (y - f(x))^2, so a Newton step is a ridge
    regression on those rows. A handful of passes replaces the hundreds that first-order steps
    need. The step length is chosen from one aggregation that evaluates several at once. Up to
    ``NORMAL_WIDTH`` features a step solves the normal equations (see ``margins``); wider ones are solved
    iteratively. A fit that still improves after ``rounds`` steps warns.

    Unlike in libraries that add a constant feature, the intercept is not penalized.
    """
    width = _width(train, features)
    if width > NORMAL_WIDTH:
        return _wide_margin(train, features, sizes, width, penalty, rounds, tolerance)
    passes = Passes(train, features, F.lit(0), width)
    try:
        (w,) = svm_weights(passes, 1, [-1], penalty, rounds, tolerance)
    finally:
        passes.close()
    return LinearMargin(features, w[:-1], float(w[-1]))


def fit_svm(train: DataFrame, features: str) -> Scorer:
    """Predictions by the sign of the margin; ``score`` is the margin."""
    margin = svm_margin(train, features, class_sizes(train))
    return lambda df: margin.add(df, "score").withColumn("y_pred", (F.col("score") > 0).cast("int"))


def fit_calibrated_svm(
    train: DataFrame, features: str, folds: int = 5, seed: int = 17, key: str = "doc_id", threads: int = 5
) -> Scorer:
    """Mean of ``folds`` linear SVMs, each calibrated on the fold it was not trained on.

    The calibration is Platt's: a logistic curve over the margin, fitted to smoothed targets
    (N+ + 1) / (N+ + 2) and 1 / (N- + 2). A soft target t is one row of class 1 with weight t
    and one of class 0 with weight 1 - t. A fold whose training part holds one class only is
    left out of the mean.
    """
    parted = train.withColumn("__fold", hash_bucket(F.col(key), folds, seed))
    counts = parted.groupBy("__fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {(r["__fold"], r["label"]): r["n"] for r in counts}
    total = {c: sum(n for (_, label), n in sizes.items() if label == c) for c in (0, 1)}

    held = {f: {c: sizes.get((f, c), 0) for c in (0, 1)} for f in range(folds)}
    rest = {f: {c: total[c] - held[f][c] for c in (0, 1)} for f in range(folds)}
    kept = [f for f in range(folds) if min(rest[f].values()) > 0 and sum(held[f].values()) > 0]
    if not kept:
        raise ValueError("both classes are needed in the training part of at least one fold")
    width = _width(train, features)
    spark = train.sparkSession
    if width > NORMAL_WIDTH:
        fits = [
            lambda f=f: _wide_margin(parted.filter(F.col("__fold") != f), features, rest[f], width, 1.0, 30, 1e-4) for f in kept
        ]
        margins = in_parallel(spark, fits, threads)
        scored = parted.withColumn("__m", margins_of(margins))
        picked = F.get("__m", F.array_position(F.array(*[F.lit(f) for f in kept]), F.col("__fold")).cast("int") - 1)
        rows = written(scored.select(F.col("__fold").alias("fold"), "label", picked.alias("m")), "margins")
    else:
        passes = Passes(parted, features, F.col("__fold"), width)
        try:
            weights = svm_weights(passes, folds, kept, 1.0, 30, 1e-4)
            rows = written(passes.held_out(dict(zip(kept, weights))), "margins")
        finally:
            passes.close()
        margins = [LinearMargin(features, w[:-1], float(w[-1])) for w in weights]

    def calibrated(f: int) -> tuple[float, float]:
        target = F.when(F.col("label") == 1, (held[f][1] + 1) / (held[f][1] + 2)).otherwise(1 / (held[f][0] + 2))
        soft = rows.filter(F.col("fold") == f).select(
            array_to_vector(F.array("m")).alias("m"),
            F.inline(
                F.array(
                    F.struct(F.lit(1.0).alias("y"), target.alias("w")),
                    F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w")),
                )
            ),
        )
        curve = LogisticRegression(featuresCol="m", labelCol="y", weightCol="w", regParam=0.0, maxIter=100).fit(soft)
        return float(curve.coefficients[0]), float(curve.intercept)

    curves = in_parallel(spark, [lambda f=f: calibrated(f) for f in kept], threads)

    def score(df: DataFrame) -> DataFrame:
        mean = F.lit(0.0)
        for i, (slope, intercept) in enumerate(curves):
            mean = mean + 1 / (1 + F.exp(-(F.get("__m", F.lit(i)) * slope + intercept)))
        out = df.withColumn("__m", margins_of(margins)).withColumn("score", mean / len(curves)).drop("__m")
        return out.withColumn("y_pred", (F.col("score") > 0.5).cast("int"))

    return score


def fit_naive_bayes(train: DataFrame, features: str, sizes: dict[int, int] | None = None) -> Scorer:
    """Multinomial naive Bayes on non-negative vectors, term probabilities smoothed by 1.

    Spark smooths the class priors as well. They are replaced by the plain class shares after
    scoring; a class without training documents is never predicted.
    """
    sizes = sizes or class_sizes(train)
    n = sum(sizes.values())
    model = NaiveBayes(
        smoothing=1.0,
        modelType="multinomial",
        featuresCol=features,
        labelCol="__y",
        rawPredictionCol="__raw",
        probabilityCol="__prob",
        predictionCol="__pred",
    ).fit(_as_double(train, features))
    shift = {c: math.log(sizes[c] / n) - float(model.pi[c]) if sizes.get(c) else None for c in range(len(model.pi))}

    def score(df: DataFrame) -> DataFrame:
        raw = vector_to_array("__raw")
        logs: dict[int, Column] = {
            c: F.lit(None).cast("double") if s is None else F.get(raw, F.lit(c)) + s for c, s in shift.items()
        }
        if 1 not in logs:
            logs[1] = F.lit(None).cast("double")
        y_pred, p = decide(logs)
        out = model.transform(df).withColumn("y_pred", y_pred).withColumn("score", p)
        return out.drop("__raw", "__prob", "__pred")

    return score


def fit_mlp(
    train: DataFrame, features: str, size: int, hidden: int = 128, iterations: int = 60, seed: int = 42, key: str = "doc_id"
) -> tuple[Scorer, float | None]:
    """Small neural net on document vectors; one fifth of the training rows is held out.

    Returns the scorer and the accuracy on the held-out rows (None if there are none).
    """
    marked = train.withColumn("__held", hash_bucket(F.col(key), 5, seed) == 0)
    model = MultilayerPerceptronClassifier(
        layers=[size, hidden, 2], maxIter=iterations, seed=seed, blockSize=128,
        featuresCol=features, labelCol="__y", rawPredictionCol="__raw", probabilityCol="__prob", predictionCol="__pred",
    ).fit(_as_double(marked.filter(~F.col("__held")), features))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df).withColumn("score", F.get(vector_to_array("__prob"), F.lit(1)))
        return out.withColumn("y_pred", (F.col("score") > 0.5).cast("int")).drop("__raw", "__prob", "__pred")

    held = score(marked.filter("__held")).agg(F.avg((F.col("y_pred") == F.col("label")).cast("double")).alias("a"))
    return score, held.first()["a"]


def fit_regression(train: DataFrame, features: str, target: str, iterations: int = 100) -> Scorer:
    """Ridge regression of a real target, penalty 1/n on the mean squared error; adds ``y_hat``."""
    n = train.count()
    model = LinearRegression(
        maxIter=iterations, regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
        featuresCol=features, labelCol=target, predictionCol="y_hat",
    ).fit(train.select(features, target))
    return lambda df: model.transform(df)
