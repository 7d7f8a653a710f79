"""Regression with a Gaussian kernel in time linear in the rows.

Random Fourier features stand in for the kernel: the cosine of a document's projection on a random
direction, shifted by a random phase; the mean product of two documents' features approaches
exp(-gamma * distance^2). Directions and phases are hashes of (term, place, seed), so nothing is drawn,
stored or sent besides the vocabulary, and any engine that has md5 gets the same features.

The loss is epsilon-insensitive: errors within ``epsilon`` cost nothing, others their excess. For an error
r it is (|r - epsilon| + |r + epsilon|) / 2 - epsilon. Each modulus |u| is rounded off to sqrt(u^2 + mu^2), and
the sum with 1/2 |w|^2 is minimized by reweighted ridge steps: second derivatives are the weights, and a step is
one pass that adds up the normal equations of all rows, of ``size + 1`` unknowns. When a step has little left to gain, mu falls.
Where the full step does not lower the objective enough, a shorter one is taken whose value the same pass measured.

The same pass bounds the distance to the optimum of the loss that is not rounded off: its slopes are multipliers
within [-cost, cost], which give a lower bound (the dual value). The fit ends when the gap is below
``tolerance`` of the objective, and warns if ``most`` passes do not get there. The intercept is the coefficient of a
constant feature and is penalized like the others.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import lookup
from tidemark.operators.terms import document_keys, exploded_terms

# The first rounding mu, its divisor after a full step, and the parts of a step that are tried.
FIRST, DIVISOR = 0.25, 4.0
PARTS = np.concatenate([[0.0], 0.5 ** np.arange(12)])


def _uniform(text: Column, start: int) -> Column:
    """A number in (0, 1) from eight hexadecimal digits of the text's md5."""
    digits = F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(4294967296.0)


def directions(words: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Words (``term`` and other columns) with ``direction``: ``size`` normal numbers, by hash of word and place."""

    def normal(place: Column) -> Column:
        text = F.concat_ws("-", F.col("term"), place.cast("string"), F.lit(str(seed)))
        return F.sqrt(-2 * F.log(_uniform(text, 1))) * F.cos(2 * math.pi * _uniform(text, 9))

    return words.withColumn("direction", F.transform(F.sequence(F.lit(1), F.lit(size)), normal))


def phases(size: int, seed: int = 42) -> list[Column]:
    """The phase of each feature, between 0 and two pi."""
    return [2 * math.pi * _uniform(F.lit(f"phase-{j}-{seed}"), 1) for j in range(1, size + 1)]


def scale_gamma(docs: DataFrame, words: DataFrame, width: int) -> float:
    """1 over ``width`` times the variance of all entries of the documents' unit vectors; 1 without variance.

    ``words`` is (term, idf) with ``width`` rows. One row with two sums per document is aggregated.
    """
    keys = document_keys(docs)
    raw = F.col("tf") * F.col("idf")
    entries = lookup(exploded_terms(docs, *keys, outer=True), words.select("term", "idf"), bound=width)
    per = entries.groupBy(*keys).agg(F.sum(raw).alias("total"), F.sum(raw * raw).alias("squares"))
    length = F.sqrt(F.nullif("squares", F.lit(0.0)))
    row = per.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("total") / length).alias("total"), F.count(length).alias("units")
    ).first()
    if not row["n"] or not row["units"]:
        return 1.0
    cells = row["n"] * width
    spread = width * (row["units"] / cells - (row["total"] / cells) ** 2)
    return 1.0 / spread if spread > 0 else 1.0


def fourier_features(
    docs: DataFrame, words: DataFrame, size: int, gamma: float, seed: int = 42, keep: Sequence[str] = (), bound: int | None = None
) -> DataFrame:
    """(document keys, keep, features): ``size`` Fourier features of the document's unit TF-IDF vector.

    ``docs`` carries ``terms``, ``words`` is (term, idf), ``bound`` its row count where that is known. A task
    sums a document's projections before the exchange. A document without known words is the zero vector.
    """
    keys = [*document_keys(docs), *keep]
    table = directions(words.select("term", "idf"), size, seed)
    rows = lookup(exploded_terms(docs, *keys, outer=True), table, bound=bound).withColumn("raw", F.col("tf") * F.col("idf"))
    sums = [F.sum(F.col("raw") * F.get("direction", F.lit(j))).alias(f"p{j}") for j in range(size)]
    summed = rows.groupBy(*keys).agg(F.sum(F.col("raw") * F.col("raw")).alias("squares"), *sums)
    reach = math.sqrt(2 * gamma) / F.sqrt(F.nullif("squares", F.lit(0.0)))
    made = [
        math.sqrt(2 / size) * F.cos(F.coalesce(F.col(f"p{j}") * reach, F.lit(0.0)) + phase)
        for j, phase in enumerate(phases(size, seed))
    ]
    return summed.select(*keys, F.array(*made).alias("features"))


def rounded_loss(error: np.ndarray, epsilon: float, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rounded loss at each error, its slope and its second derivative."""
    up, down = np.hypot(error - epsilon, mu), np.hypot(error + epsilon, mu)
    slope = ((error - epsilon) / up + (error + epsilon) / down) / 2
    return (up + down) / 2 - epsilon, slope, mu * mu * (up**-3 + down**-3) / 2


def normal_equations(
    data: DataFrame, target: str, size: int, point: np.ndarray, step: np.ndarray, mu: float, next_mu: float, epsilon: float, cost: float
) -> dict[str, np.ndarray]:
    """Sums over all rows of ``features`` and ``target``, added up by cell.

    ``values`` are the losses at ``mu`` after each of ``PARTS`` of the step. The rest holds after the full
    step: ``gram`` and ``right`` are the equations of the next point at ``next_mu``, ``loss`` is the loss that is not
    rounded off, ``pull`` and ``gain`` belong to the multipliers at ``mu``. A task sends one row per cell, however many rows it reads.
    """
    width = size + 1

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if not len(frame):
                continue
            z = np.column_stack([np.stack(frame["features"].to_numpy()), np.ones(len(frame))])
            y = frame[target].to_numpy(float)
            before, move = y - z @ point, z @ step
            values = [rounded_loss(before - t * move, epsilon, mu)[0].sum() for t in PARTS]
            error = before - move
            _, a, _ = rounded_loss(error, epsilon, mu)
            _, slope, weight = rounded_loss(error, epsilon, next_mu)
            part = np.concatenate([
                ((z * weight[:, None]).T @ z).ravel(), z.T @ (weight * (y - error) + slope), z.T @ a, values,
                [np.maximum(np.abs(error) - epsilon, 0).sum(), a @ y - epsilon * np.abs(a).sum()],
            ])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"cell": np.arange(len(total), dtype="int32"), "value": cost * total})

    cells = data.select("features", F.col(target).cast("double").alias(target)).mapInPandas(add, "cell int, value double")
    rows = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas().sort_values("cell")
    square = width * width
    value = rows["value"].to_numpy() if len(rows) else np.zeros(square + 2 * width + len(PARTS) + 2)
    return {
        "gram": value[:square].reshape(width, width), "right": value[square : square + width],
        "pull": value[square + width : square + 2 * width], "values": value[square + 2 * width : -2],
        "loss": value[-2], "gain": value[-1],
    }


@dataclass(frozen=True)
class KernelFit:
    """Coefficients (the last is the intercept), objective, its lower bound and the number of passes."""

    coefficients: np.ndarray
    primal: float
    dual: float
    passes: int
    residual: float

    @property
    def gap(self) -> float:
        return (self.primal - self.dual) / self.primal if self.primal > 0 else 0.0

    def score(self, data: DataFrame, out: str = "y_hat") -> DataFrame:
        """Data with the prediction, as one expression over the features."""
        w = F.array(*[F.lit(float(c)) for c in self.coefficients[:-1]])
        products = F.zip_with("features", w, lambda a, b: a * b)
        return data.withColumn(out, F.aggregate(products, F.lit(float(self.coefficients[-1])), lambda s, x: s + x))


def fit_kernel_regression(
    data: DataFrame, target: str, size: int, epsilon: float = 0.1, cost: float = 1.0, tolerance: float = 5e-4, most: int = 100
) -> KernelFit:
    """Fit ``target`` on ``features``. ``data`` is read once per pass, so it should be a written table.

    Rows with a null target take no part. Without rows all coefficients are 0.
    """
    data = data.filter(F.col(target).isNotNull())
    point, step = np.zeros(size + 1), np.zeros(size + 1)
    best, best_primal, dual, residual, fall = point, math.inf, 0.0, 0.0, 0.0
    mu, next_mu = FIRST, FIRST
    for passes in range(1, most + 1):
        sums = normal_equations(data, target, size, point, step, mu, next_mu, epsilon, cost)
        values = sums["values"] + np.array([w @ w / 2 for w in point + PARTS[:, None] * step])
        # A rounded loss falls along the step at first; a part of it that gains a hundredth of a full step's fall will do.
        if passes > 1 and values[1] > values[0] - 0.01 * fall:
            point = point + PARTS[int(np.argmin(values))] * step
            step, fall = np.zeros(size + 1), -math.inf
            next_mu = mu / DIVISOR if values.argmin() == 0 else mu
            continue
        point, mu = point + step, next_mu
        primal = float(sums["loss"] + point @ point / 2)
        dual = max(dual, float(sums["gain"] - sums["pull"] @ sums["pull"] / 2))
        if primal < best_primal:
            best, best_primal = point, primal
        if best_primal - dual <= tolerance * best_primal:
            return KernelFit(best, best_primal, dual, passes, residual)
        lhs = sums["gram"] + np.eye(size + 1)
        solution = np.linalg.solve(lhs, sums["right"])
        residual = float(np.abs(lhs @ solution - sums["right"]).max() / max(1.0, np.abs(sums["right"]).max()))
        step = solution - point
        # What a step at this rounding can gain, against what the rounding itself costs.
        fall = float(step @ (sums["right"] - lhs @ point)) / 2
        next_mu = mu / DIVISOR if fall < 0.05 * (best_primal - dual) else mu
    warnings.warn(f"kernel regression stopped after {most} passes with a relative gap of {(best_primal - dual) / best_primal:.1e}", stacklevel=2)
    return KernelFit(best, best_primal, dual, most, residual)
