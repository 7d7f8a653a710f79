"""Fourier features approach the Gaussian kernel; the regression ends at its optimum."""

import numpy as np
import pytest

from tidemark.operators import kernel as K
from tidemark.operators.terms import document_terms
from tidemark.session import written

TEXTS = {1: "good film good plot", 2: "bad film", 3: "good plot", 4: "", 5: "unknown"}
IDF = {"good": 1.0, "bad": 1.7, "film": 1.2, "plot": 2.0}


@pytest.fixture
def features(spark):
    docs = spark.createDataFrame([("d", i, t.split()) for i, t in TEXTS.items()], "domain string, doc_id int, tokens array<string>")
    words = spark.createDataFrame(list(IDF.items()), "term string, idf double")
    return document_terms(docs), words


def unit(text):
    v = np.array([text.split().count(w) * x for w, x in IDF.items()])
    return v / (np.linalg.norm(v) or 1)


def test_products_of_features_approach_the_kernel(spark, features):
    docs, words = features
    rows = K.fourier_features(docs, words, 600, 0.8).collect()
    z = {r["doc_id"]: np.array(r["features"]) for r in rows}
    assert sorted(z) == sorted(TEXTS)
    for i in TEXTS:
        for j in TEXTS:
            want = np.exp(-0.8 * np.sum((unit(TEXTS[i]) - unit(TEXTS[j])) ** 2))
            assert abs(z[i] @ z[j] - want) < 0.15
    assert np.allclose(z[4], z[5])


def test_gamma_is_one_over_the_variance(spark, features):
    docs, words = features
    x = np.array([unit(t) for t in TEXTS.values()])
    assert K.scale_gamma(docs, words, 4) == pytest.approx(1 / (4 * x.var()))
    assert K.scale_gamma(docs.limit(0), words, 4) == 1.0
    assert K.scale_gamma(docs.filter("doc_id > 3"), words, 4) == 1.0


def table(spark, z, y, name):
    rows = [(list(map(float, a)), None if b is None else float(b)) for a, b in zip(z, y)]
    return written(spark.createDataFrame(rows, "features array<double>, y double").repartition(3), name)


@pytest.mark.parametrize("rows, spread", [(60, 0.05), (40, 1.0), (3, 0.5)])
def test_no_point_nearby_is_better(spark, rows, spread):
    rng = np.random.default_rng(rows)
    z = rng.normal(size=(rows, 4))
    y = z @ rng.normal(size=4) + rng.standard_t(2, size=rows) * spread + 2
    fit = K.fit_kernel_regression(table(spark, [*z, z[0]], [*y, None], "kernel-test"), "y", 4)

    def objective(w):
        return np.maximum(np.abs(y - z @ w[:-1] - w[-1]) - 0.1, 0).sum() + w @ w / 2

    assert fit.primal == pytest.approx(objective(fit.coefficients))
    assert fit.dual <= fit.primal and fit.gap < 1e-3 and fit.residual < 1e-9
    near = min(objective(fit.coefficients + rng.normal(size=5) * 10.0 ** -rng.integers(1, 5)) for _ in range(2000))
    assert near > fit.primal * (1 - 1e-3)


def test_prediction_is_the_linear_form(spark):
    data = table(spark, [[1.0, 2.0], [0.0, -1.0]], [1.0, 0.0], "kernel-score")
    fit = K.KernelFit(np.array([0.5, 0.25, -1.0]), 1.0, 1.0, 1, 0.0)
    assert sorted(r["y_hat"] for r in fit.score(data).collect()) == [-1.25, 0.0]


def test_without_rows_all_coefficients_are_zero(spark):
    fit = K.fit_kernel_regression(table(spark, [[1.0, 2.0]], [None], "kernel-empty"), "y", 2)
    assert not fit.coefficients.any() and fit.gap == 0


def test_equal_targets_within_the_tube_cost_nothing(spark):
    fit = K.fit_kernel_regression(table(spark, np.ones((5, 2)), [0.05] * 5, "kernel-tube"), "y", 2)
    assert fit.primal < 1e-3
