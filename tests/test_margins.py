"""SVMs that share their passes: optimum of every inner fold, sums of a few rows, number of passes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators import margins as M
from tidemark.operators.classifiers import fit_calibrated_svm, svm_margin


def counted(seed=3, n=240, terms=12):
    """Sparse counts, every third row as a dense vector; the last column is always empty. Some labels are missing."""
    rng = np.random.default_rng(seed)
    rows, x = [], np.zeros((n, terms))
    for i in range(n):
        at = sorted(rng.choice(terms - 1, size=rng.integers(0, 5), replace=False).tolist())
        x[i, at] = rng.integers(1, 30, len(at))
        score = x[i, : terms // 2].sum() - x[i, terms // 2 :].sum() + rng.normal() * 15
        vector = Vectors.dense(x[i]) if i % 3 == 0 else Vectors.sparse(terms, at, x[i, at])
        rows.append((i, int(rng.integers(5)), None if i % 40 == 7 else int(score > 0), vector))
    return rows, x


def optimum(x, sign):
    """Plain Newton steps, halved until the loss falls."""
    design, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    free = np.r_[np.ones(x.shape[1]), 0]

    def value(w):
        return 0.5 * (free * w) @ w + (np.maximum(0, 1 - sign * (design @ w)) ** 2).sum()

    for _ in range(300):
        near = sign * (design @ w) < 1
        aim = np.linalg.solve(2 * design[near].T @ design[near] + np.diag(free), 2 * design[near].T @ sign[near])
        t = 1.0
        while value(w + t * (aim - w)) > value(w) and t > 1e-12:
            t /= 2
        w = w + t * (aim - w)
    return w


@pytest.mark.parametrize("rows_at_a_time", [2048, 7])
def test_every_fold_reaches_its_optimum_in_common_passes(spark, monkeypatch, rows_at_a_time):
    monkeypatch.setattr(M, "SUMS", 2)
    monkeypatch.setattr(M, "PRODUCT_ROWS", rows_at_a_time)
    rows, x = counted()
    df = spark.createDataFrame(rows, ["doc_id", "fold", "label", "x"]).repartition(6)
    passes = M.Passes(df, "x", F.col("fold"), x.shape[1])
    try:
        found = M.svm_weights(passes, 5, [0, 1, 3, 4], 1.0, 100, 1e-12)
        held = passes.held_out({0: found[0]}).collect()
    finally:
        passes.close()
    for left, w in zip([0, 1, 3, 4], found):
        kept = [i for i, fold, label, _ in rows if fold != left and label is not None]
        want = optimum(x[kept], np.array([2 * rows[i][2] - 1 for i in kept]))
        assert w == pytest.approx(want, abs=1e-6)
    own = [i for i, fold, _, _ in rows if fold == 0]
    assert sorted(r["m"] for r in held) == pytest.approx(sorted(x[own] @ found[0][:-1] + found[0][-1]))
    assert sum(r["label"] is None for r in held) == sum(rows[i][2] is None for i in own)


def test_margin_of_one_set_counts_an_empty_column_in(spark):
    """An empty column once made the solver fall back to a coarse one, so that the fit ended early."""
    rows, x = counted(9)
    kept = [r for r in rows if r[2] is not None]
    df = spark.createDataFrame(kept, ["doc_id", "fold", "label", "x"])
    y = np.array([r[2] for r in kept])
    margin = svm_margin(df, "x", {0: int((y == 0).sum()), 1: int(y.sum())}, rounds=100, tolerance=1e-12)
    want = optimum(x[[r[0] for r in kept]], 2 * y - 1)
    assert np.r_[margin.coefficients, margin.intercept] == pytest.approx(want, abs=1e-6)


def test_folds_share_their_passes(spark):
    rows, _ = counted()
    df = spark.createDataFrame([r for r in rows if r[2] is not None], ["doc_id", "fold", "label", "x"])
    real, calls = M.Passes.products, []
    try:
        M.Passes.products = lambda self, choice: calls.append(1) or real(self, choice)
        fit_calibrated_svm(df, "x")
    finally:
        M.Passes.products = real
    assert 1 < len(calls) <= 30


def test_rows_added_and_taken_off():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 4))

    def rows(own):
        return np.full(len(own), 4), np.tile(np.arange(4, dtype=np.int32), len(own)), own.ravel()

    one, two = M.SumOfProducts(4), M.SumOfProducts(4)
    one.add(rows(x[:6]), 1)
    two.add(rows(x[6:]), -1)
    total = M.SumOfProducts(4)
    for sent in (one.message(), two.message()):
        total.take(sent)
    half = np.frombuffer(total.message(True)["products"])
    assert M.unfolded(half, 4) == pytest.approx(x[:6].T @ x[:6] - x[6:].T @ x[6:])


def test_entries_of_sparse_and_dense_vectors():
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    some = pa.array([
        {"type": 0, "size": 5, "indices": [1, 4], "values": [2.0, 3.0]}, {"type": 1, "size": None, "indices": None, "values": [1.0, 0.0]},
        {"type": 0, "size": 5, "indices": [], "values": []},
    ], kind)
    sizes, columns, values = M.entries(some)
    assert (sizes.tolist(), columns.tolist(), values.tolist()) == ([2, 2, 0], [1, 4, 0, 1], [2.0, 3.0, 1.0, 0.0])
    assert M.products(sizes, columns, values, np.array([1.0, 10.0, 0, 0, 100.0])).tolist() == [320.0, 1.0, 0.0]
