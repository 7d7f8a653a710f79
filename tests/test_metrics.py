"""Metrics, votes and rank tests against plain Python."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.functions.special import chi2_tail
from tidemark.operators.explain import influential_words
from tidemark.operators.metrics import confusion_matrix, metrics_per_class, metrics_table, regression_metrics, roc_auc
from tidemark.operators.ranks import friedman_test, nemenyi_matrix, nemenyi_pairs
from tidemark.operators.voting import hard_vote, soft_vote

BY = ["fold"]


def test_roc_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(f, rng.randint(0, 1), round(rng.random() ** 3, d)) for f, d in (("a", 1), ("b", 6)) for _ in range(400)]
    rows += [("c", 1, 0.5)] * 5
    df = spark.createDataFrame(rows, "fold string, y_true int, score double")
    got = {r["fold"]: r["auc"] for r in roc_auc(df, BY, per_range=30).collect()}
    for f in "ab":
        pos = [s for g, y, s in rows if g == f and y == 1]
        neg = [s for g, y, s in rows if g == f and y == 0]
        won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[f] == pytest.approx(won / len(pos) / len(neg))
    assert got["c"] is None


def test_classification_metrics(spark):
    rows = [("x", 1, 1)] * 3 + [("x", 1, 0)] * 2 + [("x", 0, 1)] + [("y", 0, 0)] * 4 + [("y", 1, 0)]
    df = spark.createDataFrame(rows, "fold string, y_true int, y_pred int")
    got = {r["fold"]: r for r in metrics_table(df, by=BY).collect()}
    assert (got["x"]["accuracy"], got["x"]["precision"], got["x"]["recall"]) == (0.5, 0.75, 0.6)
    assert got["x"]["f1"] == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    assert (got["y"]["precision"], got["y"]["recall"], got["y"]["f1"]) == (0.0, 0.0, 0.0)
    cells = {(r["fold"], r["y_true"]): (r["pred_0"], r["pred_1"]) for r in confusion_matrix(df, by=BY).collect()}
    assert cells == {("x", 1): (2, 3), ("x", 0): (0, 1), ("y", 0): (4, 0), ("y", 1): (1, 0)}
    assert sum(map(sum, cells.values())) == len(rows)
    per = {(r["fold"], r["class"]): r for r in metrics_per_class(df, BY).collect()}
    assert per["y", 0]["precision"] == 0.8 and per["y", 0]["recall"] == 1.0 and per["y", 0]["support"] == 4
    assert per["x", 0]["precision"] == 0.0 and per["x", 0]["support"] == 1


def test_regression_metrics(spark):
    rows = [("a", 1.0, 1.5), ("a", 2.0, 1.0), ("a", 4.0, 4.0), ("b", 2.0, 2.0), ("b", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "fold string, y_true double, y_pred double")
    got = {r["fold"]: r for r in regression_metrics(df, BY).collect()}
    assert got["a"]["mse"] == pytest.approx(1.25 / 3) and got["a"]["mae"] == pytest.approx(0.5)
    assert got["a"]["r2"] == pytest.approx(1 - 1.25 / (14 / 3)) and got["b"]["r2"] == 1.0


def votes(spark, rows):
    full = [("f", "d", i, 1, "BOW", m, y, s) for i, m, y, s in rows]
    return spark.createDataFrame(
        full, "fold string, domain string, doc_id int, y_true int, feature string, model string, y_pred int, score double"
    )


def test_votes(spark):
    rows = [(1, "a", 0, 0.2), (1, "b", 1, 0.8), (2, "a", 1, 0.9), (2, "b", 1, 0.7), (2, "c", 0, 0.1), (3, "a", 1, 0.6), (3, "b", 0, 0.45)]
    df = votes(spark, rows)
    assert {r["doc_id"]: r["y_pred"] for r in hard_vote(df).collect()} == {1: 0, 2: 1, 3: 0}
    assert {r["doc_id"]: (r["y_pred"], r["score"]) for r in soft_vote(df).collect()} == {
        1: (0, 0.5), 2: (1, pytest.approx(1.7 / 3)), 3: (1, 0.525),
    }
    weighted = soft_vote(df.filter("doc_id < 2"), {"a": 3.0, "b": 1.0}).first()
    assert weighted["score"] == pytest.approx(0.35)


def test_influential_words(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", -2.0), ("d", 0.5)], "term string, weight double")
    got = [(r["side"], r["place"], r["term"]) for r in influential_words(df, 2).collect()]
    assert sorted(got) == [("negative", 1, "c"), ("negative", 2, "d"), ("positive", 1, "a"), ("positive", 2, "b")]


def test_rank_tests(spark):
    scores = np.array([[0.9, 0.8, 0.7, 0.7], [0.85, 0.8, 0.6, 0.7], [0.95, 0.7, 0.7, 0.6], [0.8, 0.85, 0.5, 0.55], [0.9, 0.7, 0.6, 0.65]])
    rows = [("s", f"d{i}", f"m{j}", float(scores[i, j])) for i in range(5) for j in range(4)]
    df = spark.createDataFrame(rows, "slice string, dataset string, method string, score double")
    ranks = np.array([[(r < x).sum() + ((r == x).sum() + 1) / 2 for x in r] for r in scores])
    n, k = scores.shape
    ties = sum(c**3 - c for r in scores for c in np.unique(r, return_counts=True)[1])
    stat = (12 / (n * k * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    got = friedman_test(df).first()
    p = math.erfc(math.sqrt(stat / 2)) + math.sqrt(2 * stat / math.pi) * math.exp(-stat / 2)
    assert got["statistic"] == pytest.approx(stat) and got["p"] == pytest.approx(p) and got["reject"] == (p <= 0.05)

    z = np.linspace(-9, 9, 20001)
    phi = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))

    def tail(q):
        f = k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (phi(z) - phi(z - q)) ** (k - 1)
        return 1 - np.sum((f[1:] + f[:-1]) / 2) * (z[1] - z[0])

    means = ranks.mean(0)
    pairs = nemenyi_pairs(df)
    for r in pairs.collect():
        gap = abs(means[int(r["method_a"][1])] - means[int(r["method_b"][1])])
        q = gap / math.sqrt(k * (k + 1) / (6 * n)) * math.sqrt(2)
        assert r["q"] == pytest.approx(q)
        assert r["p"] == pytest.approx(tail(q) if q else 1.0, abs=1e-7)
    matrix = nemenyi_matrix(pairs, [f"m{j}" for j in range(4)]).collect()
    assert len(matrix) == 4 and all(r[r["method_a"]] == 1.0 for r in matrix)
    swapped = friedman_test(df, block="method", treatment="dataset").first()
    assert (swapped["k"], swapped["n"]) == (5, 4)


def test_friedman_needs_complete_blocks(spark):
    rows = [("s", f"d{i}", f"m{j}", float(i * j % 5)) for i in range(4) for j in range(3) if (i, j) != (2, 1)]
    rows += [("t", f"d{i}", f"m{j}", float((i + j) % 3)) for i in range(4) for j in range(3)]
    df = spark.createDataFrame(rows, "slice string, dataset string, method string, score double")
    got = {r["slice"]: r for r in friedman_test(df).collect()}
    assert got["s"]["statistic"] is None and got["s"]["p"] is None and got["s"]["reject"] is None
    assert got["t"]["p"] is not None


def test_chi_square_tail(spark):
    def tail(x, dof):
        z, out = x / 2, math.erfc(math.sqrt(x / 2)) if dof % 2 else 0.0
        for i in range(dof // 2):
            j = i + dof % 2 / 2
            out += math.exp(j * math.log(z) - z - math.lgamma(j + 1))
        return out

    points = [(float(x), d) for x in (1e-9, 0.3, 2, 7.5, 16, 18.1, 50, 800, 3000, 1e6) for d in (1, 2, 3, 4, 7, 8, 31, 200)]
    df = spark.createDataFrame(points, "x double, dof int")
    for r in df.select("x", "dof", chi2_tail(F.col("x"), F.col("dof")).alias("p")).collect():
        assert r["p"] == pytest.approx(tail(r["x"], r["dof"]), rel=1e-6, abs=1e-12)
    assert spark.range(1).select(chi2_tail(F.lit(0.0), F.lit(3))).first()[0] == 1.0


def test_friedman_rejects_the_clearest_case(spark):
    rows = [("s", f"d{i}", f"m{j}", float(j)) for i in range(230) for j in range(8)]
    got = friedman_test(spark.createDataFrame(rows, "slice string, dataset string, method string, score double")).first()
    assert got["statistic"] == pytest.approx(230 * 7) and got["p"] < 1e-100 and got["reject"]
