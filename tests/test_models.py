"""Fitted models: optimum, agreement with closed forms, planted signal."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators.classifiers import fit_calibrated_svm, fit_logistic, fit_mlp, fit_naive_bayes, fit_regression, fit_svm, logistic_model, svm_margin
from tidemark.operators.metrics import metrics_table
from tidemark.operators.naive_bayes import fold_sizes, fold_terms, nb_model, nb_predict
from tidemark.operators.split import fold_table, single_cells
from tidemark.operators.terms import document_terms
from tidemark.operators.word2vec import context_pairs, train_word2vec
from tidemark.plans import closed_form as C
from tidemark.plans import experiments as X
from tidemark.session import written

rng = np.random.default_rng(5)
WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    """Two domains; class 1 is where the word 'fine' occurs, class 0 where 'poor' does."""
    rows = []
    for i in range(400):
        label = int(rng.random() < 0.6)
        words = list(rng.choice(WORDS, size=rng.integers(3, 12))) + ["fine" if label else "poor"] * int(rng.integers(1, 3))
        rng.shuffle(words)
        part = "test" if i % 5 == 0 else "train"
        rows.append(("ab"[i % 2], i, label, part, [str(w) for w in words]))
    df = spark.createDataFrame(rows, "domain string, doc_id bigint, label int, part string, tokens array<string>")
    return written(df, "docs")


@pytest.fixture(scope="module")
def dense(spark):
    x = rng.normal(size=(200, 3))
    y = (x @ np.array([1.5, -2.0, 0.5]) + rng.normal(size=200) > 0.3).astype(int)
    rows = [(i, Vectors.dense(a), int(b), float(a @ [1, 2, 3] + 1)) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["doc_id", "x", "label", "target"])


def test_logistic_reaches_the_penalized_optimum(dense):
    x, y, df = dense
    design, w = np.c_[x, np.ones(len(x))], np.zeros(4)
    penalty = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (p - y) + penalty @ w)
    model = logistic_model(df, "x", tolerance=1e-9)
    assert np.r_[model.coefficients.toArray(), model.intercept] == pytest.approx(w, abs=1e-3)


def test_svm_reaches_the_squared_hinge_optimum(dense):
    x, y, df = dense
    design, sign, w = np.c_[x, np.ones(len(x))], 2 * y - 1, np.zeros(4)
    penalty = np.diag([0.5, 0.5, 0.5, 0.0])
    for _ in range(50):
        near = sign * (design @ w) < 1
        w = np.linalg.solve(design[near].T @ design[near] + penalty, design[near].T @ sign[near])
    margin = svm_margin(df, "x", {0: int((y == 0).sum()), 1: int(y.sum())}, tolerance=1e-10)
    assert margin.coefficients == pytest.approx(w[:3], abs=1e-4)
    got = {r["doc_id"]: r["score"] for r in margin.add(df, "score").collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(list(design @ w), abs=1e-3)


def test_scores_are_probabilities_and_beat_the_majority(dense):
    _, y, df = dense
    floor = max(y.mean(), 1 - y.mean())
    for fit in (fit_logistic, fit_calibrated_svm, lambda d, c: fit_mlp(d, c, 3, hidden=8)[0]):
        rows = fit(df, "x")(df).select("label", "y_pred", "score").collect()
        assert len(rows) == 200 and all(0 <= r["score"] <= 1 for r in rows)
        assert np.mean([r["label"] == r["y_pred"] for r in rows]) > floor + 0.1
    rows = fit_svm(df, "x")(df).collect()
    assert all((r["score"] > 0) == (r["y_pred"] == 1) for r in rows)


def test_calibration_needs_both_classes(dense):
    with pytest.raises(ValueError, match="both classes"):
        fit_calibrated_svm(dense[2].filter("label = 1"), "x")


def test_regression(dense):
    rows = fit_regression(dense[2], "x", "target")(dense[2]).collect()
    assert all(abs(r["y_hat"] - r["target"]) < 0.2 for r in rows)


def brute_nb(train, test, vocab):
    """Textbook multinomial naive Bayes on counts."""
    n = {c: sum(1 for d in train if d["label"] == c) for c in (0, 1)}
    cnt = {c: {t: sum(d["tokens"].count(t) for d in train if d["label"] == c) for t in vocab} for c in (0, 1)}
    out = {}
    for d in test:
        s = [
            math.log(n[c] / len(train))
            + sum(math.log((cnt[c][t] + 1) / (sum(cnt[c].values()) + len(vocab))) for t in d["tokens"] if t in vocab)
            for c in (0, 1)
        ]
        out[d["doc_id"]] = (int(s[1] > s[0]), 1 / (1 + math.exp(s[0] - s[1])))
    return out


def test_naive_bayes_closed_form_equals_brute_force_and_vectors(spark, docs):
    cells = single_cells(["a", "b"])
    terms = document_terms(docs)
    folds = fold_table(spark, cells)
    model = nb_model(fold_terms(terms, folds), 20)
    pred = nb_predict(terms, folds, model, fold_sizes(terms, folds)).collect()
    vocab = {f: {r["term"] for r in model.filter(F.col("fold") == f).collect()} for f in "ab"}
    rows = docs.collect()
    for f in "ab":
        want = brute_nb(*([d for d in rows if d["domain"] == f and d["part"] == p] for p in ("train", "test")), vocab[f])
        got = {r["doc_id"]: (r["y_pred"], r["score"]) for r in pred if r["fold"] == f}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    for f in "ab":
        train = [d["label"] for d in rows if d["domain"] == f and d["part"] == "train"]
        v, sizes = X.Vocabulary(sorted(vocab[f]), [1.0] * len(vocab[f])), {c: train.count(c) for c in (0, 1)}
        rows_f = X.count_vectors(terms.filter(F.col("domain") == f), v)
        score = fit_naive_bayes(rows_f.filter("part = 'train'"), "bow", sizes)
        got = {r["doc_id"]: r["score"] for r in score(rows_f.filter("part = 'test'")).collect()}
        assert got == pytest.approx({r["doc_id"]: r["score"] for r in pred if r["fold"] == f})


def test_class_missing_in_training_is_never_predicted(spark, docs):
    one = document_terms(docs.filter("part = 'test' OR label = 1"))
    pred = C.nb_bow(one, single_cells(["a", "b"]), 20)
    assert {r["y_pred"] for r in pred.collect()} == {1}


def test_word_vectors(spark, docs):
    rows = {r["word"]: r["vector"] for r in train_word2vec(docs, size=70).collect()}
    assert set(rows) == set(WORDS) | {"fine", "poor"}
    assert all(len(v) == 70 and math.fsum(x * x for x in v) == pytest.approx(1, abs=1e-5) for v in rows.values())
    again = {r["word"]: r["vector"] for r in train_word2vec(docs.repartition(7), size=70).collect()}
    assert again == rows
    alone = spark.createDataFrame([(["a"],), ([],), (["b", "c", "b"],)], "tokens array<string>")
    assert {r["word"] for r in train_word2vec(alone, size=8).collect()} == {"a", "b", "c"}


def test_context_pairs(spark):
    from collections import Counter

    texts = [list("abcabd"), ["a"], [], list("aaaa")]
    want = Counter((t[i], t[j]) for t in texts for i in range(len(t)) for j in range(len(t)) if i != j and abs(i - j) <= 2)
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    assert {(r["word"], r["context"]): r["cnt"] for r in context_pairs(df, 2).collect()} == dict(want)


def test_grid_learns_the_planted_words(spark, docs):
    lexicon = spark.createDataFrame([("fine", 1.0), ("poor", -1.0)], "word string, polarity double")
    cells = [c for c in single_cells(["a"])]
    data = X.fold_data(docs, cells, X.Settings(vocabulary=30, vector_size=8, window=3, svm_folds=2), lexicon, 2)
    n_test = docs.filter("domain = 'a' AND part = 'test'").count()
    pred = written(X.with_votes(X.classify(data)), "pred")
    assert pred.groupBy("feature", "model").count().filter(F.col("count") != n_test).count() == 0
    scores = {(r["feature"], r["model"]): r["accuracy"] for r in metrics_table(pred).collect()}
    assert len(scores) == 11
    floor = docs.filter("domain = 'a' AND part = 'test'").agg(F.avg("label")).first()[0]
    assert all(v > max(floor, 1 - floor) + 0.1 for (f, _), v in scores.items() if f != "Word2Vec")
    soft = X.soft_vote_stacked(data)
    assert soft.count() == n_test and metrics_table(soft).first()["accuracy"] > 0.85
    assert X.neural_net(data).count() == n_test and X.regress(data).count() == 3 * n_test
    words = X.logistic_words(data, "BOW", 1).collect()
    assert {(r["side"], r["term"]) for r in words} == {("positive", "fine"), ("negative", "poor")}


def test_tfidf_bayes_weighs_and_scores_inside_the_row(spark):
    """Rows of one document count as one, documents without known words get the prior, and no term is listed as a row."""
    rows = [("a", 1, 1, "train", ["fine", "fine", "day"]), ("a", 1, 1, "train", ["fine", "song"]), ("a", 2, 0, "train", ["poor", "day"]),
            ("a", 3, 0, "train", []), ("a", 4, 1, "test", ["fine", "day"]), ("a", 4, 1, "test", ["poor"]), ("a", 5, 0, "test", ["other"]), ("a", 6, 0, "test", [])]
    docs = written(document_terms(spark.createDataFrame(rows, "domain string, doc_id bigint, label int, part string, tokens array<string>")), "docs")
    pred = C.nb_tfidf(docs, single_cells(["a"]))
    assert "Generate" not in pred._jdf.queryExecution().optimizedPlan().toString()
    n, df = 4, {"day": 2, "fine": 2, "poor": 1, "song": 1}
    idf = {w: np.log((1 + n) / (1 + d)) + 1 for w, d in df.items()}

    def weights(*counts):
        raw = [(w, tf * idf[w]) for w, tf in counts]
        norm = np.sqrt(sum(x * x for _, x in raw))
        return [(w, x / norm) for w, x in raw]

    seen = {1: weights(("fine", 2), ("day", 1), ("fine", 1), ("song", 1)), 0: weights(("poor", 1), ("day", 1))}
    logs = {}
    for c, own in seen.items():
        sums = {w: sum(x for v, x in own if v == w) for w in df}
        logs[c] = {w: np.log((s + 1) / (sum(sums.values()) + len(df))) for w, s in sums.items()}
    expected = {i: 0.0 + sum(x * (logs[1][w] - logs[0][w]) for w, x in own) for i, own in ((4, weights(("fine", 1), ("day", 1), ("poor", 1))), (5, []), (6, []))}
    found = {r["doc_id"]: r["margin"] for r in pred.collect()}
    assert found == pytest.approx(expected, abs=1e-8)
