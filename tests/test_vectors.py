"""Word vectors and their means against the definition by joins and sums, in few and in many ranges; stop words in place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import stopwords as S
from tidemark.operators import vectors as V
from tidemark.operators import word2vec as W
from tidemark.operators.terms import document_terms


def texts(spark, n=120):
    rng = np.random.default_rng(11)
    rows = [(f"c{i % 3}", i, [f"w{int(k)}" for k in np.minimum(rng.geometric(0.08, rng.integers(0, 30)), 60)]) for i in range(n)]
    rows += [("c0", n, ["lonely"]), ("c1", n + 1, [])]
    return spark.createDataFrame(rows, "cell string, doc_id bigint, tokens array<string>")


@pytest.mark.parametrize("size", [64, 70])
@pytest.mark.parametrize("pairs, tokens, frequent", [(1_500_000, 400_000, 1000), (5000, 400, 1000), (5000, 400, 20)])
def test_sets_have_the_vectors_of_their_pairs(spark, monkeypatch, size, pairs, tokens, frequent):
    monkeypatch.setattr(W, "RANGE_PAIRS", pairs)
    monkeypatch.setattr(W, "SLICE_TOKENS", tokens)
    monkeypatch.setattr(W, "FREQUENT", frequent)
    docs, sets = texts(spark), {"t0": ("c0", "c1"), "t1": ("c2",), "t2": ("c0", "c1", "c2")}
    counts = docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    hot = W.frequent_words(counts, total, size)
    assert 0 < len(hot) < frequent
    got = {(r["train"], r["word"]): r["vector"] for r in W.summed_contexts(docs.filter("size(tokens) > 0"), sets, 3, size, total, hot).collect()}
    for name, cells in sets.items():
        own = docs.filter(F.col("cell").isin(*cells))
        kept = own.select(F.explode("tokens").alias("word")).distinct()
        want = {(name, r["word"]): r["vector"] for r in W.vectors_of(W.context_pairs(own, 3), kept, size).collect()}
        assert want.keys() == {k for k in got if k[0] == name}
        assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


@pytest.mark.parametrize("held", [100_000, 4, 0])
def test_means_of_held_and_of_shuffled_vectors(spark, monkeypatch, held):
    docs = document_terms(texts(spark), min_length=1)
    docs = docs.unionByName(docs.filter("doc_id < 3"))  # rows of one key are one document
    values = {f"w{k}": [float(k), 1.0 / k, -1.0] for k in range(1, 40)}
    twice = [("w3", [5.0, 5.0, 5.0]), ("w5", None)]  # one vector more, one that is missing
    vectors = spark.createDataFrame([*values.items(), *twice], "word string, vector array<float>")
    frequent = V.most_frequent
    monkeypatch.setattr(V, "most_frequent", lambda terms, *by: frequent(terms, *by, limit=held))
    got = {r["doc_id"]: r["vector"] for r in V.pool_vectors(docs, vectors, 3).collect()}
    tokens = {r["doc_id"]: r["tokens"] for r in texts(spark).collect()}
    assert got.keys() == tokens.keys()
    for k, own in tokens.items():
        known = [values[w] for w in own if w in values] + [[5.0] * 3 for w in own if w == "w3"]
        assert got[k] == pytest.approx(np.mean(known, axis=0) if known else [0.0] * 3, abs=1e-6)


def test_rounds_give_the_same_vectors_and_means(spark, monkeypatch):
    docs = texts(spark)
    counts = docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    own, frequent = docs.filter("size(tokens) > 0"), V.most_frequent
    monkeypatch.setattr(V, "most_frequent", lambda terms, *by: frequent(terms, *by, limit=4))
    monkeypatch.setattr(W, "RANGE_PAIRS", 500)
    found = []
    for pairs, room in ((10**9, 10**9), (1000, 2000)):
        monkeypatch.setattr(W, "ROUND_PAIRS", pairs)
        monkeypatch.setattr(V, "ROUND_BYTES", room)
        hot = W.frequent_words(counts, total, 64)
        vectors = W.summed_contexts(own, {"t": ("c0", "c1", "c2")}, 3, 64, total, hot).select("word", "vector")
        means = V.pool_vectors(document_terms(docs, min_length=1), vectors, 64)
        found.append(({r["word"]: r["vector"] for r in vectors.collect()}, {r["doc_id"]: r["vector"] for r in means.collect()}))
    for one, other in zip(*found):
        assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], abs=1e-6) for k in one)


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, -5, 70_000, 2**31 - 1])
    assert W.grown(W.shrunk(numbers), 5).tolist() == numbers.tolist() and W.grown(W.shrunk(numbers[:0]), 0).tolist() == []
    assert len(W.shrunk(np.ones(10_000, np.int64))) < 200


def test_short_lists_move_one_array_per_document(spark, monkeypatch):
    rows = [(1, ["a", "b", "a", "c"]), (2, []), (3, None), (4, ["x", None, "a"]), (4, ["y", "z"]), (None, ["a", "q"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    words = spark.createDataFrame([("a",), ("z",), (None,)], "word string")
    short = S.without_stop_words(docs, words)
    assert "Generate" not in short._jdf.queryExecution().optimizedPlan().toString()
    want = {(1, ("b", "c")), (2, ()), (3, ()), (4, ("x", "y")), (None, ("q",))}
    assert {(r["doc_id"], tuple(r["tokens"])) for r in short.collect()} == want
    monkeypatch.setattr(S, "INLINE_WORDS", 0)
    assert {(r["doc_id"], tuple(r["tokens"])) for r in S.without_stop_words(docs, words).collect()} == want
