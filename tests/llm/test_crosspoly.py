"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crosspoly as C
from tidemark.llm import queries


def exact(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            scores = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), i) for i, w in good if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_recall_on_a_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = exact(rows)
    got = {}
    for r in queries.op6_cross_polytope(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    by_id = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        for i, score in found:
            a, b = by_id[q], by_id[i]
            assert score == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-14)


def test_edge_vectors(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 120)] + [
        (200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 1.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 0.0, 1.0]),
        (205, [-1.0, -2.0, 0.0]), (250, [1e200, 1e200, 0.0]), (300, [1e-200, 0.0, 1e-200]), (None, same),
    ]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    got = {}
    for r in C.nearest(df, F.col("vec_id") % 50 == 0, probes=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[100] == [0, 1, 2, 3, 4]
    assert set(got) == {0, 50, 100, 250, 300} and len(got[250]) == 5
    few = df.filter("vec_id IN (0, 7, 205)")
    assert [(r["vec_id"], round(r["score"], 9)) for r in C.nearest(few, F.col("vec_id") == 0, probes=8).orderBy("rank").collect()] == [(7, 1.0), (205, -1.0)]


def test_empty_and_mixed_lengths(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, vector array<double>")
    assert C.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    with pytest.raises(ValueError):
        C.nearest(df, F.col("vec_id") == 0)


def test_queries_away_from_a_tight_cluster_find_k(spark):
    rng = np.random.default_rng(8)
    one = rng.normal(size=64)
    rows = [(1000 * i + 1, (one + rng.uniform(-0.01, 0.01, 64)).tolist()) for i in range(600)]
    rows += [(1000 * i, rng.normal(size=64).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {}
    for r in C.nearest(df, F.col("vec_id") % 1000 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(got) == 60 and all(len(v) == 5 for v in got.values())
    # Without the other queries' vectors nothing but the cluster can be found.
    few = df.filter("vec_id % 1000 = 1 OR vec_id = 7000").unionByName(spark.createDataFrame([(0, (-one).tolist())], df.schema))
    want = exact([tuple(r) for r in few.collect()], every=1000)
    got = {}
    for r in C.nearest(few, F.col("vec_id") % 1000 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [i for i, _ in want[0]] and len(got[7000]) == 5


def test_ties_of_unequal_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    one = rng.integers(1, 9, 8).astype(float)
    ids = rng.permutation(np.arange(1, 61)).tolist()
    rows = [(0, one.tolist())] + [(i, (one * m).tolist()) for m, i in enumerate(ids, 2)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = C.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and {r["score"] for r in got} == {1.0}


def test_equal_cosines_are_equal_numbers():
    rng = np.random.default_rng(6)
    one = np.array([3, 1, 4, 1, 5, 9, 2, 6.0, 5, 3, 5])
    rows = np.stack([rng.permutation(one) * m for m in (1, 3, 7, 1e3) for _ in range(200)])
    assert len(set(C.cosines(rows, np.ones(11)))) == 1


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 7))
    y = C.rotated(x, 3)
    assert y.shape == (5, 8) and np.allclose(y @ y.T, x @ x.T)
