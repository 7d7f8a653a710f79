"""Running sums, codes and ranks over many small ranges; splits of an exact size."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering as O
from tidemark.operators.split import split_exactly


@pytest.fixture
def many_levels(monkeypatch):
    """Three entries a level, so that sums over ranges take several levels."""
    monkeypatch.setattr(O, "LEVEL", 3)


def table(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, at int, v int")


def test_running_sums_over_ranges_and_levels(spark, many_levels):
    rows, df = table(spark)
    got = {r["at"]: (r["before"], r["seen"]) for r in O.running_sums(
        df, ["at"], {"before": F.col("v"), "seen": F.lit(1)}, ["g"], per_range=10).collect()}
    total, seen = Counter(), Counter()
    for g, at, v in rows:
        assert got[at] == (total[g], seen[g])
        total[g] += v
        seen[g] += 1


def test_no_task_orders_more_than_its_range(spark, many_levels):
    _, df = table(spark)
    plan = O.running_sums(df, ["at"], {"before": F.col("v")}, per_range=10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("windowspecdefinition(__range" in w for w in windows)


def test_codes_of_values_with_nulls(spark, many_levels):
    values = [random.Random(1).choice("qwertyuiopasdfgh") * (i % 3 + 1) for i in range(100)] + [None, ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    order = sorted({v for v in values if v is not None})
    got = {r["i"]: r["label"] for r in O.encode_values(df, "s", per_range=4).collect()}
    assert got == {i: None if v is None else order.index(v) for i, v in enumerate(values)}


def test_mid_ranks_with_ties(spark, many_levels):
    rows, df = table(spark)
    values = defaultdict(list)
    for g, _, v in rows:
        values[g].append(v)
    for r in O.mid_ranks(df, "v", ["g"], per_range=3).collect():
        mine = sorted(values[r["g"]])
        at = [i + 1 for i, v in enumerate(mine) if v == r["v"]]
        assert (r["n"], r["rank"]) == (len(at), sum(at) / len(at))


def test_empty_tables(spark):
    _, df = table(spark)
    none = df.limit(0)
    assert O.running_sums(none, ["at"], {"x": F.col("v")}, ["g"]).count() == 0
    assert O.mid_ranks(none, "v").count() == 0 and O.encode_values(none, "g").count() == 0
    assert split_exactly(none, "at", ["g"]).count() == 0


@pytest.mark.parametrize("share", [2, 5, 400])
def test_split_is_exact_in_every_stratum(spark, share):
    rows, df = table(spark)
    parts = split_exactly(df, "at", ["g"], share).collect()
    assert len(parts) == len(rows) and parts[0].asDict().keys() == {"g", "at", "v", "part"}
    sizes, tests = Counter(g for g, _, _ in rows), Counter(r["g"] for r in parts if r["part"] == "test")
    assert tests == {g: math.ceil(n / share) for g, n in sizes.items()}
    again = split_exactly(df.repartition(7), "at", ["g"], share).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, parts), key=repr)


def test_repeated_and_null_keys_stay_together(spark):
    df = spark.createDataFrame([(k, "x") for k in [1] * 40 + [2] * 5 + [None] * 3 + list(range(10, 30))], "k int, s string")
    parts = defaultdict(Counter)
    for r in split_exactly(df, "k").collect():
        parts[r["k"]][r["part"]] += 1
    assert all(len(c) == 1 for c in parts.values())
    tested = sorted((c["test"] for c in parts.values() if c["test"]))
    assert sum(tested) >= math.ceil(68 / 5) and sum(tested) - max(tested) < math.ceil(68 / 5)
