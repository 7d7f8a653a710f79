"""Mixing and token totals: SQL on a table, hand-computed cases, repeated commits."""

from pathlib import Path

import pytest
from oracle import DATA, connect, difference
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries, rollups, sql
from tidemark.llm.common import table
from tidemark.session import scratch_path

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_same_as_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, str(SMALL)), connect(Path(SMALL)), sql.ORACLES[name]) is None


def test_targets_are_met(spark):
    placed = mixing.mix(spark, table(spark, str(SMALL), "documents"))
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda n, v: n + v["words"])
    rows = placed.select("source", "size", "target", taken.alias("taken")).collect()
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.5
        assert all(r["taken"] <= 2 * r["size"] for r in mine)


def test_positions_invert_the_schedule(spark):
    shares = spark.range(0, 1001).select((F.col("id") / 1000).alias("f"))
    for knots in (mixing.FALLING, mixing.STEADY, mixing.LATE, ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0))):
        total = mixing.integral(knots)
        for r in shares.select("f", mixing.invert(F.col("f"), mixing.pieces(knots)).alias("t")).collect():
            area = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                u = min(max(r["t"] - t0, 0.0), t1 - t0)
                area += w0 * u + (w1 - w0) * u * u / (t1 - t0) / 2
            assert area / total == pytest.approx(r["f"], abs=1e-9)


def test_mix_edge_rows(spark, edge, empty):
    rows = mixing.mix(spark, edge).collect()
    assert len(rows) == edge.count()
    assert all(not r["visits"] for r in rows if r["size"] == 0)
    assert [r for r in rows if r["source"] is None][0]["target"] > 0
    assert mixing.mix(spark, empty).count() == 0


def test_mix_carries_other_columns(edge):
    sized = edge.drop("visits").withColumn("size", mixing.word_count(F.col("text")))
    placed = mixing.assign_positions(sized, mixing.cycle_weight, mixing.default_schedule)
    order = mixing.training_order(placed, ["doc_id", "n_chars"])
    spots = [r["visit"]["position"] for r in order.collect()]
    assert spots == sorted(spots) and "n_chars" in order.columns


def counts(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens long")


def test_rollup_batches(spark):
    rollup = rollups.Rollup(spark, scratch_path(spark, "r"))
    assert rollup.totals().count() == 0
    new = counts(spark, [("a", "en", "t1", 5), ("a", "en", "t1", 7), (None, None, "t1", None), ("b", "fr", "t1", 3)])
    assert rollup.commit("1", rollups.inserted(new)) and not rollup.commit("1", rollups.inserted(new))
    change = spark.createDataFrame([("a", "en", "t1", 5, 9)], "source string, lang string, tokenizer string, old_tokens long, new_tokens long")
    rollup.commit("2", rollups.revised(change))
    rollup.compact()
    assert not rollup.commit("2", rollups.revised(change))
    rollup.commit("3", rollups.deleted(counts(spark, [("b", "fr", "t1", 3)])))
    rollup.commit("4", rollups.inserted(counts(spark, [])))
    want = {("a", "en", "t1", 2, 16), (None, None, "t1", 1, 0)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.compact()
    assert {tuple(r) for r in rollup.totals().collect()} == want


def test_interrupted_commit_does_not_count(spark, tmp_path):
    rollup = rollups.Rollup(spark, str(tmp_path / "r"))
    batch = rollups.inserted(counts(spark, [("a", "en", "t", 4)]))
    rollup.commit("1", batch)
    (tmp_path / "r" / "batches" / "1" / "_SUCCESS").unlink()
    assert rollup.totals().count() == 0
    assert rollup.commit("1", batch) and rollup.totals().first()["tokens"] == 4


def test_tokenizer_counts(spark, edge):
    from tokenizers import Tokenizer

    from tidemark.llm.records import default_tokenizer

    model = Tokenizer.from_file(default_tokenizer())
    for r in edge.select("text", rollups.tokenizer_count(default_tokenizer()).alias("n")).collect():
        assert r["n"] == len(model.encode(r["text"] or "", add_special_tokens=False).ids)


def test_rollup_query_edge(edge, empty):
    for df in (edge, empty):
        counted = df.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), F.lit(1).cast("long").alias("t"))
        out, back = rollups.distinct_only(counted, "content", ["t"])
        kept = rollups.summed(rollups.inserted(rollups.by_tokenizer(counted, ["t"])).union(out).union(back)).agg(F.sum("documents")).first()[0]
        assert (kept or 0) == len({r["text"] or "" for r in df.collect()})
