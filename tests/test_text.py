"""Cleaning, stop lists, labels and sequences on hand-written rows."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.labels import above, code_of, map_values
from tidemark.operators.ordering import encode_values
from tidemark.functions.stoplists import GENERAL, PAIR_PROFILES, PROFILES
from tidemark.functions.text import clean_tokens, join_words, pad_front
from tidemark.operators.stopwords import stop_table, without_stop_words


def cleaned(spark, texts, stop=GENERAL):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", join_words(clean_tokens(F.col("t"), stop)).alias("c")).orderBy("i")
    return [r["c"] for r in out.collect()]


def expected(text, stop=frozenset(GENERAL)):
    if text is None:
        return ""
    text = re.sub(r"<.*?>", "", text.lower())
    return " ".join(w for w in re.sub(r"[^a-z\s]", "", text).split() if w not in stop)


CASES = [
    "good<br />bad", "a<b\nc>d plot", "don't stop", "été", None, "", "  \t\n ", "no break space",
    "x y　z word line", "<p>one</p><p>two</p>", "a <b <c> d> e", "tab\x1cunit\x1fsep", "NOT very good",
    "ain't sci-fi", "<unclosed tag stays", "1234 5678", "Ünïcode ſtraße K", "line\rbreak\r\nhere<x\ry>z",
]


def test_clean_cases(spark):
    assert cleaned(spark, CASES) == [expected(t) for t in CASES]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("abzAB <>/'é\n\r\t  .5")), max_size=60), min_size=20, max_size=40))
def test_clean_random(spark, texts):
    assert cleaned(spark, texts) == [expected(t) for t in texts]


def test_clean_is_idempotent(spark):
    once = cleaned(spark, CASES)
    assert cleaned(spark, once) == once


def test_stop_list_sizes():
    assert {k: len(set(v)) for k, v in PROFILES.items()} == {
        "twitter": 80, "amazon": 87, "spotify": 58, "film_long": 85, "film_short": 51, "film_small": 47,
    }
    assert len(set(GENERAL)) == 179 and len(PAIR_PROFILES) == 10


def test_entries_that_no_token_can_equal_leave_the_word(spark):
    stop = set(GENERAL) | set(PROFILES["film_short"])
    assert cleaned(spark, ["sci-fi box office movie"], stop) == ["scifi box office movie"]
    assert cleaned(spark, ["the movie plot"], set(GENERAL) | set(PROFILES["film_long"])) == [""]


@pytest.mark.parametrize("limit", [1000, 1])
def test_anti_join_equals_filter(spark, limit, monkeypatch):
    """Also beyond the broadcast limit, where frequent words take another way."""
    import tidemark.operators.stopwords as module

    real = module.lookup
    monkeypatch.setattr(module, "lookup", lambda *a, **k: real(*a, **k, limit=limit, frequent=2))
    texts = ["the cat and the dog", "the the the", "", "bird of a feather flock", "dog dog cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    docs = df.select("doc_id", clean_tokens(F.col("t")).alias("tokens"))
    out = without_stop_words(docs, stop_table(spark, {"g": GENERAL}).select("word"))
    got = {r["doc_id"]: " ".join(r["tokens"]) for r in out.collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 250])
def test_pad_front(spark, n):
    df = spark.range(1).select(F.array(*[F.lit(i + 1) for i in range(n)]).cast("array<int>").alias("s"))
    want = ([0] * 100 + list(range(1, n + 1)))[-100:]
    assert df.select(pad_front(F.col("s")).alias("p")).first()["p"] == want


def test_labels(spark):
    df = spark.createDataFrame([(1, "Positive"), (2, "Negative"), (3, "Positive"), (None, None)], "v int, s string")
    rows = encode_values(df.withColumn("m", map_values(F.col("v"), {1: 0, 2: 1})), "s")
    got = [(r["v"], r["m"], r["label"]) for r in rows.collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 1, 0), (3, None, 1), (None, None, None)], key=str)
    coded = df.select(code_of(F.col("s"), ["Positive", "Negative"]).alias("c")).collect()
    assert [r["c"] for r in coded] == [1, 0, 1, None]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (0.51,)], "x double").select(above(F.col("x"))).collect()] == [0, 1]
