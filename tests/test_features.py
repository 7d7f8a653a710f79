"""Term counts, idf, word index, lexicon and pooled vectors against plain Python."""

import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators.features import count_vectors, fit_vocabulary, tfidf_vectors, vector_terms
from tidemark.operators.lexicon import lexicon_polarity
from tidemark.operators.sequences import padded_sequences, token_sequences, word_index
from tidemark.operators.terms import document_terms, term_totals, vocabulary
from tidemark.operators.vectors import pool_vectors

TEXTS = {1: "good film good plot", 2: "bad film", 3: "", 4: "b a good ending bad bad", 5: "plot plot plot film ending"}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, t string")
    return df.select("doc_id", F.filter(F.split("t", " "), lambda w: w != "").alias("tokens"))


def test_document_terms(docs):
    rows = document_terms(docs).collect()
    for r in rows:
        words = [w for w in TEXTS[r["doc_id"]].split() if len(w) >= 2]
        assert {t["term"]: t["tf"] for t in r["terms"]} == dict(Counter(words))
        assert all(words[t["pos"]] == t["term"] and t["term"] not in words[: t["pos"]] for t in r["terms"])


def test_vocabulary_breaks_ties_by_term(docs):
    rows = vocabulary(term_totals(document_terms(docs)), 3).orderBy("rank").collect()
    assert [(r["term"], r["cnt"], r["df"]) for r in rows] == [("plot", 4, 2), ("bad", 3, 2), ("film", 3, 3)]


def test_vocabulary_per_group(docs):
    parts = document_terms(docs).withColumn("g", F.col("doc_id") % 2)
    rows = vocabulary(term_totals(parts, ["g"]), 1, ["g"]).collect()
    assert {r["g"]: r["term"] for r in rows} == {0: "bad", 1: "plot"}


def test_tfidf(docs):
    terms = document_terms(docs)
    vocab = fit_vocabulary(terms, 4)
    weights = {}
    for r in vector_terms(tfidf_vectors(count_vectors(terms, vocab), vocab), "tfidf", vocab, "w").collect():
        weights[r["doc_id"], r["term"]] = r["w"]
    df = Counter(t for text in TEXTS.values() for t in set(text.split()))
    for doc, text in TEXTS.items():
        tf = Counter(w for w in text.split() if w in vocab.terms)
        raw = {t: n * (math.log(6 / (1 + df[t])) + 1) for t, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            assert weights.pop((doc, t)) == pytest.approx(v / norm)
    assert not weights
    norms = tfidf_vectors(count_vectors(terms, vocab), vocab).select(
        F.aggregate(vector_to_array("tfidf"), F.lit(0.0), lambda a, x: a + x * x).alias("n")
    )
    assert sorted(round(r["n"], 9) for r in norms.collect()) == [0, 1, 1, 1, 1]


def test_word_index_and_sequences(docs):
    index = word_index(docs, 6)
    got = {r["term"]: r["idx"] for r in index.collect()}
    counts, order = Counter(), {}
    for doc in sorted(TEXTS):
        for w in TEXTS[doc].split():
            counts[w] += 1
            order.setdefault(w, len(order))
    ranked = sorted(counts, key=lambda w: (-counts[w], order[w]))[:5]
    assert got == {w: i + 1 for i, w in enumerate(ranked)}
    seqs = token_sequences(docs, index)
    assert {r["doc_id"]: r["seq"] for r in seqs.collect()} == {
        d: [got[w] for w in t.split() if w in got] for d, t in TEXTS.items()
    }
    assert all(len(r["seq"]) == 4 for r in padded_sequences(seqs, 4).collect())


@pytest.mark.parametrize("bound", [10, 10**9])
def test_lexicon(spark, docs, bound):
    """A small bound takes the broadcast, a huge one the shuffle with frequent words apart."""
    words = {"good": 0.5, "bad": -0.75, "missing": 1.0}
    lex = spark.createDataFrame(list(words.items()), "word string, polarity double")
    got = {r["doc_id"]: r["polarity"] for r in lexicon_polarity(document_terms(docs, 1), lex, bound=bound).collect()}
    for d, t in TEXTS.items():
        hits = [words[w] for w in t.split() if w in words]
        assert got[d] == pytest.approx(sum(hits) / len(hits) if hits else 0.0)


@pytest.mark.parametrize("bound", [None, 10**9])
def test_pooled_vectors_skip_unknown_words(spark, docs, bound):
    vec = {"good": [1.0, 2.0], "film": [3.0, -1.0]}
    table = spark.createDataFrame(list(vec.items()), "word string, vector array<float>")
    got = {r["doc_id"]: r["vector"] for r in pool_vectors(document_terms(docs, 1), table, 2, bound=bound).collect()}
    for d, t in TEXTS.items():
        known = [vec[w] for w in t.split() if w in vec]
        want = [sum(v[i] for v in known) / len(known) if known else 0.0 for i in range(2)]
        assert got[d] == pytest.approx(want)
