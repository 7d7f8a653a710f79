"""Layouts, corpus, result files and folds."""

import csv

import pytest
from pyspark.sql import functions as F

from tidemark.operators.lexicon import lexicon_polarity
from tidemark.operators.sequences import padded_sequences, token_sequences, word_index
from tidemark.operators.split import all_pairs, fold_table, hash_part, in_role, leave_one_out_cells, single_cells, transfer_cells
from tidemark.operators.stopwords import stop_table, without_stop_words
from tidemark.operators.terms import document_terms
from tidemark.operators.vectors import pool_vectors
from tidemark.plans.closed_form import nb_bow, nb_tfidf
from tidemark.plans.experiments import pair_documents
from tidemark.plans.prepare import prepare
from tidemark.session import broadcast_if_small, written
from tidemark.sources.corpus import write_corpus
from tidemark.sources.layouts import LAYOUTS, load_corpus, read_headered, read_positional
from tidemark.sources.results import read_scores, write_by_fold, write_sample


def put(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    return {
        "imdb": put(d / "i.csv", [["review", "sentiment"], ['A "fine" film,\nreally', "positive"], ["Bad plot <br /> all over", "negative"]]),
        "spotify": put(d / "s.csv", [["Review", "label"], ["Great app", "POSITIVE"], ["", "NEGATIVE"]]),
        "rotten_tomatoes": put(d / "r.csv", [["text", "label"], ["dull movie", 0], ["moving", 1]]),
        "twitter": put(d / "t.csv", [[1, "x", "Positive", "lol nice day"], [2, "x", "Neutral", "meh"], [3, "x", "Negative", "bad, day"], [4, "x", "Negative", ""]]),
        "amazon": put(d / "a.csv", [[2, "t", "works \\ well"], [1, "t", 'broke; said "no"'], [3, "t", "odd"]]),
    }


def test_layouts(spark, paths):
    rows = load_corpus(spark, paths).collect()
    got = sorted((r["domain"], r["raw_text"], r["label"]) for r in rows if r["label"] is not None)
    assert got == sorted([
        ("imdb", 'A "fine" film,\nreally', 1), ("imdb", "Bad plot <br /> all over", 0),
        ("spotify", "Great app", 1), ("spotify", "", 0),
        ("rotten_tomatoes", "dull movie", 0), ("rotten_tomatoes", "moving", 1),
        ("twitter", "lol nice day", 1), ("twitter", "bad, day", 0), ("twitter", "", 0),
        ("amazon", "works \\ well", 1), ("amazon", 'broke; said "no"', 0),
    ])
    assert [r["raw_text"] for r in rows if r["label"] is None] == ["odd"]
    assert len({(r["domain"], r["doc_id"]) for r in rows}) == len(rows)


def test_too_few_columns(spark, tmp_path):
    short = put(tmp_path / "short.csv", [[1, "Positive"], [2, "Negative"]])
    with pytest.raises(ValueError, match="2 columns, at least 4"):
        LAYOUTS["twitter"].read(spark, short)
    assert read_positional(spark, short, "_c0 int, _c1 string", 2).count() == 2


def test_equal_rows_stay_separate_documents(spark, tmp_path):
    line = ["same text of a review", 1]
    path = put(tmp_path / "r.csv", [["text", "label"], line, line, ["other words", 0], line])
    docs = load_corpus(spark, {"rotten_tomatoes": path})
    assert docs.count() == 4 and docs.select("domain", "doc_id").distinct().count() == 4
    again = docs.join(docs.withColumnRenamed("raw_text", "t"), ["domain", "doc_id"])
    assert again.filter("raw_text = t").count() == 4
    prepared = written(document_terms(prepare(docs)), "prepared")
    index = word_index(prepared)
    seqs = token_sequences(prepared, index)
    assert seqs.count() == 4 and all(len(r["seq"]) <= 4 for r in seqs.collect())
    assert without_stop_words(prepared, stop_table(spark, {"g": ["same"]}).select("word")).count() == 4
    cells = [("f", "rotten_tomatoes", part, role) for part in ("train", "test") for role in ("train", "test")]
    bow, tfidf = (f(prepared, cells, 10).select("domain", "doc_id", "y_pred") for f in (nb_bow, nb_tfidf))
    assert bow.count() == tfidf.count() == 4
    assert bow.select("domain", "doc_id").exceptAll(tfidf.select("domain", "doc_id")).count() == 0


def test_equal_numbers_in_two_domains(spark):
    rows = [("a", 1, ["good", "film"]), ("b", 1, ["bad", "plot", "plot"]), ("b", 2, [])]
    docs = document_terms(spark.createDataFrame(rows, "domain string, doc_id bigint, tokens array<string>"))
    vectors = spark.createDataFrame([("good", [0.0]), ("bad", [1.0])], "word string, vector array<double>")
    got = {(r["domain"], r["doc_id"]): list(r["vector"]) for r in pool_vectors(docs, vectors, 1).collect()}
    assert got == {("a", 1): [0.0], ("b", 1): [1.0], ("b", 2): [0.0]}
    lexicon = spark.createDataFrame([("good", 1.0), ("plot", -0.5)], "word string, polarity double")
    got = {(r["domain"], r["doc_id"]): r["polarity"] for r in lexicon_polarity(docs, lexicon).collect()}
    assert got == {("a", 1): 1.0, ("b", 1): -0.5, ("b", 2): 0.0}
    seqs = padded_sequences(token_sequences(docs, word_index(docs)), 3)
    assert {(r["domain"], r["doc_id"]): sum(x > 0 for x in r["seq"]) for r in seqs.collect()} == {("a", 1): 2, ("b", 1): 3, ("b", 2): 0}


def test_header_must_match(spark, paths):
    with pytest.raises(Exception, match="(?i)header"):
        read_headered(spark, paths["imdb"], "text string, label string").collect()


def test_pair_uses_the_lists_of_the_pair(spark, paths):
    rows = {r["domain"]: [] for r in pair_documents(spark, paths, "amazon", "twitter").select("domain").collect()}
    for r in pair_documents(spark, paths, "amazon", "twitter").collect():
        rows[r["domain"]].append(" ".join(r["tokens"]))
    assert sorted(rows["twitter"]) == ["", "bad day", "nice day"]  # "lol" is on the list of posts
    assert "works well" in rows["amazon"]


def test_corpus_folders(spark, paths, tmp_path):
    df = load_corpus(spark, paths)
    write_corpus(df, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("domain=*")) == sorted(f"domain={d}" for d in paths)
    back = spark.read.parquet(str(tmp_path / "c")).filter("domain = 'imdb'")
    assert back.count() == 2


def test_scores(spark, tmp_path):
    path = put(tmp_path / "m.csv", [["", "A", "B", "mean"], ["x", "0.1; 0.2", "0.3;0.4", "1"], ["y", "0.5; 0.6 ", "0.7;0.8", "2"]])
    long = read_scores(spark, path, ["A", "B"], drop=["mean"], field=1)
    got = {(r["dataset"], r["method"]): r["score"] for r in long.collect()}
    assert got == {("x", "A"): 0.2, ("x", "B"): 0.4, ("y", "A"): 0.6, ("y", "B"): 0.8}


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 'say "x"\nagain'), ("b", 2, " pad ")], "fold string, n int, t string")
    for form in ("csv", "parquet"):
        write_by_fold(df, str(tmp_path / form), form)
        assert {p.name for p in (tmp_path / form).glob("fold=*")} == {"fold=a", "fold=b"}
    write_sample(df, str(tmp_path / "sample"))
    assert len(list((tmp_path / "sample").glob("*.csv"))) == 1
    with pytest.raises(ValueError):
        write_by_fold(df, str(tmp_path / "x"), "xml")


def test_folds(spark):
    names = ["a", "b", "c"]
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 3 + 1).cast("int")).alias("domain")
    ).withColumn("part", hash_part(F.col("doc_id")))
    share = docs.filter("part = 'test'").count() / 600
    assert 0.15 < share < 0.25
    again = docs.repartition(7).select("doc_id", hash_part(F.col("doc_id")).alias("p2")).join(docs, "doc_id")
    assert again.filter("p2 != part").count() == 0
    for cells in (single_cells(names), transfer_cells(all_pairs(names)), leave_one_out_cells(names)):
        folds = fold_table(spark, cells)
        both = in_role(docs, folds, "train").select("fold", "doc_id").intersect(in_role(docs, folds, "test").select("fold", "doc_id"))
        assert both.count() == 0
    lodo = fold_table(spark, leave_one_out_cells(names))
    assert in_role(docs, lodo, "test").count() == 600 and in_role(docs, lodo, "train").count() == 1200


def test_prepare_and_written(spark, paths):
    docs = written(prepare(load_corpus(spark, paths)), "t")
    assert docs.columns == ["domain", "doc_id", "label", "part", "tokens"] and docs.count() == 12
    assert broadcast_if_small(docs, limit=3) is None and broadcast_if_small(docs, limit=50) is not None
