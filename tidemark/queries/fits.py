"""Queries with fitted models; where part of a result has an SQL form, it is checked."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.classifiers import fit_svm
from tidemark.operators.metrics import metrics_table, regression_metrics
from tidemark.operators.split import single_cells
from tidemark.operators.word2vec import train_word2vec as train_vectors
from tidemark.plans import experiments as X
from tidemark.queries.inputs import LEXICON, labelled, labelled_terms, lexicon, r6, train_only
from tidemark.session import in_parallel, written

SINGLE = X.Settings(window=5)


def _one_domain(spark: SparkSession, folder: str) -> DataFrame:
    """All labelled documents taken as one domain."""
    return written(labelled(spark, folder).withColumn("domain", F.lit("all")), "documents")


def _single(spark: SparkSession, folder: str, with_polarity: bool = False) -> X.FoldData:
    docs = _one_domain(spark, folder)
    words = lexicon(labelled_terms(spark, folder)) if with_polarity else None
    return X.fold_data(docs, single_cells(["all"]), SINGLE, words, LEXICON)


def word2vec_train(spark: SparkSession, folder: str) -> DataFrame:
    vectors = train_vectors(train_only(written(labelled(spark, folder), "documents")), window=5)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    return vectors.select("word", F.size("vector").alias("size"), F.round(norm, 4).alias("norm"))


def lr_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression on all three feature families."""
    grid = [(f, "Logistic Regression") for f in X.FEATURES]
    return X.classify(_single(spark, folder), grid)


def svm_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Plain linear SVM on TF-IDF; the score is the margin."""
    data = _single(spark, folder)
    scored = fit_svm(data.train, "tfidf")(data.test)
    return scored.select("doc_id", F.col("label").alias("y_true"), "y_pred", "score")


def svm_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    return X.classify(_single(spark, folder), [(f, "SVM") for f in X.FEATURES])


def polarity_regression(spark: SparkSession, folder: str) -> DataFrame:
    return regression_metrics(X.regress(_single(spark, folder, with_polarity=True)))


def mlp_predict(spark: SparkSession, folder: str) -> DataFrame:
    return X.neural_net(_single(spark, folder))


def stacked_features(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, copy, term, value): the non-zero entries of the stacked counts and weights.

    Copies 0 to 2 are counts, 3 to 5 are weights.
    """
    data = _single(spark, folder)
    terms = data.vocabulary.terms
    rows = X.stacked(data.test, len(terms), SINGLE.vector_size)
    entries = rows.select("doc_id", F.posexplode(vector_to_array("stacked_counts")).alias("at", "value")).filter("value <> 0")
    names = F.array(*[F.lit(t) for t in terms])
    return entries.select(
        "doc_id", F.floor(F.col("at") / len(terms)).cast("int").alias("copy"),
        F.get(names, F.col("at") % len(terms)).alias("term"), r6(F.col("value")).alias("value"),
    )


def exp_soft_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Soft vote of the eight members on stacked features."""
    return metrics_table(X.soft_vote_stacked(_single(spark, folder)))


def influential_words_lr(spark: SparkSession, folder: str) -> DataFrame:
    data = _single(spark, folder)
    jobs = [lambda f=f: X.logistic_words(data, f) for f in ("TF-IDF", "BOW")]
    tfidf, bow = in_parallel(spark, jobs)
    return tfidf.select(F.lit("TF-IDF").alias("feature"), "*").unionByName(bow.select(F.lit("BOW").alias("feature"), "*"))


QUERIES = {
    f.__name__: f
    for f in (
        word2vec_train, lr_predict, svm_predict, svm_calibrated, polarity_regression, mlp_predict,
        stacked_features, exp_soft_vote, influential_words_lr,
    )
}
