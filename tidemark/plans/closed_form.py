"""Experiments whose models have a closed form: all folds of a run share one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lexicon import lexicon_polarity
from tidemark.operators.naive_bayes import CLASSES, fold_sizes, fold_terms, nb_model, nb_predict, score_terms
from tidemark.operators.split import Cell, fold_table, in_role
from tidemark.operators.terms import smooth_idf, vocabulary
from tidemark.operators.weights import with_vocabulary
from tidemark.session import written

PREDICTION = ("fold", "domain", "doc_id", "feature", "model", "y_true", "y_pred", "score")


def nb_bow(docs: DataFrame, cells: Sequence[Cell], size: int = 1000, terms: DataFrame | None = None) -> DataFrame:
    """Naive Bayes on term counts for every fold in ``cells``. ``docs`` carries ``terms``; ``terms``
    are the folds' counts (``fold_terms``) where they are at hand."""
    folds = fold_table(docs.sparkSession, cells)
    sizes = fold_sizes(docs, folds)
    model = nb_model(fold_terms(docs, folds) if terms is None else terms, size)
    return nb_predict(docs, folds, model, sizes)


def nb_tfidf(docs: DataFrame, cells: Sequence[Cell], size: int = 1000, terms: DataFrame | None = None) -> DataFrame:
    """Naive Bayes on TF-IDF weights, all folds in one plan.

    Weights differ between folds, because the idf does: a document is weighed once per fold it is
    in. Rows of one document are put together once; its terms meet the vocabulary of each fold (at most ``size`` rows,
    held by every task) inside that row, so nothing else is shuffled. The weighed rows are written, since training and scoring both read them.
    """
    folds = fold_table(docs.sparkSession, cells)
    sizes = fold_sizes(docs, folds)
    idf = smooth_idf(F.col("df"), F.col("n")).alias("idf")
    terms = fold_terms(docs, folds) if terms is None else terms
    words = written(
        vocabulary(terms, size, ["fold"]).join(F.broadcast(sizes), "fold").select(
            "fold", "term", F.col("rank").cast("int").alias("at"), idf
        ),
        "fold-vocabulary",
    )
    keys = ["fold", "role", "domain", "doc_id", "label"]
    listed = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf")))
    merged = docs.groupBy("domain", "part", "doc_id", "label").agg(F.flatten(F.collect_list(listed)).alias("terms"))
    roles = merged.join(F.broadcast(folds), ["domain", "part"]).select(*keys, "terms")
    table = written(with_vocabulary(roles, words, "fold").select(*keys, "ranks", "weights"), "weights")
    places = table.filter("role = 'train'").select("fold", "label", F.inline(F.arrays_zip(F.col("ranks").alias("at"), F.col("weights").alias("tf"))))
    sums = [F.sum(F.when(F.col("label") == c, F.col("tf")).otherwise(0.0)).alias(f"c_{c}") for c in CLASSES]
    trained = places.groupBy("fold", "at").agg(*sums)
    # Every vocabulary word occurs in training; the counts only need smoothing.
    inside = W.partitionBy("fold")
    v = F.count(F.lit(1)).over(inside)
    lps = [F.log((F.col(f"c_{c}") + 1.0) / (F.sum(f"c_{c}").over(inside) + v)).alias(f"lp_{c}") for c in CLASSES]
    model = trained.select("fold", F.col("at").cast("string").alias("term"), *lps)
    entries = F.transform(F.arrays_zip("ranks", "weights"), lambda e: F.struct(e["ranks"].cast("string").alias("term"), e["weights"].alias("tf")))
    tests = table.filter("role = 'test'").select(*keys, entries.alias("terms"))
    return score_terms(tests, model, sizes).withColumn("feature", F.lit("TF-IDF"))


def lexicon_votes(docs: DataFrame, cells: Sequence[Cell], lexicon: DataFrame, bound: int | None = None) -> DataFrame:
    """Class 1 where the mean polarity is above zero; nothing is fitted."""
    tests = in_role(docs, fold_table(docs.sparkSession, cells), "test")
    scored = lexicon_polarity(tests, lexicon, ("fold", "domain", "doc_id", "label"), bound)
    return scored.select(
        "fold",
        "domain",
        "doc_id",
        F.lit("Lexicon").alias("feature"),
        F.lit("Polarity").alias("model"),
        F.col("label").alias("y_true"),
        (F.round("polarity", 9) > 0).cast("int").alias("y_pred"),
        ((F.col("polarity") + 1) / 2).alias("score"),
    )


def majority_votes(docs: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """The larger training class for every test document; the floor any model has to beat."""
    folds = fold_table(docs.sparkSession, cells)
    tests = in_role(docs.drop("terms"), folds, "test")
    sized = tests.join(F.broadcast(fold_sizes(docs, folds)), "fold")
    return sized.select(
        "fold",
        "domain",
        "doc_id",
        F.lit("None").alias("feature"),
        F.lit("Majority").alias("model"),
        F.col("label").alias("y_true"),
        (F.col("n_1") > F.col("n_0")).cast("int").alias("y_pred"),
        (F.col("n_1") / F.col("n")).alias("score"),
    )


def closed_form_predictions(
    docs: DataFrame, cells: Sequence[Cell], lexicon: DataFrame, bound: int | None = None, size: int = 1000
) -> DataFrame:
    """All four methods side by side, in long form. ``docs`` should be a written table."""
    terms = written(fold_terms(docs, fold_table(docs.sparkSession, cells)), "fold-terms")
    parts = [nb_bow(docs, cells, size, terms), nb_tfidf(docs, cells, size, terms)]
    parts += [lexicon_votes(docs, cells, lexicon, bound), majority_votes(docs, cells)]
    out = parts[0].select(*PREDICTION)
    for part in parts[1:]:
        out = out.unionByName(part.select(*PREDICTION))
    return out


def predictions_wide(pred: DataFrame, models: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per test document with a column of predicted labels per (feature, model)."""
    named = pred.withColumn("__name", F.concat_ws("_", "feature", "model"))
    names = [f"{f}_{m}" for f, m in models]
    return (
        named.groupBy("fold", "domain", "doc_id", "y_true").pivot("__name", names).agg(F.first("y_pred"))
    )


def sample_predictions(wide: DataFrame, corpus: DataFrame, size: int = 10, seed: int = 42) -> DataFrame:
    """``size`` test documents with their raw text and all predictions.

    The sample is the top of an order by hash: a top-k that gives the same rows every time.
    Only the sampled keys meet the texts.
    """
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"-{seed}")))
    best = wide.orderBy(order, "fold", "doc_id").limit(size)
    return corpus.select("domain", "doc_id", "raw_text").join(F.broadcast(best), ["domain", "doc_id"])


def scores_long(metrics: DataFrame, method: Sequence[str] = ("feature", "model")) -> DataFrame:
    """(slice, dataset, method, score): one slice per metric, the fold's test domain as dataset."""
    named = metrics.withColumn("method", F.concat_ws(" / ", *method))
    slices = ["accuracy", "precision", "recall", "f1"]
    return named.unpivot(["fold", "method"], slices, "slice", "score").select(
        "slice", F.col("fold").alias("dataset"), "method", "score"
    )


