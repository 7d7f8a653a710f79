"""Multinomial naive Bayes on term counts, in closed form and for any number of folds at once.

Counts are taken once per (domain, part, label, term) and then added up per fold, so a
further fold costs a pass over the counts and not over the texts. The smoothed term
probabilities and the unsmoothed class priors follow the usual multinomial form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.split import in_role
from tidemark.operators.terms import exploded_terms, vocabulary
from tidemark.operators.weights import with_term_sums
from tidemark.session import broadcast_if_small, written

CLASSES = (0, 1)
CELL = ["domain", "part", "label"]


def fold_sizes(docs: DataFrame, folds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """(fold, n, n_<class>...): training documents per fold and class."""
    cells = docs.groupBy(*CELL).agg(F.count(F.lit(1)).alias("docs"))
    return (
        in_role(cells, folds, "train")
        .groupBy("fold")
        .agg(
            F.sum("docs").alias("n"),
            *[F.sum(F.when(F.col("label") == c, F.col("docs")).otherwise(0)).alias(f"n_{c}") for c in classes],
        )
    )


def fold_terms(docs: DataFrame, folds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """(fold, term, cnt, df, c_<class>...): training counts per fold, term and class."""
    cells = (
        exploded_terms(docs, *CELL)
        .groupBy(*CELL, "term")
        .agg(F.sum("tf").alias("cnt"), F.count(F.lit(1)).alias("df"))
    )
    return (
        in_role(cells, folds, "train")
        .groupBy("fold", "term")
        .agg(
            F.sum("cnt").alias("cnt"),
            F.sum("df").alias("df"),
            *[F.sum(F.when(F.col("label") == c, F.col("cnt")).otherwise(0)).alias(f"c_{c}") for c in classes],
        )
    )


def nb_model(
    terms: DataFrame,
    size: int = 1000,
    alpha: float = 1.0,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Vocabulary of each fold with ln P(term | class) in lp_<class>."""
    fold = W.partitionBy("fold")  # at most `size` rows per fold
    vocab = vocabulary(terms, size, ["fold"]).withColumn("v", F.count(F.lit(1)).over(fold))
    return vocab.select(
        "*",
        *[
            F.log((F.col(f"c_{c}") + alpha) / (F.sum(f"c_{c}").over(fold) + alpha * F.col("v"))).alias(f"lp_{c}")
            for c in classes
        ],
    ).drop("v")


def priors(sizes: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """(fold, prior_<class>...): ln of the class shares; NULL for a class not in training."""
    return sizes.select("fold", *[F.log(F.col(f"n_{c}") / F.col("n")).alias(f"prior_{c}") for c in classes])


def decide(scores: dict[int, Column]) -> tuple[Column, Column]:
    """Predicted class and probability of the last class out of log scores.

    Differences are rounded to nine digits before they are compared, so that the order of a
    distributed sum cannot decide a tie; equal scores go to the lowest class. A class without
    a score (absent in training) is never predicted.
    """
    classes = sorted(scores)
    floor = F.lit(float("-inf"))
    parts = [F.coalesce(scores[c], floor) for c in classes]
    best = F.greatest(*parts)
    gaps = F.array(*[F.round(p - best, 9) for p in parts])
    index = F.array_position(gaps, F.array_max(gaps)).cast("int")
    y_pred = F.element_at(F.array(*[F.lit(c) for c in classes]), index)
    weights = [F.exp(p - best) for p in parts]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return y_pred, weights[-1] / total


def margin(scores: dict[int, Column]) -> Column:
    """Log odds of the last class against the first, which rank where probabilities saturate.

    Rounded to nine digits, so that the order of a distributed sum cannot break a tie.
    """
    classes = sorted(scores)
    return F.round(scores[classes[-1]] - scores[classes[0]], 9)


def nb_predict(
    docs: DataFrame,
    folds: DataFrame,
    model: DataFrame,
    sizes: DataFrame,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Predictions of each fold's test documents; a document without known terms gets the prior.

    Terms are scored where they are and summed per document before the shuffle, so what
    moves is one row per document and fold. The model holds at most ``size`` terms per fold
    and is broadcast.
    """
    return score_terms(in_role(docs, folds, "test"), model, sizes, classes)


def score_terms(tests: DataFrame, model: DataFrame, sizes: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Predictions for ``tests`` (fold, domain, doc_id, label, terms with their weight in ``tf``).

    Terms are scored and summed inside their row, by a model that every task holds: one row per document is shuffled. A model
    of more rows than may be broadcast is joined instead.
    """
    keys = ["fold", "domain", "doc_id", "label"]
    lps = [f"lp_{c}" for c in classes]
    table = written(model.select("fold", "term", *lps), "model")
    if broadcast_if_small(table) is not None:
        # Summed inside the row; rows of one document are added up.
        summed = with_term_sums(tests.select(*keys, "terms"), table, "fold", lps).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in lps])
    else:
        rows = exploded_terms(tests, *keys, outer=True).join(table, ["fold", "term"], "left")
        summed = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col("tf") * F.col(c)), F.lit(0.0)).alias(c) for c in lps])
    scored = summed.join(F.broadcast(priors(sizes, classes)), "fold")
    priors_and_sums = {c: F.col(f"prior_{c}") + F.col(f"lp_{c}") for c in classes}
    y_pred, score = decide(priors_and_sums)
    return scored.select(
        "fold",
        "domain",
        "doc_id",
        F.lit("BOW").alias("feature"),
        F.lit("Naive Bayes").alias("model"),
        F.col("label").alias("y_true"),
        y_pred.alias("y_pred"),
        score.alias("score"),
        margin(priors_and_sums).alias("margin"),
    )
