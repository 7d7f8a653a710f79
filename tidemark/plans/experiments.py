"""Full model grids on one fold: eight classifiers, three regressions and a small neural net.

Everything fitted (vocabulary, idf, word vectors, models) sees training rows only. Each model
is fitted once; ensembles vote over the predictions that are already there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stoplists import PAIR_PROFILES
from tidemark.operators.classifiers import (
    class_sizes,
    fit_calibrated_svm,
    fit_logistic,
    fit_mlp,
    fit_naive_bayes,
    fit_regression,
    logistic_model,
)
from tidemark.operators.explain import influential_words
from tidemark.operators.features import Vocabulary, count_vectors, fit_vocabulary, tfidf_vectors
from tidemark.operators.lexicon import lexicon_polarity
from tidemark.operators.metrics import metrics_table
from tidemark.operators.split import Cell, fold_table, in_role, transfer_cells
from tidemark.operators.terms import document_terms
from tidemark.operators.vectors import pool_vectors
from tidemark.operators.voting import hard_vote, soft_vote
from tidemark.operators.word2vec import train_word2vec
from tidemark.plans.closed_form import PREDICTION
from tidemark.plans.prepare import prepare
from tidemark.session import drop, fit_partitions, in_parallel, written
from tidemark.sources.layouts import LAYOUTS

FEATURES = {"BOW": "bow", "TF-IDF": "tfidf", "Word2Vec": "w2v"}
# Word vectors have negative entries, which naive Bayes rejects.
GRID = [
    (feature, model)
    for feature in FEATURES
    for model in ("SVM", "Naive Bayes", "Logistic Regression")
    if (feature, model) != ("Word2Vec", "Naive Bayes")
]


@dataclass(frozen=True)
class Settings:
    vocabulary: int = 1000
    vector_size: int = 100
    window: int = 8
    min_count: int = 1
    logistic_iterations: int = 1000
    svm_folds: int = 5
    threads: int = 4


@dataclass(frozen=True)
class FoldData:
    """Feature vectors of one fold, written once and read by every fit."""

    fold: str
    train: DataFrame
    test: DataFrame
    vocabulary: Vocabulary
    settings: Settings = field(default_factory=Settings)


def model_grid(docs: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """(fold, feature, model, n_train, n_test): the fits of a run and the rows they see."""
    folds = fold_table(docs.sparkSession, cells)
    counts = docs.groupBy("domain", "part").agg(F.count(F.lit(1)).alias("n"))
    roles = counts.join(F.broadcast(folds), ["domain", "part"])
    sizes = roles.groupBy("fold").agg(
        *[F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0)).alias(f"n_{r}") for r in ("train", "test")]
    )
    grid = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(m).alias("model")) for f, m in GRID])
    return sizes.select("fold", F.inline(grid), "n_train", "n_test")


def fold_data(
    docs: DataFrame,
    cells: Sequence[Cell],
    settings: Settings = Settings(),
    lexicon: DataFrame | None = None,
    bound: int | None = None,
) -> FoldData:
    """Build the three feature families of one fold. ``docs`` comes from ``prepare``."""
    (fold,) = {c[0] for c in cells}
    folds = fold_table(docs.sparkSession, cells)
    all_terms = document_terms(docs, min_length=1)
    terms = F.filter("terms", lambda t: F.length(t["term"]) >= 2)
    train_docs = in_role(docs, folds, "train")
    vocab = fit_vocabulary(in_role(all_terms, folds, "train").withColumn("terms", terms), settings.vocabulary)
    vectors = train_word2vec(train_docs, settings.vector_size, settings.window, settings.min_count)
    roles = all_terms.join(F.broadcast(folds), ["domain", "part"])
    keys = ["domain", "doc_id", "role"]
    means = pool_vectors(roles, vectors, settings.vector_size, keys)
    pooled = means.select(*keys, array_to_vector("vector").alias("w2v"))
    rows = tfidf_vectors(count_vectors(roles.withColumn("terms", terms), vocab), vocab)
    rows = rows.select(*keys, "label", "bow", "tfidf").join(pooled, keys)
    if lexicon is not None:
        rows = rows.join(lexicon_polarity(roles, lexicon, keys, bound), keys)
    table = written(rows, f"features-{fold}")
    drop(vectors, means)
    train = table.filter("role = 'train'")
    return FoldData(fold, fit_partitions(train, train.count()), table.filter("role = 'test'"), vocab, settings)


def _fit(data: FoldData, feature: str, model: str, sizes: dict[int, int]):
    column = FEATURES[feature]
    if model == "SVM":
        return fit_calibrated_svm(data.train, column, data.settings.svm_folds)
    if model == "Naive Bayes":
        return fit_naive_bayes(data.train, column, sizes)
    return fit_logistic(data.train, column, data.settings.logistic_iterations)


def _predictions(scored: DataFrame, fold: str, feature: str, model: str) -> DataFrame:
    return scored.select(
        F.lit(fold).alias("fold"),
        "domain",
        "doc_id",
        F.lit(feature).alias("feature"),
        F.lit(model).alias("model"),
        F.col("label").alias("y_true"),
        "y_pred",
        "score",
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def classify(data: FoldData, grid: Sequence[tuple[str, str]] = GRID) -> DataFrame:
    """Long predictions of every (feature, model) in the grid."""
    sizes = class_sizes(data.train)

    def run(feature: str, model: str) -> DataFrame:
        return _predictions(_fit(data, feature, model, sizes)(data.test), data.fold, feature, model)

    jobs = [lambda f=f, m=m: run(f, m) for f, m in grid]
    return _union(in_parallel(data.train.sparkSession, jobs, data.settings.threads)).select(*PREDICTION)


def neural_net(data: FoldData) -> DataFrame:
    """Predictions of the neural net on the pooled word vectors."""
    score, _ = fit_mlp(data.train, "w2v", data.settings.vector_size)
    return _predictions(score(data.test), data.fold, "Word2Vec", "Neural Net").select(*PREDICTION)


def regress(data: FoldData) -> DataFrame:
    """(fold, domain, doc_id, feature, model, y_true, y_pred): polarity from each feature family."""

    def run(feature: str) -> DataFrame:
        scored = fit_regression(data.train, FEATURES[feature], "polarity")(data.test)
        return scored.select(
            F.lit(data.fold).alias("fold"),
            "domain",
            "doc_id",
            F.lit(feature).alias("feature"),
            F.lit("Linear Regression").alias("model"),
            F.col("polarity").alias("y_true"),
            F.col("y_hat").alias("y_pred"),
        )

    jobs = [lambda f=f: run(f) for f in FEATURES]
    return _union(in_parallel(data.train.sparkSession, jobs, data.settings.threads))


def with_votes(pred: DataFrame) -> DataFrame:
    """Predictions plus the hard vote within each feature family."""
    votes = hard_vote(pred).withColumn("score", F.lit(None).cast("double"))
    return pred.unionByName(votes.select(*pred.columns))


def stacked(df: DataFrame, terms: int, vector_size: int) -> DataFrame:
    """All feature sets side by side.

    The eight members would each repeat their features: three times the counts, three times
    the weighted counts, twice the word vectors. Under an L2 penalty, m equal columns act as
    one column scaled by the root of m, so ``stacked`` holds each set once, scaled. Naive
    Bayes scores repeated columns instead; it gets ``stacked_counts`` with true copies of the
    two non-negative sets.
    """
    out = df
    for column, copies, width in (("bow", 3, terms), ("tfidf", 3, terms), ("w2v", 2, vector_size)):
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense([copies**0.5] * width), inputCol=column, outputCol=f"__{column}"
        )
        out = scale.transform(out)
    out = VectorAssembler(inputCols=["__bow", "__tfidf", "__w2v"], outputCol="stacked").transform(out)
    copies = ["bow"] * 3 + ["tfidf"] * 3
    out = VectorAssembler(inputCols=copies, outputCol="stacked_counts").transform(out)
    return out.drop("__bow", "__tfidf", "__w2v")


# How many of the eight members share a model once all of them see the same stacked features.
STACKED_WEIGHTS = {"SVM": 3.0, "Naive Bayes": 2.0, "Logistic Regression": 3.0}


def soft_vote_stacked(data: FoldData) -> DataFrame:
    """Mean class probability of the eight members on stacked features.

    On one and the same feature matrix members of a kind are identical, so three fits weighted
    3 : 2 : 3 give the mean of eight.
    """
    widths = len(data.vocabulary.terms), data.settings.vector_size
    train, test = stacked(data.train, *widths), stacked(data.test, *widths)
    sizes = class_sizes(data.train)
    fits = {
        "SVM": lambda: fit_calibrated_svm(train, "stacked", data.settings.svm_folds),
        "Naive Bayes": lambda: fit_naive_bayes(train, "stacked_counts", sizes),
        "Logistic Regression": lambda: fit_logistic(train, "stacked", data.settings.logistic_iterations),
    }
    scorers = in_parallel(train.sparkSession, list(fits.values()), data.settings.threads)
    pred = _union([_predictions(s(test), data.fold, "Stacked", m) for m, s in zip(fits, scorers)])
    return soft_vote(pred, STACKED_WEIGHTS, by=["feature"])


def logistic_words(data: FoldData, feature: str = "TF-IDF", n: int = 10) -> DataFrame:
    """Highest and lowest coefficients of the logistic regression of one feature family."""
    model = logistic_model(data.train, FEATURES[feature], data.settings.logistic_iterations)
    spark = data.train.sparkSession
    rows = list(zip(data.vocabulary.terms, map(float, model.coefficients)))
    return influential_words(spark.createDataFrame(rows, "term string, weight double"), n)


def leave_one_out_grid(
    docs: DataFrame, folds: Mapping[str, Sequence[Cell]], settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """Predictions (with hard votes) and metrics of the whole grid over several folds."""
    jobs = [lambda c=c: with_votes(classify(fold_data(docs, c, settings))) for c in folds.values()]
    parts = in_parallel(docs.sparkSession, jobs, settings.threads)
    pred = written(_union(parts), "predictions")
    return pred, metrics_table(pred)


def pair_documents(spark: SparkSession, paths: Mapping[str, str], source: str, target: str) -> DataFrame:
    """Prepared documents of one train/test pair, each side cleaned with the list it has there."""
    sides = PAIR_PROFILES.get((source, target), (None, None))
    parts = []
    for domain, profile in zip((source, target), sides):
        layout = LAYOUTS[domain]
        rows = written(layout.corpus(layout.read(spark, paths[domain]), domain), "corpus")
        parts.append(prepare(rows, profile={domain: profile} if profile else None))
    return _union(parts)


def transfer(
    docs: DataFrame,
    source: str,
    target: str,
    settings: Settings = Settings(),
    lexicon: DataFrame | None = None,
) -> FoldData:
    """Features of one train-on-A, test-on-B run, ready for ``classify`` and the others."""
    return fold_data(docs, transfer_cells([(source, target)]), settings, lexicon)
