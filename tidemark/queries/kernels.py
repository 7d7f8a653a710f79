"""Queries of the kernel regression of polarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import kernel as K
from tidemark.operators.lexicon import lexicon_polarity
from tidemark.operators.metrics import regression_metrics
from tidemark.operators.terms import term_totals, vocabulary, with_idf
from tidemark.queries.inputs import LEXICON, VOCABULARY, labelled_terms, lexicon, r6, train_only
from tidemark.session import written

SIZE = 32
EPSILON = 0.1


def _features(spark: SparkSession, folder: str) -> DataFrame:
    """(domain, doc_id, part, features, polarity) of the labelled documents."""
    docs = labelled_terms(spark, folder)
    words = written(with_idf(vocabulary(term_totals(train_only(docs)), VOCABULARY), train_only(docs)), "words")
    gamma = K.scale_gamma(train_only(docs), words, max(1, words.count()))
    made = K.fourier_features(docs, words, SIZE, gamma, keep=["part"], bound=VOCABULARY)
    polarity = lexicon_polarity(docs, lexicon(docs), ("domain", "doc_id", "part"), LEXICON)
    return written(made.join(polarity, ["domain", "doc_id", "part"]), "fourier")


def fourier_features(spark: SparkSession, folder: str) -> DataFrame:
    """Fourier features of all labelled documents, one row per place."""
    rows = _features(spark, folder).select("doc_id", F.posexplode("features").alias("place", "value"))
    return rows.withColumn("value", r6(F.col("value")))


def kernel_normal_equations(spark: SparkSession, folder: str) -> DataFrame:
    """Upper triangle and right side (column SIZE + 1) of the first ridge step on the training rows."""
    none = np.zeros(SIZE + 1)
    sums = K.normal_equations(train_only(_features(spark, folder)), "polarity", SIZE, none, none, K.FIRST, K.FIRST, EPSILON, 1.0)
    wide = np.column_stack([sums["gram"], sums["right"]])
    rows = [(i, j, float(wide[i, j])) for i in range(SIZE + 1) for j in range(i, SIZE + 2)]
    table = spark.createDataFrame(rows, "i int, j int, value double")
    return table.withColumn("value", F.round("value", 4) + F.lit(0.0))


def polarity_kernel_certificate(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the fit, whether the duality gap proves it within a thousandth of its optimum, and whether
    the last step solves its normal equations."""
    train = train_only(_features(spark, folder))
    fit = K.fit_kernel_regression(train, "polarity", SIZE, EPSILON)
    return train.agg(
        F.count(F.lit(1)).alias("n_train"), F.lit(bool(fit.gap < 1e-3)).alias("optimal"), F.lit(bool(fit.residual < 1e-6)).alias("solved")
    )


def polarity_kernel_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the fitted regression on the test rows."""
    data = _features(spark, folder)
    fit = K.fit_kernel_regression(train_only(data), "polarity", SIZE, EPSILON)
    scored = fit.score(data.filter("part = 'test'"), "y_pred")
    return regression_metrics(scored.select(F.lit("TF-IDF").alias("feature"), F.col("polarity").alias("y_true"), "y_pred"), by=["feature"])


QUERIES = {f.__name__: f for f in (fourier_features, kernel_normal_equations, polarity_kernel_certificate, polarity_kernel_regression)}


def _uniform(text: str, start: int) -> str:
    return f"(CAST('0x' || substr(md5({text}), {start}, 8) AS BIGINT) + 0.5) / 4294967296.0"


_PIECES = f"""unitw AS MATERIALIZED (SELECT doc_id, part, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w
    FROM counts JOIN weighed USING (term)),
cells AS (SELECT (SELECT count(*) FROM docs WHERE part = 'train') * (SELECT count(*) FROM vocab) AS n),
gamma AS MATERIALIZED (SELECT 1 / ((SELECT count(*) FROM vocab) * (sum(w * w) / any_value(n) - pow(sum(w) / any_value(n), 2))) AS g
    FROM unitw, cells WHERE part = 'train'),
places AS (SELECT CAST(j AS INTEGER) AS j, 2 * pi() * {_uniform("'phase-' || j || '-42'", 1)} AS phase FROM range(1, {SIZE + 1}) p(j)),
dirs AS MATERIALIZED (SELECT term, j, sqrt(-2 * ln({_uniform("term || '-' || j || '-42'", 1)}))
    * cos(2 * pi() * {_uniform("term || '-' || j || '-42'", 9)}) AS d FROM vocab, places),
z AS MATERIALIZED (SELECT doc_id, part, j, sqrt(2.0 / {SIZE}) * cos(sqrt(2 * g) * coalesce(p, 0.0) + phase) AS v
    FROM docs CROSS JOIN places CROSS JOIN gamma
    LEFT JOIN (SELECT doc_id, j, sum(w * d) AS p FROM unitw JOIN dirs USING (term) GROUP BY ALL) USING (doc_id, j))"""


def oracles(composed) -> dict[str, str]:
    """SQL of the queries; ``composed`` puts the named pieces of other queries in front."""
    up, down = (f"sqrt(pow(polarity {s} {EPSILON}, 2) + {K.FIRST**2})" for s in "-+")
    return {
        "fourier_features": composed("weighed", _PIECES, "SELECT doc_id, j - 1 AS place, round(v, 6) + 0.0 AS value FROM z"),
        "kernel_normal_equations": composed("weighed doc_polarity", _PIECES + f""",
            fit AS (SELECT doc_id, {K.FIRST**2} * (pow(up, -3) + pow(down, -3)) / 2 AS q,
                ((polarity - {EPSILON}) / up + (polarity + {EPSILON}) / down) / 2 AS t
                FROM (SELECT doc_id, polarity, {up} AS up, {down} AS down FROM doc_polarity WHERE part = 'train')),
            x AS MATERIALIZED (SELECT doc_id, j - 1 AS i, v, q, t FROM z JOIN fit USING (doc_id)
                UNION ALL SELECT doc_id, {SIZE}, 1.0, q, t FROM fit)""",
            f"""SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.q * a.v * b.v), 4) + 0.0 AS value
            FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.i <= b.i GROUP BY ALL
            UNION ALL SELECT CAST(i AS INTEGER), {SIZE + 1}, round(sum(t * v), 4) + 0.0 FROM x GROUP BY i"""),
        "polarity_kernel_certificate": composed("docs", "", "SELECT count(*) AS n_train, TRUE AS optimal, TRUE AS solved FROM docs WHERE part = 'train'"),
    }
