"""Sparse document vectors over a fitted vocabulary.

Once the vocabulary is known (a thousand terms, fitted on training rows), a document is
turned into its vector inside its own row. Neither counts, weights nor norms need a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.terms import term_totals, vocabulary, with_idf


@dataclass(frozen=True)
class Vocabulary:
    """Terms by rank with their inverse document frequencies."""

    terms: list[str]
    idf: list[float]

    @staticmethod
    def collect(table: DataFrame, size: int = 1000) -> Vocabulary:
        """From a table (rank, term, idf) of at most ``size`` rows."""
        rows = table.select("rank", "term", "idf").orderBy("rank").limit(size).collect()
        return Vocabulary([r["term"] for r in rows], [r["idf"] for r in rows])


def fit_vocabulary(train: DataFrame, size: int = 1000) -> Vocabulary:
    """Most frequent terms of the training documents (with ``terms``) and their idf."""
    return Vocabulary.collect(with_idf(vocabulary(term_totals(train), size), train), size)


def count_vectors(docs: DataFrame, vocab: Vocabulary, out: str = "bow") -> DataFrame:
    """Term counts as a sparse vector; terms outside the vocabulary are dropped."""
    if not vocab.terms:
        raise ValueError("the training documents hold no term")
    # The vectorizer reads a bag of tokens, so each counted term is repeated.
    bag = F.flatten(F.transform("terms", lambda t: F.array_repeat(t["term"], t["tf"].cast("int"))))
    model = CountVectorizerModel.from_vocabulary(vocab.terms, inputCol="__bag", outputCol=out)
    return model.transform(docs.withColumn("__bag", bag)).drop("__bag")


def tfidf_vectors(docs: DataFrame, vocab: Vocabulary, counts: str = "bow", out: str = "tfidf") -> DataFrame:
    """Counts times idf, scaled to length 1; a document without known terms stays zero."""
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(vocab.idf), inputCol=counts, outputCol="__weighted")
    normed = Normalizer(p=2.0, inputCol="__weighted", outputCol=out)
    return normed.transform(weighted.transform(docs)).drop("__weighted")


def vector_terms(docs: DataFrame, vector: str, vocab: Vocabulary, value: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keep, term, value): the non-zero entries of a vector column."""
    names = F.array(*[F.lit(t) for t in vocab.terms])
    entries = docs.select(*keep, F.posexplode(vector_to_array(F.col(vector))).alias("at", value))
    return entries.filter(F.col(value) != 0).select(*keep, F.get(names, F.col("at")).alias("term"), value)
