"""What the registered queries share: prepared documents, the lexicon, the word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stoplists import GENERAL
from tidemark.functions.text import clean_tokens
from tidemark.operators.split import leave_one_out_cells
from tidemark.operators.terms import document_terms, term_totals, vocabulary
from tidemark.plans.closed_form import closed_form_predictions
from tidemark.plans.prepare import prepare
from tidemark.session import spread, written
from tidemark.sources.corpus import DOMAINS, all_documents, corpus, read_table

VOCABULARY = 1000
LEXICON = 200
# Mean polarities often lie exactly between two six-digit values, where the last bit of a sum
# would decide; all of them are moved up by the same tiny amount before rounding.
NUDGE = 1e-9
PROFILE = {"d0": "twitter", "d1": "amazon", "d2": "spotify", "d3": "film_long", "d4": "film_small"}
MODELS = [("BOW", "Naive Bayes"), ("TF-IDF", "Naive Bayes"), ("Lexicon", "Polarity"), ("None", "Majority")]


def r6(col):
    """Six digits, without a negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(corpus(spark, folder))


def labelled_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with ``terms``, written once because several passes read them."""
    return written(document_terms(labelled(spark, folder)).drop("tokens"), "documents")


def tokenized(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its cleaned tokens."""
    raw = all_documents(spark, folder)
    return raw.select("domain", "doc_id", clean_tokens(F.col("raw_text"), GENERAL).alias("tokens"))


def chats(spark: SparkSession, folder: str) -> DataFrame:
    source = read_table(spark, folder, "conversations")
    return spread(source, source, "conv_id", "turn")


def train_only(docs: DataFrame) -> DataFrame:
    return docs.filter("part = 'train'")


def lexicon(docs: DataFrame) -> DataFrame:
    """(word, polarity) for the most frequent training terms; polarity is a function of the word."""
    value = ((7 * F.length("term") + 13 * F.ascii("term")) % 201 - 100) / 100
    return vocabulary(term_totals(train_only(docs)), LEXICON).select(F.col("term").alias("word"), value.alias("polarity"))


def word_vectors(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """(word, vector): the training term of rank r takes the vector with vec_id r - 1.

    Ranks beyond the vector table stay without a vector.
    """
    ranks = vocabulary(term_totals(train_only(docs)), VOCABULARY)
    vectors = read_table(spark, folder, "embeddings").select((F.col("vec_id") + 1).alias("rank"), "embedding")
    return vectors.join(F.broadcast(ranks.select("rank", "term")), "rank").select(
        F.col("term").alias("word"), F.col("embedding").alias("vector")
    )


def leave_one_out_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The four closed-form methods on the five leave-one-domain-out folds."""
    docs = labelled_terms(spark, folder)
    return closed_form_predictions(docs, leave_one_out_cells(DOMAINS), lexicon(docs), LEXICON, VOCABULARY)
