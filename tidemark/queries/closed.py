"""Queries with an exact SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import above, map_values
from tidemark.functions.stoplists import GENERAL, PROFILES
from tidemark.functions.text import clean_tokens, clean_tokens_by_profile, join_words, long_tokens
from tidemark.operators.explain import influential_words as most_influential
from tidemark.operators.explain import log_odds
from tidemark.operators.features import count_vectors, fit_vocabulary, tfidf_vectors, vector_terms
from tidemark.operators.lexicon import lexicon_polarity as polarity_of
from tidemark.operators import metrics as M
from tidemark.operators import ranks as R
from tidemark.operators import sequences as S
from tidemark.operators.naive_bayes import fold_terms
from tidemark.operators.ordering import encode_values, mid_ranks
from tidemark.operators.naive_bayes import nb_model as fit_nb
from tidemark.operators.split import (
    all_pairs,
    fold_table,
    hash_part,
    leave_one_out_cells,
    single_cells,
    split_exactly,
    transfer_cells,
)
from tidemark.operators.stopwords import keep_words, stop_table, without_stop_words
from tidemark.operators.terms import document_terms, exploded_terms, smooth_idf, term_totals, vocabulary
from tidemark.operators.vectors import pool_vectors
from tidemark.operators.voting import hard_vote as vote_hard
from tidemark.operators.voting import soft_vote as vote_soft
from tidemark.plans import closed_form as C
from tidemark.plans.experiments import model_grid as grid_of
from tidemark.queries.inputs import (
    LEXICON,
    MODELS,
    NUDGE,
    PROFILE,
    VOCABULARY,
    chats,
    labelled,
    labelled_terms,
    leave_one_out_predictions,
    lexicon,
    r6,
    tokenized,
    train_only,
    word_vectors,
)
from tidemark.session import scratch_path, written
from tidemark.sources.corpus import DOMAINS, all_documents, corpus as read_corpus, read_table
from tidemark.sources.layouts import LAYOUTS, load_corpus, read_headered
from tidemark.sources.results import read_scores, write_by_fold

CSV = dict(quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


# Sources


def load_headered(spark: SparkSession, folder: str) -> DataFrame:
    """Documents through a CSV file with a header and back."""
    path = scratch_path(spark, "headered")
    table = read_table(spark, folder, "documents").select("doc_id", "source", "text")
    table.write.options(header=True, **CSV).csv(path)
    back = read_headered(spark, path, table.schema)
    return back.select("doc_id", "source", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def load_positional(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents through a headerless CSV file; two of three classes are kept and encoded."""
    path = scratch_path(spark, "positional")
    labels = read_table(spark, folder, "labels")
    table = read_table(spark, folder, "documents").join(labels, "doc_id")
    sentiment = F.when(F.col("toxic") == 1, "Irrelevant").when(F.col("quality") == 1, "Positive").otherwise("Negative")
    table.select("doc_id", "source", sentiment, "text").write.options(header=False, **CSV).csv(path)
    layout = LAYOUTS["twitter"]
    rows = layout.corpus(layout.read(spark, path), "posts", key=lambda: F.col("_c0"))
    return rows.select("doc_id", "label", F.md5("raw_text").alias("digest"))


def _review_columns(layout: str) -> list:
    """Columns of a corpus row as the layout's file has them."""
    text, label = F.col("raw_text"), F.col("label")

    def named(one: str, zero: str):
        return F.when(label == 1, one).otherwise(zero)

    return {
        "imdb": [text.alias("review"), named("positive", "negative").alias("sentiment")],
        "spotify": [text.alias("Review"), named("POSITIVE", "NEGATIVE").alias("label")],
        "rotten_tomatoes": [text.alias("text"), label.alias("label")],
        "twitter": [F.col("doc_id"), F.lit("topic"), named("Positive", "Negative"), text],
        "amazon": [label + 1, F.lit("title"), text],
    }[layout]


def load_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents, each twice, through the files of the five layouts; one domain per layout."""
    rows = written(read_corpus(spark, folder), "reviews")
    paths = {}
    for domain, name in zip(DOMAINS, LAYOUTS):
        mine = rows.filter(F.col("domain") == domain).select(*_review_columns(name))
        paths[name] = scratch_path(spark, f"reviews-{name}")
        mine.union(mine).write.options(header=LAYOUTS[name].header, **CSV).csv(paths[name])
    docs = load_corpus(spark, paths)
    counts = docs.groupBy("domain", "label", F.md5("raw_text").alias("digest"))
    return counts.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents"))


def predictions_files(spark: SparkSession, folder: str) -> DataFrame:
    """Naive Bayes predictions written with one folder per fold and read back."""
    path = scratch_path(spark, "predictions")
    pred = _nb_folds(spark, folder, leave_one_out_cells(DOMAINS)).select("fold", "domain", "doc_id", "y_true", "y_pred")
    write_by_fold(pred, path, "parquet")
    return spark.read.parquet(path).select("fold", "doc_id", "y_true", "y_pred")


def score_file(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and F1 in one cell, a matrix of folds and methods written as CSV; the F1 is read back."""
    path = scratch_path(spark, "scores")
    cell = F.concat_ws("; ", *[F.format_string("%.6f", c) for c in ("accuracy", "f1")])
    table = metrics_table(spark, folder).select("fold", F.concat_ws(" / ", "feature", "model").alias("method"), cell.alias("cell"))
    methods = [f"{f} / {m}" for f, m in MODELS]
    wide = table.groupBy("fold").pivot("method", methods).agg(F.first("cell")).withColumn("mean", F.lit("1"))
    wide.write.options(header=True, **CSV).csv(path)
    back = read_scores(spark, path, methods, drop=["mean"], field=1)
    return back.select("dataset", "method", r6(F.col("score")).alias("score"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return read_corpus(spark, folder).select("domain", "doc_id", "label", F.md5("raw_text").alias("digest"))


# Filters and label mapping


def filter_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").filter(F.col("role").isin("user", "assistant"))
    return rows.select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


def map_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Values 1, 2, 3 mapped by {1: 0, 2: 1}; the third has no entry."""
    raw = (F.col("quality") + F.col("toxic") + 1).alias("raw")
    rows = read_table(spark, folder, "labels").select("doc_id", raw)
    return rows.withColumn("label", map_values(F.col("raw"), {1: 0, 2: 1}))


def encode_roles(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return encode_values(rows, "role").withColumn("label", F.col("label").cast("int"))


def encode_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Index of each word among all sorted words of the labelled documents: a code list as long as the vocabulary."""
    words = exploded_terms(labelled_terms(spark, folder), "doc_id")
    return encode_values(words.select("doc_id", "term"), "term", "code")


def term_mid_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rank of each count among all counts of terms, within its domain."""
    totals = term_totals(labelled_terms(spark, folder), ["domain"])
    ranks = mid_ranks(totals, "cnt", ["domain"])
    return ranks.select("domain", "cnt", "n", r6(F.col("rank")).alias("rank"))


def threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Every component of every vector against the threshold."""
    rows = read_table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "value"))
    return rows.select("vec_id", "dim", above(F.col("value")).alias("flag"))


def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", hash_part(F.col("doc_id")).alias("part"))


def exact_split(spark: SparkSession, folder: str) -> DataFrame:
    """One fifth of the documents of each source, rounded up, are test documents."""
    return split_exactly(read_table(spark, folder, "documents"), "doc_id", ["source"]).select("doc_id", "source", "part")


def exact_split_plain(spark: SparkSession, folder: str) -> DataFrame:
    """One fifth of all labelled documents, rounded up, are test documents."""
    return split_exactly(read_table(spark, folder, "labels"), "doc_id").select("doc_id", "part")


def lodo_folds(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled(spark, folder).select("domain", "part", "doc_id", "label")
    folds = fold_table(spark, leave_one_out_cells(DOMAINS))
    return docs.join(F.broadcast(folds), ["domain", "part"]).select("fold", "role", "domain", "doc_id", "label")


# Text


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return tokenized(spark, folder).select("doc_id", join_words(F.col("tokens")).alias("clean"))


def clean_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", join_words(clean_tokens(F.col("html"), GENERAL)).alias("clean"))


def clean_chats(spark: SparkSession, folder: str) -> DataFrame:
    return chats(spark, folder).select("conv_id", "turn", join_words(clean_tokens(F.col("text"), GENERAL)).alias("clean"))


def clean_text_domain(spark: SparkSession, folder: str) -> DataFrame:
    lists = {d: PROFILES[p] for d, p in PROFILE.items()}
    tokens = clean_tokens_by_profile(F.col("raw_text"), F.col("domain"), GENERAL, lists)
    return all_documents(spark, folder).select("doc_id", join_words(tokens).alias("clean"))


def doc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.col("tokens")
    return tokenized(spark, folder).select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, "|")).alias("digest")
    )


def doc_terms(spark: SparkSession, folder: str) -> DataFrame:
    docs = tokenized(spark, folder).select("doc_id", long_tokens(F.col("tokens")).alias("tokens"))
    return docs.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", "|")).alias("digest")
    )


def stopword_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = all_documents(spark, folder).select("doc_id", clean_tokens(F.col("raw_text")).alias("tokens"))
    kept = without_stop_words(docs, stop_table(spark, {"general": GENERAL}).select("word"))
    return kept.select("doc_id", join_words(F.col("tokens")).alias("clean"))


def stopword_union(spark: SparkSession, folder: str) -> DataFrame:
    """Words each domain loses to the general list joined with its own, and how often."""
    docs = all_documents(spark, folder).select("domain", clean_tokens(F.col("raw_text")).alias("tokens"))
    lists = {d: sorted(set(GENERAL) | set(PROFILES[p])) for d, p in PROFILE.items()}
    return keep_words(docs, stop_table(spark, lists).withColumnRenamed("profile", "domain"))


# Term features


def bow_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = exploded_terms(document_terms(tokenized(spark, folder)), "doc_id")
    return rows.select("doc_id", "term", F.col("tf").cast("bigint").alias("cnt"))


def vocabulary_topk(spark: SparkSession, folder: str) -> DataFrame:
    totals = term_totals(document_terms(train_only(labelled(spark, folder))))
    return vocabulary(totals, VOCABULARY).select("term", "cnt", "df", "rank")


def idf(spark: SparkSession, folder: str) -> DataFrame:
    train = train_only(labelled_terms(spark, folder))
    n_docs = train.agg(F.count(F.lit(1))).scalar()
    best = vocabulary(term_totals(train), VOCABULARY)
    return best.select("term", "df", r6(smooth_idf(F.col("df"), n_docs)).alias("idf"))


def bow_transform(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_terms(spark, folder)
    vocab = fit_vocabulary(train_only(docs), VOCABULARY)
    rows = vector_terms(count_vectors(docs, vocab), "bow", vocab, "cnt")
    return rows.withColumn("cnt", F.col("cnt").cast("bigint"))


def tfidf_transform(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_terms(spark, folder)
    vocab = fit_vocabulary(train_only(docs), VOCABULARY)
    rows = vector_terms(tfidf_vectors(count_vectors(docs, vocab), vocab), "tfidf", vocab, "weight")
    return rows.withColumn("weight", r6(F.col("weight")))


def word_index(spark: SparkSession, folder: str) -> DataFrame:
    return S.word_index(train_only(labelled(spark, folder)))


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    docs = written(labelled(spark, folder), "documents")
    return S.token_sequences(docs, S.word_index(train_only(docs)))


def token_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return _sequences(spark, folder).select("doc_id", F.array_join("seq", " ").alias("seq"))


def padded_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return S.padded_sequences(_sequences(spark, folder)).select("doc_id", F.array_join("seq", " ").alias("seq"))


def doc_vectors_pooled(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_terms(spark, folder)
    pooled = pool_vectors(docs, word_vectors(spark, folder, docs), 64, bound=VOCABULARY)
    return pooled.select("doc_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", r6(F.col("value")))


def lexicon_polarity(spark: SparkSession, folder: str) -> DataFrame:
    words = lexicon(labelled_terms(spark, folder))
    scored = polarity_of(document_terms(tokenized(spark, folder)), words, bound=LEXICON)
    return scored.select("doc_id", r6(F.col("polarity") + NUDGE).alias("polarity"))


def split_polarity(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_terms(spark, folder)
    scored = polarity_of(docs, lexicon(docs), ("domain", "doc_id", "part"), LEXICON)
    return scored.select("doc_id", "part", r6(F.col("polarity") + NUDGE).alias("polarity"))


# Models and experiments


def _nb_folds(spark: SparkSession, folder: str, cells) -> DataFrame:
    return C.nb_bow(labelled_terms(spark, folder), cells, VOCABULARY)


def _metrics(pred: DataFrame, *by: str) -> DataFrame:
    table = M.metrics_table(pred, by=by)
    return table.select(*by, *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def nb_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_terms(spark, folder)
    model = fit_nb(fold_terms(docs, fold_table(spark, single_cells(DOMAINS))), VOCABULARY)
    return model.select("fold", "term", *[r6(F.col(c)).alias(c) for c in ("lp_0", "lp_1")])


def nb_predict(spark: SparkSession, folder: str) -> DataFrame:
    pred = _nb_folds(spark, folder, single_cells(DOMAINS))
    return pred.select("fold", "doc_id", "y_true", "y_pred", r6(F.col("score")).alias("score"))


def influential_words(spark: SparkSession, folder: str) -> DataFrame:
    """Log odds of the naive Bayes models, each trained on all domains but one."""
    docs = labelled_terms(spark, folder)
    model = fit_nb(fold_terms(docs, fold_table(spark, leave_one_out_cells(DOMAINS))), VOCABULARY)
    return most_influential(log_odds(model), 10).withColumn("weight", r6(F.col("weight")))


def exp_single_nb(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(_nb_folds(spark, folder, single_cells(DOMAINS)), "fold")


def exp_transfer(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(_nb_folds(spark, folder, transfer_cells(all_pairs(DOMAINS))), "fold")


def exp_lodo(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(_nb_folds(spark, folder, leave_one_out_cells(DOMAINS)), "fold")


def model_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid_of(labelled(spark, folder).select("domain", "part"), leave_one_out_cells(DOMAINS))


def predictions_wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = C.predictions_wide(leave_one_out_predictions(spark, folder), MODELS)
    names = {f"{f}_{m}": f"p{i}" for i, (f, m) in enumerate(MODELS)}
    return wide.select("fold", "doc_id", "y_true", *[F.col(old).alias(new) for old, new in names.items()])


def sample_predictions(spark: SparkSession, folder: str) -> DataFrame:
    wide = C.predictions_wide(leave_one_out_predictions(spark, folder), MODELS)
    sample = C.sample_predictions(wide, read_corpus(spark, folder))
    names = {f"{f}_{m}": f"p{i}" for i, (f, m) in enumerate(MODELS)}
    return sample.select("doc_id", "raw_text", "y_true", *[F.col(old).alias(new) for old, new in names.items()])


def metrics_table(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(leave_one_out_predictions(spark, folder), "fold", "feature", "model")


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return M.confusion_matrix(_nb_folds(spark, folder, leave_one_out_cells(DOMAINS)), by=["fold"])


def metrics_per_class(spark: SparkSession, folder: str) -> DataFrame:
    table = M.metrics_per_class(_nb_folds(spark, folder, leave_one_out_cells(DOMAINS)), by=["fold"])
    return table.select(
        "fold", "class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Documents are ranked by their log odds: most probabilities are 1 to all digits."""
    pred = _nb_folds(spark, folder, leave_one_out_cells(DOMAINS)).withColumn("score", F.col("margin"))
    return M.roc_auc(pred, by=["fold"]).withColumn("auc", r6(F.col("auc")))


def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Polarity of the test documents against the class score of naive Bayes, mapped to [-1, 1]."""
    docs = labelled_terms(spark, folder)
    cells = leave_one_out_cells(DOMAINS)
    truth = polarity_of(docs, lexicon(docs), ("domain", "doc_id"), LEXICON)
    pred = C.nb_bow(docs, cells, VOCABULARY).drop("y_true", "y_pred").join(truth, ["domain", "doc_id"])
    pred = pred.select("fold", F.col("polarity").alias("y_true"), (2 * F.col("score") - 1).alias("y_pred"))
    table = M.regression_metrics(pred, by=["fold"])
    return table.select("fold", *[r6(F.col(c)).alias(c) for c in ("mse", "rmse", "mae", "r2")])


def hard_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Vote of both naive Bayes models and the lexicon."""
    pred = leave_one_out_predictions(spark, folder).filter("model != 'Majority'")
    return vote_hard(pred, by=[]).select("fold", "doc_id", "y_true", "y_pred")


def soft_vote(spark: SparkSession, folder: str) -> DataFrame:
    pred = leave_one_out_predictions(spark, folder).filter("model = 'Naive Bayes'")
    return vote_soft(pred).select("fold", "doc_id", "y_true", "y_pred", r6(F.col("score")).alias("score"))


# Rank tests


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return C.scores_long(metrics_table(spark, folder))


def scores_long(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)


def friedman_test(spark: SparkSession, folder: str) -> DataFrame:
    table = R.friedman_test(_scores(spark, folder))
    return table.select("slice", "k", "n", *[r6(F.col(c)).alias(c) for c in ("statistic", "p")], "reject")


def nemenyi_pairs(spark: SparkSession, folder: str) -> DataFrame:
    table = R.nemenyi_pairs(_scores(spark, folder))
    return table.select("slice", "method_a", "method_b", *[r6(F.col(c)).alias(c) for c in ("rank_gap", "q", "p")], "differs")


def nemenyi_matrix(spark: SparkSession, folder: str) -> DataFrame:
    methods = [f"{f} / {m}" for f, m in MODELS]
    matrix = R.nemenyi_matrix(R.nemenyi_pairs(_scores(spark, folder)), methods)
    return matrix.select("slice", "method_a", *[r6(F.col(m)).alias(f"m{i}") for i, m in enumerate(methods)])


QUERIES = {
    f.__name__: f
    for f in (
        load_headered, load_positional, load_reviews, predictions_files, score_file, corpus, filter_labels, map_labels, threshold, train_test_split,
        exact_split, exact_split_plain, encode_terms, term_mid_ranks,
        lodo_folds, clean_text, clean_html, clean_chats, clean_text_domain, doc_tokens, doc_terms,
        stopword_anti_join, stopword_union, bow_counts, vocabulary_topk, idf, bow_transform,
        tfidf_transform, word_index, token_sequences, padded_sequences, doc_vectors_pooled,
        lexicon_polarity, split_polarity, nb_model, nb_predict, influential_words, exp_single_nb,
        exp_transfer, exp_lodo, model_grid, predictions_wide, sample_predictions, metrics_table,
        confusion_matrix, metrics_per_class, roc_auc, regression_metrics, hard_vote, soft_vote,
        scores_long, friedman_test, nemenyi_pairs, nemenyi_matrix,
    )
}
QUERIES["encode_labels"] = encode_roles
