"""The SQL each closed-form query is checked against, composed of common table expressions."""

from __future__ import annotations

from tidemark.functions.stoplists import GENERAL, PROFILES
from tidemark.queries import kernels
from tidemark.queries.inputs import LEXICON, MODELS, NUDGE, PROFILE, VOCABULARY


# The cleaning rules stated anew, so that a fault in the library's own patterns shows.
_TAG = r"<[^>\n]*>"
_DROPPED = r"[^a-z\t-\r\x1c-\x1f\x{85}\p{Z}]+"


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


def _letters(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{_TAG}', '', 'g'), "
        f"'{_DROPPED}', '', 'g')"
    )


def _tokens(text: str, stop: str | None = _list(GENERAL)) -> str:
    keep = f" AND x NOT IN ({stop})" if stop else ""
    return f"list_filter(regexp_split_to_array({_letters(text)}, '[^a-z]+'), lambda x: x <> ''{keep})"


def _r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


_DOMAIN = "'d' || CAST(CAST(substr(source, 4) AS INTEGER) % 5 AS VARCHAR)"
_PART = "CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || '-42'), 1, 8) < '33333333' THEN 'test' ELSE 'train' END"

# Named pieces, in dependency order; a query takes the ones it needs.
_CTE = {
    "alldocs": f"SELECT doc_id, {_DOMAIN} AS domain, {_tokens('text')} AS tokens FROM documents",
    "docs": f"""SELECT d.doc_id, {_DOMAIN} AS domain, {_PART.replace('doc_id', 'd.doc_id')} AS part,
        quality AS label, {_tokens('text')} AS tokens FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "words": "SELECT doc_id, domain, part, label, unnest(tokens) AS term FROM docs",
    "counts": """SELECT doc_id, domain, part, label, term, count(*) AS tf FROM words
        WHERE length(term) >= 2 GROUP BY ALL""",
    "vocab": f"""SELECT *, row_number() OVER (ORDER BY cnt DESC, term) AS rank FROM (
        SELECT term, CAST(sum(tf) AS BIGINT) AS cnt, count(*) AS df FROM counts WHERE part = 'train' GROUP BY term)
        QUALIFY rank <= {VOCABULARY}""",
    "weighed": """SELECT *, ln((1.0 + (SELECT count(*) FROM docs WHERE part = 'train')) / (1.0 + df)) + 1 AS idf
        FROM vocab""",
    "lexicon": f"""SELECT term, ((7 * length(term) + 13 * ascii(term)) % 201 - 100) / 100.0 AS polarity
        FROM vocab WHERE rank <= {LEXICON}""",
    "single": """SELECT domain AS fold, domain, part, part AS role FROM docs GROUP BY ALL""",
    "lodo": """SELECT a.domain AS fold, b.domain, b.part,
        CASE WHEN a.domain = b.domain THEN 'test' ELSE 'train' END AS role
        FROM (SELECT DISTINCT domain FROM docs) a, (SELECT DISTINCT domain, part FROM docs) b""",
    "transfer": """SELECT a.domain || '-' || b.domain AS fold, c.domain, c.part,
        CASE WHEN c.domain = a.domain THEN 'train' ELSE 'test' END AS role
        FROM (SELECT DISTINCT domain FROM docs) a, (SELECT DISTINCT domain FROM docs) b,
        (SELECT DISTINCT domain, part FROM docs) c
        WHERE a.domain <> b.domain AND c.domain IN (a.domain, b.domain)""",
    "fdocs": "SELECT f.fold, f.role, d.* EXCLUDE (tokens) FROM docs d JOIN {folds} f USING (domain, part)",
    "sizes": """SELECT fold, count(*) AS n, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1
        FROM fdocs WHERE role = 'train' GROUP BY fold""",
    "fcounts": """SELECT f.fold, f.role, c.* FROM counts c JOIN {folds} f USING (domain, part)""",
    "fvocab": f"""SELECT *, row_number() OVER (PARTITION BY fold ORDER BY cnt DESC, term) AS rank FROM (
        SELECT fold, term, sum(tf) AS cnt, count(*) AS df, coalesce(sum(tf) FILTER (label = 0), 0) AS c_0,
        coalesce(sum(tf) FILTER (label = 1), 0) AS c_1 FROM fcounts WHERE role = 'train' GROUP BY fold, term)
        QUALIFY rank <= {VOCABULARY}""",
    "model": """SELECT fold, term,
        ln((c_0 + 1.0) / (sum(c_0) OVER (PARTITION BY fold) + count(*) OVER (PARTITION BY fold))) AS lp_0,
        ln((c_1 + 1.0) / (sum(c_1) OVER (PARTITION BY fold) + count(*) OVER (PARTITION BY fold))) AS lp_1
        FROM fvocab""",
    "bow_sums": """SELECT fold, doc_id, sum(tf * lp_0) AS l_0, sum(tf * lp_1) AS l_1
        FROM fcounts JOIN model USING (fold, term) WHERE role = 'test' GROUP BY fold, doc_id""",
    "fweights": """SELECT c.fold, c.role, c.doc_id, c.label, c.term,
        c.tf * (ln((1.0 + s.n) / (1.0 + v.df)) + 1) AS raw
        FROM fcounts c JOIN fvocab v USING (fold, term) JOIN sizes s USING (fold)""",
    "fnormed": """SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY fold, doc_id)) AS w FROM fweights""",
    "tmodel_sums": """SELECT v.fold, v.term, coalesce(sum(w) FILTER (label = 0), 0) AS c_0,
        coalesce(sum(w) FILTER (label = 1), 0) AS c_1
        FROM fvocab v LEFT JOIN (SELECT * FROM fnormed WHERE role = 'train') n USING (fold, term) GROUP BY v.fold, v.term""",
    "tmodel": """SELECT fold, term,
        ln((c_0 + 1.0) / (sum(c_0) OVER (PARTITION BY fold) + count(*) OVER (PARTITION BY fold))) AS lp_0,
        ln((c_1 + 1.0) / (sum(c_1) OVER (PARTITION BY fold) + count(*) OVER (PARTITION BY fold))) AS lp_1
        FROM tmodel_sums""",
    "tfidf_sums": """SELECT fold, doc_id, sum(w * lp_0) AS l_0, sum(w * lp_1) AS l_1
        FROM fnormed JOIN tmodel USING (fold, term) WHERE role = 'test' GROUP BY fold, doc_id""",
}


def _scored(sums: str) -> str:
    """Class scores, decision and probability out of summed log probabilities."""
    return f"""SELECT fold, domain, doc_id, y_true, CASE WHEN round(s_1 - s_0, 9) > 0 THEN 1 ELSE 0 END AS y_pred,
        exp(s_1 - greatest(s_0, s_1)) / (exp(s_0 - greatest(s_0, s_1)) + exp(s_1 - greatest(s_0, s_1))) AS score
        FROM (SELECT d.fold, d.domain, d.doc_id, d.label AS y_true,
            CASE WHEN n_0 > 0 THEN ln(n_0 / n) + coalesce(l_0, 0) ELSE CAST('-infinity' AS DOUBLE) END AS s_0,
            CASE WHEN n_1 > 0 THEN ln(n_1 / n) + coalesce(l_1, 0) ELSE CAST('-infinity' AS DOUBLE) END AS s_1
            FROM fdocs d JOIN sizes USING (fold) LEFT JOIN {sums} USING (fold, doc_id) WHERE d.role = 'test')"""


_CTE["bow_pred"] = _scored("bow_sums")
_CTE["bow_margins"] = "SELECT fold, y_true, round(s_1 - s_0, 9) AS score FROM (" + _scored("bow_sums").split("FROM (", 1)[1]
_CTE["tfidf_pred"] = _scored("tfidf_sums")
_CTE["doc_polarity"] = """SELECT d.doc_id, any_value(d.part) AS part,
    coalesce(sum(tf * polarity) / sum(CASE WHEN polarity IS NOT NULL THEN tf END), 0.0) AS polarity
    FROM docs d LEFT JOIN counts c USING (doc_id) LEFT JOIN lexicon x USING (term) GROUP BY d.doc_id"""
_CTE["lexicon_pred"] = """SELECT fold, domain, doc_id, label AS y_true,
    CASE WHEN round(polarity, 9) > 0 THEN 1 ELSE 0 END AS y_pred, (polarity + 1) / 2 AS score
    FROM fdocs JOIN doc_polarity USING (doc_id) WHERE role = 'test'"""
_CTE["majority_pred"] = """SELECT fold, domain, doc_id, label AS y_true,
    CASE WHEN n_1 > n_0 THEN 1 ELSE 0 END AS y_pred, n_1 / n AS score
    FROM fdocs JOIN sizes USING (fold) WHERE role = 'test'"""
_CTE["pred"] = " UNION ALL ".join(
    f"SELECT *, '{feature}' AS feature, '{model}' AS model FROM {table}"
    for (feature, model), table in zip(MODELS, ("bow_pred", "tfidf_pred", "lexicon_pred", "majority_pred"))
)
_CTE["wide"] = "SELECT fold, domain, doc_id, y_true, " + ", ".join(
    f"max(y_pred) FILTER (feature = '{f}' AND model = '{m}') AS p{i}" for i, (f, m) in enumerate(MODELS)
) + " FROM pred GROUP BY fold, domain, doc_id, y_true"


def _metrics(source: str, by: str) -> str:
    return f"""SELECT {by}, {_r6('accuracy')} AS accuracy, {_r6('precision')} AS precision, {_r6('recall')} AS recall,
        {_r6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1
        FROM (SELECT {by}, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy,
            coalesce(count(*) FILTER (y_true = 1 AND y_pred = 1) / nullif(count(*) FILTER (y_pred = 1), 0), 0.0) AS precision,
            coalesce(count(*) FILTER (y_true = 1 AND y_pred = 1) / nullif(count(*) FILTER (y_true = 1), 0), 0.0) AS recall
            FROM {source} GROUP BY {by})"""


_CTE["metrics"] = _metrics("pred", "fold, feature, model")
_CTE["scores"] = " UNION ALL ".join(
    f"SELECT '{m}' AS slice, fold AS dataset, feature || ' / ' || model AS method, {m} AS score FROM metrics"
    for m in ("accuracy", "precision", "recall", "f1")
)
_CTE["ranked"] = """SELECT *, rank() OVER (PARTITION BY slice, dataset ORDER BY score)
    + (count(*) OVER (PARTITION BY slice, dataset, score) - 1) / 2 AS r,
    count(*) OVER (PARTITION BY slice, dataset, score) AS tied FROM scores"""
_CTE["rank_sums"] = """SELECT slice, method, sum(r) AS rs, count(*) AS n, sum(tied * tied - 1) AS ties
    FROM ranked GROUP BY slice, method"""
_CTE["friedman"] = """SELECT slice, k, n, (12.0 / (n * k * (k + 1)) * ssq - 3 * n * (k + 1))
    / nullif(1 - ties / (n * k * (k * k - 1)), 0) AS statistic FROM (
        SELECT slice, count(*) AS k, max(n) AS n, sum(rs * rs) AS ssq, sum(ties) AS ties FROM rank_sums GROUP BY slice)"""
_CTE["pairs"] = """SELECT *, rank_gap / sqrt(k * (k + 1) / (6 * n)) * sqrt(2.0) AS q FROM (
    SELECT a.slice, a.method AS method_a, b.method AS method_b, a.n, abs(a.rs / a.n - b.rs / b.n) AS rank_gap,
    (SELECT count(*) FROM rank_sums c WHERE c.slice = a.slice) AS k
    FROM rank_sums a JOIN rank_sums b ON a.slice = b.slice)"""
# Normal distribution function on the points z and z - q, by the incomplete gamma series.
_CTE["grid"] = "SELECT DISTINCT q, k, i, -8.0 + i * 0.05 AS z FROM pairs, range(321) t(i)"
_CTE["points"] = "SELECT DISTINCT x FROM (SELECT z AS x FROM grid UNION ALL SELECT z - q FROM grid)"
_CTE["cdf"] = """SELECT x, CASE WHEN x > 8 THEN 1.0 WHEN x < -8 THEN 0.0 WHEN x = 0 THEN 0.5
    ELSE 0.5 + 0.5 * sign(x) * (SELECT sum(exp((0.5 + j) * ln(x * x / 2) - x * x / 2 - lgamma(1.5 + j)))
        FROM range(200) s(j)) END AS phi FROM points"""
_CTE["tails"] = """SELECT q, CASE WHEN q <= 0 THEN 1.0 ELSE least(greatest(1 - sum(
        CASE WHEN i IN (0, 320) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END
        * exp(-z * z / 2) / sqrt(2 * pi()) * pow(a.phi - b.phi, k - 1)) * 0.05 / 3 * any_value(k), 0.0), 1.0) END AS p
    FROM grid JOIN cdf a ON a.x = z JOIN cdf b ON b.x = z - q GROUP BY q"""

_NEEDS = {
    "words": "docs", "counts": "words", "vocab": "counts", "weighed": "docs vocab", "lexicon": "vocab",
    "single": "docs", "lodo": "docs", "transfer": "docs", "fdocs": "docs {folds}", "sizes": "fdocs",
    "fcounts": "counts {folds}", "fvocab": "fcounts", "model": "fvocab", "bow_sums": "fcounts model",
    "fweights": "fcounts fvocab sizes", "fnormed": "fweights", "tmodel_sums": "fvocab fnormed",
    "tmodel": "tmodel_sums", "tfidf_sums": "fnormed tmodel", "bow_pred": "fdocs sizes bow_sums",
    "bow_margins": "fdocs sizes bow_sums",
    "tfidf_pred": "fdocs sizes tfidf_sums", "doc_polarity": "docs counts lexicon",
    "lexicon_pred": "fdocs doc_polarity", "majority_pred": "fdocs sizes",
    "pred": "bow_pred tfidf_pred lexicon_pred majority_pred", "wide": "pred", "metrics": "pred",
    "scores": "metrics", "ranked": "scores", "rank_sums": "ranked", "friedman": "rank_sums",
    "pairs": "rank_sums", "grid": "pairs", "points": "grid", "cdf": "points", "tails": "grid cdf",
}


def _with(needs: str, select: str, folds: str = "lodo") -> str:
    """The select, preceded by the pieces it needs and those they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        name = name.replace("{folds}", folds)
        for other in _NEEDS.get(name, "").split():
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in needs.split():
        add(name)
    pieces = ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n].replace('{folds}', folds)})" for n in wanted)
    return f"WITH {pieces}\n{select}"


def _profile_tokens() -> str:
    cases = " ".join(
        f"WHEN {_DOMAIN} = '{d}' THEN {_tokens('text', _list(set(GENERAL) | set(PROFILES[p])))}"
        for d, p in sorted(PROFILE.items())
    )
    return f"CASE {cases} ELSE {_tokens('text')} END"


def _profile_hits() -> str:
    tests = " OR ".join(
        f"(domain = '{d}' AND word IN ({_list(set(GENERAL) | set(PROFILES[p]))}))" for d, p in sorted(PROFILE.items())
    )
    return f"""SELECT domain, word, count(*) AS hits FROM (
        SELECT {_DOMAIN} AS domain, unnest({_tokens('text', None)}) AS word FROM documents)
        WHERE {tests} GROUP BY domain, word"""


_INDEX = """SELECT term, cnt, row_number() OVER (ORDER BY cnt DESC, first_doc, first_pos) AS idx FROM (
    SELECT term, count(*) AS cnt, min(doc_id) AS first_doc, arg_min(pos, doc_id * 1000000 + pos) AS first_pos
    FROM placed WHERE part = 'train' GROUP BY term) QUALIFY idx <= 9999"""
_PLACED = "SELECT doc_id, part, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM docs"
_SEQUENCES = f"""WITH docs AS MATERIALIZED ({_CTE['docs']}), placed AS MATERIALIZED ({_PLACED}),
    idx AS MATERIALIZED ({_INDEX}),
    seqs AS (SELECT d.doc_id, coalesce(s.seq, []) AS seq FROM docs d LEFT JOIN (
        SELECT doc_id, list(idx ORDER BY pos) AS seq FROM placed JOIN idx USING (term) GROUP BY doc_id) s USING (doc_id))
"""


def _joined(seq: str) -> str:
    return f"array_to_string({seq}, ' ')"


_GRID = ", ".join(
    f"('{f}', '{m}')"
    for f in ("BOW", "TF-IDF", "Word2Vec")
    for m in ("SVM", "Naive Bayes", "Logistic Regression")
    if (f, m) != ("Word2Vec", "Naive Bayes")
)


def _exact(columns: str, table: str, by: str = "") -> str:
    return f"""SELECT {columns}, CASE WHEN row_number() OVER ({by} ORDER BY substr(md5(CAST(doc_id AS VARCHAR) || '-42'), 1, 15))
        <= ceil(count(*) OVER ({by}) / 5) THEN 'test' ELSE 'train' END AS part FROM {table}"""


ORACLES: dict[str, str] = {
    "load_headered": "SELECT doc_id, source, length(text) AS n_chars, md5(text) AS digest FROM documents",
    "load_positional": """SELECT doc_id, quality AS label, md5(text) AS digest
        FROM documents JOIN labels USING (doc_id) WHERE toxic <> 1""",
    "load_reviews": f"""SELECT ['imdb', 'spotify', 'rotten_tomatoes', 'twitter', 'amazon'][1 + CAST(substr({_DOMAIN}, 2) AS INTEGER)] AS domain,
        quality AS label, md5(text) AS digest, 2 * count(*) AS rows, 2 * count(*) AS documents
        FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
    "predictions_files": _with("bow_pred", "SELECT fold, doc_id, y_true, y_pred FROM bow_pred"),
    "score_file": _with("metrics", "SELECT fold AS dataset, feature || ' / ' || model AS method, f1 AS score FROM metrics"),
    "word2vec_train": _with("docs", """SELECT DISTINCT unnest(tokens) AS word, 100 AS size, 1.0::DOUBLE AS norm
        FROM docs WHERE part = 'train'"""),
    "stacked_features": _with("weighed", f"""SELECT doc_id, CAST(copy AS INTEGER) AS copy, term,
        CASE WHEN copy < 3 THEN {_r6('CAST(tf AS DOUBLE)')} ELSE {_r6('w')} END AS value
        FROM (SELECT doc_id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w
            FROM counts JOIN weighed USING (term) WHERE part = 'test'), range(6) c(copy)"""),
    "corpus": f"""SELECT {_DOMAIN} AS domain, doc_id, quality AS label, md5(text) AS digest
        FROM documents JOIN labels USING (doc_id)""",
    "filter_labels": """SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations
        WHERE role IN ('user', 'assistant')""",
    "map_labels": """SELECT doc_id, quality + toxic + 1 AS raw,
        CASE quality + toxic + 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS label FROM labels""",
    "encode_labels": """SELECT conv_id, turn, role, CAST(dense_rank() OVER (ORDER BY role) - 1 AS INTEGER) AS label
        FROM conversations""",
    "threshold": """SELECT vec_id, CAST(dim AS INTEGER) AS dim, CASE WHEN v > 0.5 THEN 1 ELSE 0 END AS flag FROM (
        SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings)""",
    "train_test_split": f"SELECT doc_id, {_PART} AS part FROM documents",
    "exact_split": _exact("doc_id, source", "documents", "PARTITION BY source"),
    "exact_split_plain": _exact("doc_id", "labels"),
    "encode_terms": _with("counts", "SELECT doc_id, term, dense_rank() OVER (ORDER BY term) - 1 AS code FROM counts"),
    "term_mid_ranks": _with("counts", f"""SELECT domain, cnt, count(*) AS n, {_r6('any_value(r) + (count(*) - 1) / 2')} AS rank FROM (
        SELECT domain, cnt, rank() OVER (PARTITION BY domain ORDER BY cnt) AS r FROM (
            SELECT domain, term, CAST(sum(tf) AS BIGINT) AS cnt FROM counts GROUP BY ALL)) GROUP BY domain, cnt"""),
    "lodo_folds": _with("docs lodo", "SELECT fold, role, domain, doc_id, label FROM docs JOIN lodo USING (domain, part)"),
    "clean_text": _with("alldocs", f"SELECT doc_id, {_joined('tokens')} AS clean FROM alldocs"),
    "clean_html": f"SELECT page_id, {_joined(_tokens('html'))} AS clean FROM pages",
    "clean_chats": f"SELECT conv_id, turn, {_joined(_tokens('text'))} AS clean FROM conversations",
    "clean_text_domain": f"SELECT doc_id, {_joined(_profile_tokens())} AS clean FROM documents",
    "doc_tokens": _with("alldocs", "SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, '|')) AS digest FROM alldocs"),
    "doc_terms": _with("alldocs", """SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, '|')) AS digest
        FROM (SELECT doc_id, list_filter(tokens, lambda x: length(x) >= 2) AS t FROM alldocs)"""),
    "stopword_anti_join": _with("alldocs", f"SELECT doc_id, {_joined('tokens')} AS clean FROM alldocs"),
    "stopword_union": _profile_hits(),
    "bow_counts": _with("alldocs", """SELECT doc_id, term, count(*) AS cnt FROM (
        SELECT doc_id, unnest(tokens) AS term FROM alldocs) WHERE length(term) >= 2 GROUP BY doc_id, term"""),
    "vocabulary_topk": _with("vocab", "SELECT term, cnt, df, CAST(rank AS INTEGER) AS rank FROM vocab"),
    "idf": _with("weighed", f"SELECT term, df, {_r6('idf')} AS idf FROM weighed"),
    "bow_transform": _with("vocab", "SELECT doc_id, term, tf AS cnt FROM counts JOIN vocab USING (term)"),
    "tfidf_transform": _with("weighed", f"""SELECT doc_id, term,
        {_r6('tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id))')} AS weight
        FROM counts JOIN weighed USING (term)"""),
    "word_index": f"""WITH docs AS MATERIALIZED ({_CTE['docs']}), placed AS MATERIALIZED ({_PLACED})
        SELECT term, cnt, CAST(idx AS INTEGER) AS idx FROM ({_INDEX})""",
    "token_sequences": _SEQUENCES + f"SELECT doc_id, {_joined('seq')} AS seq FROM seqs",
    "padded_sequences": _SEQUENCES + """SELECT doc_id, array_to_string(list_concat(
        list_transform(range(greatest(100 - len(seq), 0)), lambda x: 0), seq[greatest(len(seq) - 99, 1):]), ' ') AS seq
        FROM seqs""",
    "doc_vectors_pooled": _with("docs counts vocab", f"""SELECT doc_id, dim, {_r6('coalesce(total / hits, 0.0)')} AS value
        FROM (SELECT doc_id, CAST(unnest(range(64)) AS INTEGER) AS dim FROM docs) LEFT JOIN (
            SELECT doc_id, CAST(dim AS INTEGER) AS dim, sum(tf * v) AS total, sum(tf) AS hits FROM counts JOIN (
                SELECT term, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v
                FROM vocab JOIN embeddings ON vec_id = rank - 1) USING (term) GROUP BY ALL) USING (doc_id, dim)"""),
    "lexicon_polarity": _with("alldocs lexicon", f"""SELECT doc_id, {_r6(f'coalesce(avg(polarity), 0.0) + {NUDGE}')} AS polarity
        FROM alldocs d LEFT JOIN (SELECT doc_id, polarity FROM (
            SELECT doc_id, unnest(tokens) AS term FROM alldocs) JOIN lexicon USING (term)) USING (doc_id) GROUP BY doc_id"""),
    "split_polarity": _with("doc_polarity", f"SELECT doc_id, part, {_r6(f'polarity + {NUDGE}')} AS polarity FROM doc_polarity"),
    "nb_model": _with("model", f"SELECT fold, term, {_r6('lp_0')} AS lp_0, {_r6('lp_1')} AS lp_1 FROM model", "single"),
    "nb_predict": _with("bow_pred", f"SELECT fold, doc_id, y_true, y_pred, {_r6('score')} AS score FROM bow_pred", "single"),
    "influential_words": _with("model", f"""SELECT fold, side, CAST(place AS INTEGER) AS place, term, weight FROM (
        SELECT *, row_number() OVER (PARTITION BY fold, side ORDER BY sign * weight DESC, term) AS place FROM (
            SELECT fold, term, {_r6('lp_1 - lp_0')} AS weight FROM model),
            (VALUES ('positive', 1), ('negative', -1)) s(side, sign)) WHERE place <= 10"""),
    "exp_single_nb": _with("bow_pred", _metrics("bow_pred", "fold"), "single"),
    "exp_transfer": _with("bow_pred", _metrics("bow_pred", "fold"), "transfer"),
    "exp_lodo": _with("bow_pred", _metrics("bow_pred", "fold")),
    "model_grid": _with("fdocs", f"""SELECT fold, feature, model, n_train, n_test FROM (
        SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test
        FROM fdocs GROUP BY fold), (VALUES {_GRID}) g(feature, model)"""),
    "predictions_wide": _with("wide", "SELECT fold, doc_id, y_true, p0, p1, p2, p3 FROM wide"),
    "sample_predictions": _with("wide", """SELECT doc_id, text AS raw_text, y_true, p0, p1, p2, p3
        FROM (SELECT * FROM wide ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), fold, doc_id LIMIT 10)
        JOIN documents USING (doc_id)"""),
    "metrics_table": _with("metrics", "SELECT * FROM metrics"),
    "confusion_matrix": _with("bow_pred", """SELECT fold, y_true, count(*) FILTER (y_pred = 0) AS pred_0,
        count(*) FILTER (y_pred = 1) AS pred_1 FROM bow_pred GROUP BY fold, y_true"""),
    "metrics_per_class": _with("bow_pred", f"""SELECT fold, class, {_r6('p')} AS precision, {_r6('r')} AS recall,
        {_r6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END')} AS f1, support FROM (
            SELECT fold, class, count(*) FILTER (y_true = class) AS support,
            coalesce(count(*) FILTER (y_true = class AND y_pred = class) / nullif(count(*) FILTER (y_pred = class), 0), 0.0) AS p,
            coalesce(count(*) FILTER (y_true = class AND y_pred = class) / nullif(count(*) FILTER (y_true = class), 0), 0.0) AS r
            FROM bow_pred, (SELECT y_true AS class FROM bow_pred UNION SELECT y_pred FROM bow_pred)
            GROUP BY fold, class HAVING count(*) FILTER (y_true = class OR y_pred = class) > 0)"""),
    "roc_auc": _with("bow_margins", f"""SELECT fold, {_r6('(sum(r) FILTER (y_true = 1) - p * (p + 1) / 2) / nullif(p * n, 0)')} AS auc FROM (
        SELECT fold, y_true, rank() OVER (PARTITION BY fold ORDER BY score)
            + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS r,
            count(*) FILTER (y_true = 1) OVER (PARTITION BY fold) AS p,
            count(*) FILTER (y_true = 0) OVER (PARTITION BY fold) AS n
        FROM bow_margins) GROUP BY fold, p, n"""),
    "regression_metrics": _with("bow_pred doc_polarity", f"""SELECT fold, {_r6('avg(e * e)')} AS mse,
        {_r6('sqrt(avg(e * e))')} AS rmse, {_r6('avg(abs(e))')} AS mae, {_r6('1 - avg(e * e) / var_pop(t)')} AS r2
        FROM (SELECT fold, polarity AS t, polarity - (2 * score - 1) AS e FROM bow_pred JOIN doc_polarity USING (doc_id))
        GROUP BY fold"""),
    "hard_vote": _with("wide", "SELECT fold, doc_id, y_true, CASE WHEN p0 + p1 + p2 >= 2 THEN 1 ELSE 0 END AS y_pred FROM wide"),
    "soft_vote": _with("pred", f"""SELECT fold, doc_id, y_true, CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS y_pred, {_r6('s')} AS score
        FROM (SELECT fold, doc_id, y_true, round(avg(score), 9) AS s FROM pred
            WHERE model = 'Naive Bayes' GROUP BY fold, doc_id, y_true)"""),
    "scores_long": _with("scores", "SELECT * FROM scores"),
    "friedman_test": _with("friedman", f"""SELECT slice, k, n, {_r6('statistic')} AS statistic, {_r6('p')} AS p, p <= 0.05 AS reject
        FROM (SELECT *, CASE WHEN statistic <= 0 THEN 1.0 WHEN statistic > 0 THEN (
            SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 2 * exp(
                (k - 2) * ln(sqrt(statistic / 2) + i / 400.0) - pow(sqrt(statistic / 2) + i / 400.0, 2)
                - lgamma((k - 1) / 2.0))) / 1200
            FROM range(4001) s(i)) END AS p FROM friedman)"""),
    "nemenyi_pairs": _with("pairs tails", f"""SELECT slice, method_a, method_b, {_r6('rank_gap')} AS rank_gap, {_r6('q')} AS q,
        {_r6('p')} AS p, p <= 0.05 AS differs FROM pairs JOIN tails USING (q)"""),
    "nemenyi_matrix": _with("pairs tails", "SELECT slice, method_a, " + ", ".join(
        f"{_r6(f"max(p) FILTER (method_b = '{f} / {m}')")} AS m{i}" for i, (f, m) in enumerate(MODELS)
    ) + " FROM pairs JOIN tails USING (q) GROUP BY slice, method_a"),
    "grid_certificates": _with("fdocs", f"""SELECT fold, feature, model, CASE model WHEN 'SVM' THEN 5 ELSE 1 END::BIGINT AS n_models,
        count(*) AS n_train, CAST(sum(label) AS BIGINT) AS n_positive, TRUE AS optimal
        FROM fdocs, (VALUES {_GRID}) g(feature, model) WHERE role = 'train' AND model <> 'Naive Bayes' GROUP BY fold, feature, model"""),
    "svm_certificates": _with("fdocs", """SELECT fold, feature, 5::BIGINT AS n_models, count(*) AS n_train,
        CAST(sum(label) AS BIGINT) AS n_positive, TRUE AS optimal
        FROM fdocs, (VALUES ('BOW'), ('TF-IDF'), ('Word2Vec')) g(feature) WHERE role = 'train' GROUP BY fold, feature"""),
    "grid_bayes": _with("pred", f"""SELECT fold, doc_id, feature, y_true, y_pred, {_r6('score')} AS score
        FROM pred WHERE model = 'Naive Bayes'"""),
}


def _composed(needs: str, pieces: str, select: str) -> str:
    """The select, preceded by named pieces and by further ones of its own."""
    return ",\n".join(filter(None, [_with(needs, "").rstrip(), pieces])) + f"\n{select}"


ORACLES |= kernels.oracles(_composed)
