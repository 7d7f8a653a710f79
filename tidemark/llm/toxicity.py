"""Score texts by their significant toxic passages.

1. Words and their leading letters are features. From labelled documents, each feature gets the
   log-odds of toxic against clean under a Dirichlet prior that follows its share of all documents;
   the lower end of its confidence range counts, so that thin evidence counts for nothing.
2. A word scores its best feature (divided by k when it occurs for the k-th time, as repeats are
   weak evidence), or a small cost when it has none. One linear scan finds every
   maximal-scoring segment of a text.
3. Extreme-value statistics tell how many segments of a given score a clean text of that length has
   by chance: ``E = n * exp(-decay * score)``, where ``decay`` solves the moment equation of the word
   scores in clean text. The r best segments of a text are weighed together by a Poisson tail, and
   the smallest tail probability becomes the score: 0.5 at ``LEVEL``.

The labelled rows are the only sample: at most about ``LABELLED_ROWS``, chosen by hash. The prior is
counted over all documents, and every text is scored whole.

Defined results: a null or empty text, or one without a scoring word, has the lowest score; without
labelled rows of both classes no word scores; null labels and labels without document are ignored;
rows with equal ``doc_id`` are scored separately.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)

LABELLED_ROWS = 100_000
PRIOR_WEIGHT, PRIOR_FLOOR = 10.0, 0.25
DEVIATIONS = 2.0
LEAST = 1.0  # features below are no evidence on their own, but would add up in long texts
COST = 0.25
FORMS = 4
LEVEL = 0.005
# Entries a task keeps at most; they bound memory and change no result.
MEMO, HELD_FEATURES = 100_000, 200_000


def features(word: str) -> list[str]:
    """The word itself and its leading letters, which inflected forms share."""
    return [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) >= n]


def heads(names) -> frozenset[str]:
    """What a word begins with if one of the features ``names`` may be its own."""
    return frozenset(n[: PREFIXES[0]] for n in names)


@dataclass
class Model:
    """Positive feature scores and the decay of segment scores in clean text."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    rate: float = 1.0

    def __post_init__(self):
        self.memo: dict[str, float] = {}
        # A word can only score if a scoring feature begins as it does.
        self.heads = heads(self.scores)

    def __getstate__(self):
        return {"scores": self.scores, "decay": self.decay, "rate": self.rate}

    def __setstate__(self, state):
        self.__init__(**state)

    def word_score(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = max((self.scores.get(f, 0.0) for f in features(word)), default=0.0)
            self.memo[word] = found
        return found

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Every maximal-scoring segment (first word, end, score), in one pass."""
        memo, score_of = self.memo, self.word_score
        # (first, end, total before, total after); earlier ones with a smaller total before are
        # reached by the link, so that each candidate is looked at a bounded number of times.
        stack: list[tuple[int, int, float, float, int]] = []
        seen: dict[str, int] = {}
        total, last, begins, n = 0.0, 0, self.heads, PREFIXES[0]
        for i, word in [(i, w) for i, w in enumerate(words) if w[:n] in begins]:
            score = memo.get(word)
            if score is None:
                score = score_of(word)
            if score <= 0:
                continue
            # The k-th occurrence of a word is one k-th of new evidence.
            seen[word] = seen.get(word, 0) + 1
            score /= seen[word]
            total -= COST * (i - last)
            first, before, after = i, total, total + score
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= before:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= after:
                    break
                first, before = stack[j][0], stack[j][2]
                del stack[j:]
            stack.append((first, i + 1, before, after, j))
            total, last = after, i + 1
        return [(a, b, after - before) for a, b, before, after, _ in stack]

    def expected(self, score: float, words: int) -> float:
        return words * self.rate * math.exp(-self.decay * score)

    def tail(self, segments: list[tuple[int, int, float]], words: int) -> float:
        """Smallest probability that clean text has r segments as good as the r best."""
        best = 1.0
        for r, (_, _, score) in enumerate(sorted(segments, key=lambda s: -s[2]), 1):
            mean = self.expected(score, words)
            if mean <= 0:
                return 0.0
            # No tail from a count below the median is under one half.
            if best > 0.5 or r > mean - math.log(2):
                best = min(best, poisson_tail(r, mean))
        return best


def poisson_tail(r: int, mean: float) -> float:
    """P(N >= r) for a Poisson mean, summed away from the mean: from the term of r upwards, or as the
    complement of the terms below r downwards. Either way terms fall, and none is lost in a difference."""
    if r <= 0:
        return 1.0
    upwards = r > mean
    k = r if upwards else r - 1
    term, total = math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)), 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        if upwards:
            k += 1
            term *= mean / k
        else:
            term *= k / mean
            k -= 1
    return min(1.0, total) if upwards else max(0.0, 1.0 - total)


def count_features(texts: DataFrame) -> DataFrame:
    """(feature, toxic, clean, forms): labelled documents of each class that hold a feature.

    ``forms`` has a bit for the hash of each word that carries the feature in a toxic document.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, forms = (Counter(), Counter()), Counter()

        def counted() -> pd.DataFrame:
            names = list(held[0].keys() | held[1].keys())
            out = pd.DataFrame({
                "feature": names, "toxic": [held[1][n] for n in names], "clean": [held[0][n] for n in names],
                "forms": [forms[n] for n in names],
            })
            for counter in (*held, forms):
                counter.clear()
            return out

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                words = set(WORD.findall(text.lower()))
                held[label].update({f for w in words for f in features(w)})
                if label:
                    for word in words:
                        bit = 1 << (zlib.crc32(word.encode()) % 62)
                        for name in features(word):
                            forms[name] |= bit
                if len(held[0]) + len(held[1]) > HELD_FEATURES:
                    yield counted()
        # A task without labelled rows yields nothing: a frame without rows has no column types.
        if held[0] or held[1]:
            yield counted()

    each = texts.mapInPandas(counts, "feature string, toxic long, clean long, forms long")
    return each.groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("forms").alias("forms")
    )


def count_corpus(docs: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(feature, documents): all documents that hold each wanted feature."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, list[str]] = {}
        begins, n = heads(wanted), PREFIXES[0]
        for batch in batches:
            held = Counter()
            for text in batch["text"]:
                own = set()
                for word in {w for w in WORD.findall(text.lower()) if w[:n] in begins}:
                    found = memo.get(word)
                    if found is None:
                        if len(memo) > MEMO:
                            memo.clear()
                        found = memo[word] = [f for f in features(word) if f in wanted]
                    own.update(found)
                held.update(own)
            held[""] = len(batch)
            yield pd.DataFrame({"feature": list(held.keys()), "documents": list(held.values())})

    each = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(counts, "feature string, documents long")
    return each.groupBy("feature").agg(F.sum("documents").alias("documents"))


def lower_log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int, prior: float) -> float:
    """Lower confidence limit of the log-odds of a feature, toxic against clean."""
    a, b = toxic + prior, clean + prior
    ratio = math.log(a / max(n_toxic - toxic + prior, prior)) - math.log(b / max(n_clean - clean + prior, prior))
    return ratio - DEVIATIONS * math.sqrt(1 / a + 1 / b)


def decay_of(rates: list[tuple[float, float]]) -> float:
    """The positive root x of ``sum(rate * exp(x * score)) + rest * exp(-x * COST) = 1``."""
    rest = 1 - sum(r for r, _ in rates)

    def excess(x: float) -> float:
        return sum(r * math.exp(min(700.0, x * s)) for r, s in rates) + rest * math.exp(-x * COST) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, label 0/1); the caller leaves out what must stay unseen."""
    known = labels.filter("label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    found = known.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / max(found, 1)))
    # At most about ``rows`` keys: a broadcast of bounded size, so that no text is shuffled.
    chosen = F.broadcast(known.filter(share))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Equal texts are one piece of evidence, however often they were copied.
    spaces = F.length("text") - F.length(F.translate("text", " ", "")) + 1
    kept = Scratch(docs.sparkSession).write(
        texts.join(chosen, "doc_id").groupBy(F.xxhash64("text"), F.length("text"), "label").agg(
            F.min("doc_id").alias("doc_id"), F.first(spaces).alias("words")
        ).select("doc_id", "label", "words"),
        "labelled",
    )
    train = texts.join(F.broadcast(kept), "doc_id").select("text", "label")
    counted = count_features(train)
    totals = {r["label"]: r for r in kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("words").alias("words")).collect()}
    sizes = {label: totals[label]["n"] if label in totals else 0 for label in (0, 1)}
    if not sizes[0] or not sizes[1]:
        return Model()
    # At most 1 / floor as many features as labelled toxic words come to the driver, nearly all of
    # them by far too rare to pass; only those that can pass are counted over the corpus.
    a, b = F.col("toxic") + PRIOR_FLOOR, F.col("clean") + PRIOR_FLOOR
    ratio = F.log(a / (sizes[1] - F.col("toxic") + PRIOR_FLOOR)) - F.log(b / (sizes[0] - F.col("clean") + PRIOR_FLOOR))
    stem = F.endswith("feature", F.lit("*"))
    # Leading letters tell more than a word only when several words share them.
    strong = counted.filter((F.col("toxic") >= 3) & (~stem | (F.bit_count("forms") >= FORMS))).filter(ratio - DEVIATIONS * F.sqrt(1 / a + 1 / b) > 0)
    evidence = {r["feature"]: (r["toxic"], r["clean"]) for r in strong.collect()}
    spread = {r["feature"]: r["documents"] for r in count_corpus(docs, frozenset(evidence)).collect()}
    everything = max(spread.get("", 0), 1)
    scores, rates = {}, []
    words = max(totals[0]["words"], 1.0)
    for name, (toxic, clean) in evidence.items():
        prior = PRIOR_FLOOR + PRIOR_WEIGHT * spread.get(name, 0) / everything
        score = lower_log_odds(toxic, clean, sizes[1], sizes[0], prior)
        if score >= LEAST:
            scores[name] = score
            rates.append(((clean + prior) / (sizes[0] * words), score))
    if not scores:
        return Model()
    decay = decay_of(rates)
    return Model(scores, decay, decay * sum(r * s for r, s in rates))


RESULT = "score double, segments array<struct<first:int,stop:int,score:double,expected:double>>"


def toxicity(model: Model) -> Column:
    """Struct of the score of column ``text`` and its significant passages (in words)."""

    @F.pandas_udf(RESULT)
    def scored(texts: pd.Series) -> pd.DataFrame:
        scores, passages = [], []
        for text in texts:
            words = WORD.findall(text.lower())
            found = model.segments(words)
            tail = model.tail(found, len(words)) if found else 1.0
            scores.append(LEVEL / (LEVEL + tail))
            rows = [(a, b, s, model.expected(s, len(words))) for a, b, s in found]
            passages.append([dict(zip(("first", "stop", "score", "expected"), r)) for r in rows if r[3] <= LEVEL])
        return pd.DataFrame({"score": scores, "segments": passages})

    # Evaluated once per row: a filter on the result must not run it again.
    return scored.asNondeterministic()(F.coalesce("text", F.lit("")))


def score_documents(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    return docs.withColumn(name, toxicity(model))
