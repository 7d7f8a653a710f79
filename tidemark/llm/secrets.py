"""Find credentials and tell live-looking ones from copied examples by who owns them.

Every candidate value is hashed. Over the whole corpus, the distinct owners and repositories that
hold a hash are counted: a value in the hands of one owner looks live, one that several owners share
is a copied example. Patterns with a fixed shape are reported wherever they match; opaque random
strings, which have none, are reported only where exactly one owner has them.

Defined results: a null or empty text has no spans; a null owner or repository counts as one of its
own; rows with equal ``doc_id`` are scanned separately; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PREFIXED = re.compile(r"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-|npm_)[A-Za-z0-9_-]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

# In the order in which spans with equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "jwt", "prefixed", "opaque")
BASE = 3
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_OPAQUE, MIN_BITS = 8, 16, 32, 20, 3.5
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SPANS = "uid long, doc_id long, owner string, repository string, spans array<struct<kind:int,start:int,stop:int,hash:long>>"


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def value_hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, hash of the value), every kind leftmost and without overlaps."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_VALUE:
                found.append((0, m.start(), m.end(), value_hash(m[2])))
    base_runs = []
    for run in RUN.finditer(text):  # access keys and hex strings lie inside such runs
        whole, at = run[0], run.start()
        for m in ACCESS.finditer(whole):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((1, at + m.start(), at + m.end(), value_hash(m[0])))
        if len(whole) >= MIN_HEX:
            for m in HEX.finditer(whole):
                if m.end() - m.start() >= MIN_HEX:
                    found.append((2, at + m.start(), at + m.end(), value_hash(m[0])))
        base_runs.append((at, run.end(), whole))
    if "-----BEGIN" in text:
        found += [(3, m.start(), m.end(), value_hash(text[m.start() : m.end() + 200])) for m in PEM.finditer(text)]
    if "eyJ" in text:
        found += [(4, m.start(), m.end(), value_hash(m[0])) for m in JWT.finditer(text)]
    if "_" in text or "-" in text:
        found += [(5, m.start(), m.end(), value_hash(m[0])) for m in PREFIXED.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    for start, stop, whole in base_runs:
        if stop - start < MIN_OPAQUE or any(s < stop and start < e for s, e in taken):
            continue
        if any(c.isdigit() for c in whole) and any(c.isalpha() for c in whole) and bits_per_character(whole) >= MIN_BITS:
            found.append((6, start, stop, value_hash(whole)))
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, owner, repository, text) with each row's candidates and a row id."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "stop", "hash"), c)) for c in candidates(t)] for t in batch["text"]]
            yield pd.DataFrame({
                "uid": range(n, n + len(batch)), "doc_id": batch["doc_id"], "owner": batch["owner"],
                "repository": batch["repository"], "spans": spans,
            })
            n += len(batch)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "owner", "repository", F.coalesce("text", F.lit("")).alias("text"))
    # pandas would turn a null key into a float; it travels as a value of its own.
    null_key = -(1 << 63)
    keyed = plain.withColumn("doc_id", F.coalesce("doc_id", F.lit(null_key)))
    return keyed.mapInPandas(rows, SPANS).withColumn("doc_id", F.when(F.col("doc_id") != null_key, F.col("doc_id")))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, owners, repositories): distinct holders of each candidate value."""
    held = scanned.select("owner", "repository", F.explode("spans.hash").alias("hash"))
    each = held.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("one").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def classified(scanned: DataFrame, live_owners: int = 1) -> DataFrame:
    """One row per row of ``scanned``: its spans (kind, start, stop, owners, repositories, live).

    Opaque candidates of more than ``live_owners`` owners are left out; all other kinds stay.
    """
    spans = scanned.select("uid", F.explode("spans").alias("s")).select("uid", "s.*")
    judged = spans.join(ownership(scanned), "hash").withColumn("live", F.col("owners") <= live_owners)
    kept = judged.filter(F.col("live") | (F.col("kind") != KINDS.index("opaque")))
    grouped = kept.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "owners", "repositories", "live"))).alias("found")
    )
    return scanned.select("uid", "doc_id").join(grouped, "uid", "left").select(
        "uid", "doc_id", F.coalesce("found", F.array().cast(grouped.schema["found"].dataType)).alias("found")
    )


def listing(found: Column) -> Column:
    """``kind:start:end`` of spans, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def find_secrets(docs: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """Classified spans of ``docs``; repositories are named by the columns ``repository``."""
    name = F.to_json(F.struct(*[F.col(c) for c in repository]))
    scanned = scan(docs.select("doc_id", F.col(owner).cast("string").alias("owner"), name.alias("repository"), "text"))
    return classified(Scratch(docs.sparkSession).write(scanned, "secret-spans"))

