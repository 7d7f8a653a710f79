"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, crosspoly, decontaminate, dialogues, jaccard, licenses, mixing, packing, records, rollups, secrets, suffixes, toxicity
from tidemark.llm.common import SPACED_WORD, Scratch, table
from tidemark.session import scratch_path


def op4_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken per document, sorted by the position of the first visit."""
    placed = mixing.mix(spark, table(spark, folder, "documents"))
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda total, v: total + v["words"])
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"),
        F.round(F.get("visits", F.lit(0))["position"], 6).alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op5_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the token records, read back from the shards."""
    return records.encoded_records(spark, table(spark, folder, "documents"))


def op7_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark passages: one row per document and item, its best match."""
    found = decontaminate.benchmark_matches(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return found.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.min("edits").alias("fewest_edits"),
        F.min("start").alias("start"), F.max("stop").alias("stop"),
    )


def op8_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    """Credential spans; a source is an owner, its documents of one language a repository."""
    found = secrets.find_secrets(table(spark, folder, "documents"), "source", ["source", "lang"])

    def count(kind: int):
        # The kind is bound here: a second parameter of the inner function would be the element's place.
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[: secrets.BASE])]
    base = F.filter("found", lambda s: s["kind"] < secrets.BASE)
    return found.select(
        "doc_id", *counts,
        F.sha2(secrets.listing(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listing(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that repeat 50-byte strings of smaller documents, removed from every document."""
    found = suffixes.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_license_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Exact phrases and fuzzy notices of every document; the score is the best match's share of unedited text."""
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["exact"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    quality = F.transform("spans", lambda s: 1 - s["edits"] / s["length"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first"]).alias("first_word"), F.array_max(base["first"]).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(quality), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def held_out():
    """A fifth of all documents, whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, folder, "labels").filter(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs, labels)


def op3_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(spark, folder, docs))
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.segments").alias("n_segments"),
    )


def op6_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return crosspoly.nearest(vectors, F.col("vec_id") % 50 == 0)


# Two versions of a word tokenizer; the first was shipped with a fault, counting marks as words.
MARKED, WORDS, PIECES = SPACED_WORD, r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"


def op9_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after four batches: insert all, insert a second tokenizer, revise the first, drop copies."""
    docs = table(spark, folder, "documents")
    counts = rollups.pattern_counts(F.col("text"), {"marked": MARKED, "words-1": WORDS, "pieces-2": PIECES})
    content = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content")
    counted = Scratch(spark).write(docs.select("doc_id", "source", "lang", content, *counts), "token-counts")
    rollup = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    first = counted.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("marked").alias("tokens"))
    rollup.commit("1-insert", rollups.inserted(first))
    rollup.commit("2-version", rollups.inserted(rollups.by_tokenizer(counted, ["pieces-2"])))
    fixed = counted.select(
        "source", "lang", F.lit("words-1").alias("tokenizer"),
        F.col("marked").alias("old_tokens"), F.col("words-1").alias("new_tokens"),
    )
    rollup.commit("3-revise", rollups.revised(fixed))
    rollup.compact()
    out, back = rollups.distinct_only(counted, "content", ["words-1", "pieces-2"])
    rollup.commit("4-copies", out.unionByName(back))
    rollup.commit("3-revise", rollups.revised(fixed))  # delivered twice, counted once
    return rollup.totals()


def op10_jaccard_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every document's shingle set and the smallest document its links reach."""
    groups = jaccard.jaccard_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, records.default_tokenizer(), end_id=0)


def damaged(messages: DataFrame) -> DataFrame:
    """Messages with a twentieth each dropped, emptied, cut, repeated and given the role user, by a hash."""
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    act = F.crc32(F.concat(blank["conv_id"], F.lit(":"), blank["turn"]).cast("binary")) % 20
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = messages.select("conv_id", "turn", blank["role"].alias("role"), blank["text"].alias("text"), act.alias("act")).filter("act <> 0")
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("act") == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")


def op12_dialogue_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, least cost, audit and digest of every conversation, repaired after a known damage."""
    messages = table(spark, folder, "conversations")
    return dialogues.complete(dialogues.repair(damaged(messages)), messages)


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, with corpus-wide link counts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment.align(docs, *alignment.default_paths())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_notices": op2_license_notices,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op5_token_records": op5_token_records,
    "op6_cross_polytope": op6_cross_polytope,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_secret_ownership": op8_secret_ownership,
    "op9_token_rollup": op9_token_rollup,
    "op10_jaccard_groups": op10_jaccard_groups,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_token_alignment": op13_token_alignment,
}
