"""Mean word vectors per document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.terms import document_keys, exploded_terms
from tidemark.session import drop, written, written_parts

# Vectors that every task holds: those of the most frequent words.
HELD_VECTORS = 100_000
# Term rows that are multiplied at a time.
CELLS = 20_000
# Bytes of shuffled vectors of a round; rounds at most: each shuffles the table of vectors again.
ROUND_BYTES, MOST_ROUNDS = 400_000_000, 8


def _summed(words: pa.Array, matrix: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, the sum of the vectors of each and their number: a word with several vectors counts with all of them."""
    own = words.dictionary_encode()
    at, known = np.asarray(own.indices), len(own.dictionary)
    if known == len(words):
        return words, matrix, np.ones(known)
    sums = np.zeros((known, matrix.shape[1]))
    np.add.at(sums, at, matrix)
    return own.dictionary, sums, np.bincount(at, minlength=known).astype(float)


def pool_by_set(rows: DataFrame, vectors: DataFrame, frequent: DataFrame, size: int, by: str) -> DataFrame:
    """``rows`` (by, terms, ...) with ``vector``, the mean over the occurrences of words known to the row's set.

    ``vectors`` is (by, word, vector); ``frequent`` (by, word) names at most ``HELD_VECTORS`` of them, which every task
    holds and adds up inside the row. Only occurrences of other words meet their vectors by a
    shuffle, and each of those words holds a small share of the rows.
    """
    parts, first = pooled_parts(rows, vectors, frequent, size, by)
    if len(parts) == 1:
        parts[0].scratch_paths = first.scratch_paths
        return parts[0]
    out = written_parts(parts, "pooled-rounds")
    drop(first)
    return out


def pooled_parts(
    rows: DataFrame, vectors: DataFrame, frequent: DataFrame, size: int, by: str
) -> tuple[list[DataFrame], DataFrame]:
    """``pool_by_set`` in rounds of rows, to be written one after the other, as all shuffled vectors together can take
    many times the room of the texts; and the table that they read, which can be dropped afterwards."""
    spark = rows.sparkSession
    # A missing component adds nothing.
    kind = vectors.schema["vector"].dataType.elementType  # kept: a wider one doubles what is held and shuffled
    filled = F.array(*[F.coalesce(F.get("vector", F.lit(i)), F.lit(0).cast(kind)) for i in range(size)])
    vectors = vectors.filter(F.col("vector").isNotNull()).select(by, "word", filled.alias("vector"))
    table = vectors.join(F.broadcast(frequent), [by, "word"], "left_semi").select(by, "word", "vector").toArrow()
    sets = table.column(by).to_numpy(zero_copy_only=False)
    matrix = np.asarray(table.column("vector").combine_chunks().flatten()).reshape(-1, size)
    held = {s: _summed(table.column("word").filter(pa.array(sets == s)).combine_chunks(), matrix[sets == s]) for s in set(sets)}
    shared = spark.sparkContext.broadcast(held)
    others = [c for c in rows.columns if c != "terms"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            lists = batch.column("terms")
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            sizes = np.where(np.asarray(lists.is_valid().to_numpy(zero_copy_only=False)), sizes, 0)
            flat = lists.flatten()
            term, tf = flat.field("term").dictionary_encode(), np.asarray(flat.field("tf")).astype(float)
            words, code = term.dictionary, np.asarray(term.indices.fill_null(0)).astype(np.int64)
            doc, named = np.repeat(np.arange(len(sizes)), sizes), batch.column(by).to_pylist()
            place, whose = np.full(len(tf), -1), np.array([str(n) for n in named])
            sums, hits = np.zeros((len(sizes), size)), np.zeros(len(sizes))
            for name in set(named) & set(shared.value):
                entries, values, copies = shared.value[name]
                at = np.asarray(pc.index_in(words, value_set=entries).fill_null(-1)).astype(np.int64)
                mine = np.flatnonzero((whose == str(name))[doc])
                place[mine] = at[code[mine]]
                taken = mine[place[mine] >= 0]
                for start in range(0, len(taken), CELLS):
                    some = taken[start : start + CELLS]
                    borders = np.flatnonzero(np.diff(doc[some], prepend=-1))
                    found = values[place[some]] * tf[some, None]
                    sums[doc[some][borders]] += np.add.reduceat(found, borders, axis=0)
                hits += np.bincount(doc[taken], weights=tf[taken] * copies[place[taken]], minlength=len(sizes))
            left = np.flatnonzero(place < 0)
            offsets = pa.array(np.searchsorted(doc[left], np.arange(len(sizes) + 1)).astype(np.int32))
            rest = flat.take(pa.array(left))
            columns = [
                pa.array(number + np.arange(len(sizes))), pa.array(hits),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * size), pa.array(sums.ravel())),
                pa.ListArray.from_arrays(offsets, rest.field("term")), pa.ListArray.from_arrays(offsets, pc.cast(rest.field("tf"), pa.int64())),
            ]
            number += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], *columns], names=[*others, "__id", "__hits", "__sums", "__terms", "__tf"]
            )

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "terms")
    slim = rows.select(*others, F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].cast("bigint").alias("tf"))).alias("terms"))
    schema = f"{kinds}, __id bigint, __hits double, __sums array<double>, __terms array<string>, __tf array<bigint>"
    first = written(slim.mapInArrow(add, schema), "pooled")
    shared.destroy()
    occurrences = first.agg(F.coalesce(F.sum(F.size("__terms").cast("bigint")), F.lit(0))).first()[0]
    rounds = min(MOST_ROUNDS, max(1, -(-occurrences * 4 * size // ROUND_BYTES)))

    def part(turn: int) -> DataFrame:
        mine = first.filter(F.pmod(F.xxhash64("__id"), F.lit(rounds)) == turn) if rounds > 1 else first
        rest = mine.select("__id", by, F.inline(F.arrays_zip(F.col("__terms").alias("word"), F.col("__tf").alias("tf"))))
        met = rest.join(vectors.select(by, "word", "vector"), [by, "word"]).select("__id", "tf", "vector").repartition("__id")
        parts = [F.sum(F.col("tf") * F.get("vector", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(size)]
        more = met.groupBy("__id").agg(F.sum("tf").cast("double").alias("__more"), *parts)
        more = more.select("__id", "__more", F.array(*[f"s{i}" for i in range(size)]).alias("__added"))
        both = mine.drop("__terms", "__tf").join(more, "__id", "left")
        hits = F.col("__hits") + F.coalesce("__more", F.lit(0.0))
        total = F.when(F.col("__more").isNull(), F.col("__sums")).otherwise(F.zip_with("__sums", "__added", lambda a, b: a + b))
        both = both.withColumn("__n", hits).withColumn("__total", total)
        mean = F.when(F.col("__n") > 0, F.transform("__total", lambda x: x / F.col("__n"))).otherwise(F.col("__sums"))
        return both.select(*others, mean.alias("vector"))

    return [part(turn) for turn in range(rounds)], first


def most_frequent(terms: DataFrame, *by: str, limit: int = HELD_VECTORS) -> DataFrame:
    """(by, word): the most frequent of the words counted in ``terms`` (by, term, cnt)."""
    best = terms.orderBy(F.desc("cnt"), *by, "term").limit(limit)
    return best.select(*by, F.col("term").alias("word"))


def pool_vectors(
    docs: DataFrame,
    vectors: DataFrame,
    size: int,
    keep: Sequence[str] | None = None,
    bound: int | None = None,
) -> DataFrame:
    """(keep, vector): mean vector over the occurrences of known words, zeros without any.

    By default ``keep`` is the document's domain and number, which name it together.
    ``docs`` carries ``terms``; ``vectors`` is (word, vector) with one row per word. A word
    table is as large as the training vocabulary: at most ``HELD_VECTORS`` of the most frequent
    words are held by every task (see ``pool_by_set``). ``bound`` is its row count where that is known.
    """
    keep = keep or document_keys(docs)
    one = F.lit("").alias("__set")
    counted = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf")))
    rows = docs.select(*keep, counted.alias("terms")).groupBy(*keep).agg(F.flatten(F.collect_list("terms")).alias("terms"))
    rows = rows.withColumn("__set", one)
    named = vectors.select(one, "word", "vector")
    if bound is not None and bound <= HELD_VECTORS:
        frequent = named.select("__set", "word")
    else:
        counts = exploded_terms(docs, *keep).groupBy("term").agg(F.count(F.lit(1)).alias("cnt")).withColumn("__set", one)
        frequent = most_frequent(counts, "__set")
    pooled = pool_by_set(rows, named, frequent, size, "__set")
    out = pooled.select(*keep, "vector")
    out.scratch_paths = pooled.scratch_paths
    return out
