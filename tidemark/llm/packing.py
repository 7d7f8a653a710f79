"""Pack documents into training sequences: best fit planned on the histogram of lengths.

1. Every document is encoded and closed by an end id; only what is longer than a sequence is cut,
   into pieces of a whole sequence and a rest.
2. The plan needs no document: lengths are numbers up to the capacity, so a histogram of at most that
   many rows says all. From the longest length down, all pieces of a length go at once into the
   sequences with the least room that holds them, as many per sequence as fit, and into new
   sequences when none is left: what best-fit decreasing does piece by piece. Sequences with one
   history are one group; a length splits at most two groups, so the plan is bounded by the capacity.
3. The plan reserves ranges of ranks within a length. Pieces are ranked within their length, in
   buckets whose number follows the length's count, and take the slot of their rank by a join.

Defined results: a null or empty text is one piece, the end id; rows with equal ``doc_id`` are packed
separately; a null ``doc_id`` is kept; pieces of one length are interchangeable, so which of
them lies where is not defined beyond that; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, release
from tidemark.llm.encoding import ENCODE_BYTES, encoder, text_slices
from tidemark.session import small_table

CAPACITY = 2048
# Pieces that one task ranks.
RANKED_ROWS = 50_000


class Slots(NamedTuple):
    """Places of the pieces of a length with ranks ``first`` to ``stop``: ``each`` a sequence, from ``offset`` on."""

    length: int
    first: int
    stop: int
    sequence: int
    each: int
    offset: int


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encoded pieces of every document of ``docs`` (doc_id, text), with a number for each piece."""
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in text_slices(batch.column("text"), ENCODE_BYTES):
                ids, bounds = coder.encode(texts)
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False)
                bounds = bounds + np.arange(len(bounds))
                counts = np.diff(bounds)
                parts = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), parts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, counts[owner] - start)
                data, begin = memoryview(ids).cast("B"), bounds[owner] + start
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(len(owner))), batch.column("doc_id").slice(at, len(counts)).take(pa.array(owner)),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                ], schema=schema)
                row += len(owner)
        release()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best fit of ``counts`` pieces per length, longest first, all pieces of a length at once."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences) of each group
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def place(free: int, sequence: int, n: int, each: int) -> None:
            nonlocal rank, left
            slots.append(Slots(length, rank, rank + n * each, sequence, each, capacity - free))
            room.setdefault(free - each * length, []).append((sequence, n))
            rank, left = rank + n * each, left - n * each

        def fill(free: int, sequence: int, n: int) -> None:
            """Fill a group as far as pieces last: whole sequences first, then one in part."""
            each = free // length
            whole = min(n, left // each)
            if whole:
                place(free, sequence, whole, each)
            if whole < n and left:
                place(free, sequence + whole, 1, left)
                whole += 1
            if whole < n:
                room.setdefault(free, []).append((sequence + whole, n - whole))

        for free in sorted(f for f in room if f >= length):
            if not left:
                break
            for sequence, n in room.pop(free):
                fill(free, sequence, n)
        if left:
            n = -(-left // (capacity // length))
            opened += n
            fill(capacity, opened - n, n)
    return slots


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) among the pieces of their length, however many there are."""
    spark = rows.sparkSession
    buckets = small_table(spark, {
        "length": (pa.int64(), list(counts)), "buckets": (pa.int64(), [-(-n // RANKED_ROWS) for n in counts.values()]),
    })
    dealt = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")
    # One row per bucket: a length of all pieces of the corpus has rows / RANKED_ROWS of them.
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    spark = docs.sparkSession
    rows = Scratch(spark).write(pieces(docs, tokenizer, end_id, capacity), "pieces")
    # At most ``capacity`` lengths.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(counts, capacity)
    table = small_table(spark, {name: (pa.int64(), [getattr(s, name) for s in slots]) for name in Slots._fields})
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    placed = ranked(rows, counts).join(F.broadcast(table), "length").filter(inside)
    step = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(step / F.col("each"))).alias("sequence_id"),
        (F.col("offset") + step % F.col("each") * F.col("length")).alias("offset"),
    )


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, used, pieces): what to read for each sequence, in order. A sequence is one row of bounded size."""
    each = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("used"), each.alias("pieces"))
