"""Token ids as length-delimited binary records with masked checksums and an offset index.

A shard is a sequence of frames ``length u64 | masked CRC-32C of length | payload | masked CRC-32C
of payload``, little endian, the framing that record readers of training frameworks expect. The
payload of a document is ``doc_id i64 | tokens u32 | flags u32 | ids``: ids take two bytes where the
vocabulary fits, else four, padded to whole words of four bytes; flag 1 marks a null ``doc_id``, flag
2 two-byte ids. Beside each shard lies its index: ``doc_id i64 | offset u64 | length u64`` per record,
for shuffled reads.

Shards are cut from a range partitioning by ``doc_id``: their order is the order of ids. A task writes
files under names of its own; the table of shards that the job commits names those of the tasks that
succeeded, so repeated or lost tasks leave no trace in what is read.

Defined results: a null text is empty and holds the end id alone; a null ``doc_id`` sorts first; rows
with equal ``doc_id`` are kept, next to each other, ordered by text hash. No rows, no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, release
from tidemark.llm.encoding import ENCODE_BYTES, encoder, text_slices
from tidemark.session import scratch_path

SHARD_WORDS = 4_000_000  # words of four bytes after which a shard is closed: 16 MB
NULL_ID, NARROW = 1, 2
HEAD = 4  # words of a payload before its ids
CHUNK = 128

_REFLECTED = 0x82F63B78


def _byte_tables() -> list[np.ndarray]:
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(_REFLECTED), first >> 1)
    tables = [first]
    for _ in range(3):
        last = tables[-1]
        tables.append(first[last & 255] ^ (last >> 8))
    return tables


T0, T1, T2, T3 = _byte_tables()


def _skip_tables(zero_bytes: int) -> list[np.ndarray]:
    """Effect of ``zero_bytes`` zero bytes on a checksum, for each byte of it."""
    out = []
    for shift in (0, 8, 16, 24):
        value = np.arange(256, dtype=np.uint32) << np.uint32(shift)
        for _ in range(zero_bytes):
            value = T0[value & 255] ^ (value >> 8)
        out.append(value)
    return out


SKIP = _skip_tables(4 * CHUNK)


def _bytewise(tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def crc32c(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of ``words[start : start + length]`` for every record at once.

    Records are cut into chunks from their end; leading zeros do not change a checksum that starts
    at 0, and starting at all ones equals inverting the first word. Chunks advance in lockstep and
    are joined by the effect of a chunk of zeros.
    """
    chunks = -(-lengths // CHUNK)
    lane_ends = np.cumsum(chunks)
    lanes = np.zeros((int(lane_ends[-1]) if len(lane_ends) else 0, CHUNK), np.uint32)
    flat = lanes.reshape(-1)
    for start, length, end in zip(starts.tolist(), lengths.tolist(), (lane_ends * CHUNK).tolist()):
        flat[end - length : end] = words[start : start + length]
        flat[end - length] ^= np.uint32(0xFFFFFFFF)
    crc = np.zeros(len(lanes), np.uint32)
    for column in np.ascontiguousarray(lanes.T):
        crc = _bytewise([T3, T2, T1, T0], crc ^ column)
    first = lane_ends - chunks
    order = np.argsort(-chunks, kind="stable")
    first, left = first[order], chunks[order]
    total = np.zeros(len(chunks), np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # records with more than k chunks
        total[:n] = _bytewise(SKIP, total[:n]) ^ crc[first[:n] + k]
    out = np.empty_like(total)
    out[order] = total
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of a batch of documents as words, and each frame's offset and length in words."""
    counts = np.diff(bounds)
    payload = HEAD + (-(-counts // 2) if narrow else counts)
    ends = np.cumsum(payload + 4)
    starts = ends - (payload + 4)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    out[starts] = payload * 4
    head = starts + 3
    plain = np.array([0 if d is None else d for d in doc_ids], np.int64).view(np.uint32).reshape(-1, 2)
    out[head], out[head + 1], out[head + 2] = plain[:, 0], plain[:, 1], counts
    out[head + 3] = np.array([d is None for d in doc_ids], np.uint32) * NULL_ID + NARROW * narrow
    halves = out.view(np.uint16)
    for at, a, b in zip((head + HEAD).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        if narrow:
            halves[2 * at : 2 * at + b - a] = ids[a:b]
        else:
            out[at : at + b - a] = ids[a:b]
    out[starts + 2] = masked(crc32c(out, starts, np.full(len(starts), 2)))
    out[ends - 1] = masked(crc32c(out, head, payload))
    return out, starts, payload + 4


def parse(content: bytes) -> Iterator[tuple[int | None, np.ndarray, int, int]]:
    """(doc_id, ids, offset, length) of a shard's records, after checking every checksum."""
    words = np.frombuffer(content, np.uint32)
    starts, at = [], 0
    while at < len(words):
        starts.append(at)
        at += int(words[at]) // 4 + 4
    begin = np.array(starts, np.int64)
    size = words[begin].astype(np.int64) // 4 if starts else np.zeros(0, np.int64)
    if at != len(words) or (masked(crc32c(words, begin, np.full(len(begin), 2))) != words[begin + 2]).any():
        raise ValueError("broken record length")
    if (masked(crc32c(words, begin + 3, size)) != words[begin + 3 + size]).any():
        raise ValueError("broken record")
    for start, length in zip(starts, size.tolist()):
        body = words[start + 3 : start + 3 + length]
        count, flags = int(body[2]), int(body[3])
        ids = body[HEAD:].view(np.uint16)[:count].astype("<u4") if flags & NARROW else body[HEAD : HEAD + count]
        doc_id = None if flags & NULL_ID else int(body[:2].copy().view(np.int64)[0])
        yield doc_id, ids, 4 * start, 4 * (length + 4)


SHARDS = "part int, roll int, path string, records long, tokens long"


def write_records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write shards and indexes, return the committed shards.

    ``tokenizer`` is the place of the tokenizer's file on every executor.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "records")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        coder = encoder(tokenizer)
        narrow = max(coder.size, end_id + 1) <= 1 << 16
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, roll = TaskContext.get().partitionId(), 0
        name, out, index, tokens, held = "", None, [], 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            rows = np.concatenate(index)
            with store.open_output_stream(f"{root}/{name}.idx") as file:
                file.write(rows.astype("<i8").tobytes())
            return pa.RecordBatch.from_pylist(
                [{"part": part, "roll": roll, "path": f"{folder}/{name}", "records": len(rows), "tokens": tokens}],
                schema=pa.schema([("part", pa.int32()), ("roll", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())]),
            )

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at, texts in text_slices(batch.column("text"), ENCODE_BYTES):
                ids, bounds = coder.encode(texts)
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                own = keys[at : at + len(texts)]
                words, starts, lengths = frame(own, ids, bounds, narrow)
                plain = np.array([0 if k is None else k for k in own], np.int64)
                if out is None:
                    name = f"{part:06d}-{roll:04d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{name}.rec")
                # Frames leave the task as they are made; only their index is held.
                out.write(words.astype("<u4", copy=False).data)
                index.append(np.stack([plain, 4 * (held + starts), 4 * lengths], axis=1))
                held, tokens = held + len(words), tokens + len(ids)
                if held >= SHARD_WORDS:
                    yield close()
                    roll, out, index, tokens, held = roll + 1, None, [], 0, 0
        if out is not None:
            yield close()
        release()

    return Scratch(spark).write(ordered.mapInArrow(write, SHARDS), "shards")


def _files(shards: DataFrame, kind: str) -> DataFrame:
    """Contents of the committed shards' files, found by name in the folder they were written to."""
    spark = shards.sparkSession
    one = shards.select("path").first()
    if one is None:
        return shards.select(F.lit("").alias("name"), F.lit(b"").alias("content"), "part", "roll").limit(0)
    folder = one["path"].rsplit("/", 1)[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(folder)
    named = files.select(F.regexp_extract("path", rf"([^/]+)\.{kind}$", 1).alias("name"), "content")
    wanted = shards.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "part", "roll")
    return named.join(F.broadcast(wanted), "name") if wanted.count() <= 100_000 else named.join(wanted, "name")


DIGEST = "part int, roll int, doc_id long, before long, n_tokens long, ids_crc32 long"


def read_digests(shards: DataFrame) -> DataFrame:
    """Read the shards back: per record its ids before it in all shards, its count and checksum."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("roll", pa.int32())] + [(n, pa.int64()) for n in ("doc_id", "before", "n_tokens", "ids_crc32")])
        for batch in batches:
            for part, roll, content in zip(*(batch.column(n) for n in ("part", "roll", "content"))):
                rows, before = [], 0
                for doc_id, ids, _, _ in parse(content.as_py()):
                    rows.append((part.as_py(), roll.as_py(), doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    records = _files(shards, "rec").select("part", "roll", "content").mapInArrow(digest, DIGEST)
    # One row per shard of many documents; their running total is small whatever the corpus.
    order = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "roll", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("shard_start"))
    return records.join(starts, ["part", "roll"]).select(
        "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_index(shards: DataFrame) -> DataFrame:
    """(path, doc_id, offset, length) of every record, from the index files."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                rows = np.frombuffer(content.as_py(), "<i8").reshape(-1, 3)
                yield pa.RecordBatch.from_pydict(
                    {"name": [name] * len(rows), "doc_id": rows[:, 0], "offset": rows[:, 1], "length": rows[:, 2]}
                )

    found = _files(shards, "idx").select("name", "content").mapInArrow(entries, "name string, doc_id long, offset long, length long")
    paths = shards.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.concat("path", F.lit(".rec")).alias("path"))
    return found.join(paths, "name").select("path", "doc_id", "offset", "length")


def fetch(wanted: DataFrame) -> DataFrame:
    """Read single records by (path, offset, length), in whatever order ``wanted`` has them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    content = file.read_at(row["length"], row["offset"])
                for doc_id, ids, _, _ in parse(content):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "ids": ids.tolist()}], schema=schema)

    return wanted.select("path", "offset", "length").mapInArrow(read, "doc_id long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded_records(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as records and return what the files hold, per document."""
    return read_digests(write_records(docs, tokenizer or default_tokenizer(), end_id))
