"""Align the tokens of two tokenizers on the bytes of every text, and count which ids end together.

Tokens of both tokenizers that end at the same byte cut a text into groups. Texts are read where they lie;
only those longer than ``CHUNK_BYTES`` are cut into byte ranges that other tasks may work on:

- A range belongs to tokenizer A from the first place at or after its begin where A can be cut to the first
  such place at or after its end, and likewise to B. The places differ, so a range holds tokens of one
  that reach beyond those of the other.
- What is found in a range is a fragment: an open prefix up to the first common end, closed groups, an
  open suffix. Fragments of neighbours combine: suffix and prefix are scanned together for common ends.
  That is associative, so the fragments of a text are reduced up a tree, ``FAN`` at a time, in any grouping.

A text may be cut before white space that follows another character: A's words never go on there, and no
piece of B has a space behind another character or a line end in it (checked when the model is loaded).
Such segments repeat far more often than texts, so each task encodes and aligns a segment once.

Links (id pairs that end together) are counted per task and added up; ids of a link end in the same
bytes, so one token is a suffix of the other: there are at most as many pairs as both vocabularies have
bytes (``Codec.most_pairs``, checked). That table is broadcast to score every document's links.

Defined results: a null or empty text, and one whose bytes a tokenizer does not give back, has no tokens:
zeros, and an empty digest; rows with equal ``doc_id`` are aligned separately; a null ``doc_id`` is kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, release
from tidemark.llm.encoding import text_slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CHUNK_BYTES, FAN = 65_536, 16
SLICE_BYTES = 2_000_000
# Segments a task keeps, segments encoded in one call, link counts held before they are added up.
KEPT_SEGMENTS, CALL_SEGMENTS, HELD_LINKS = 200_000, 300, 1_000_000
# Segments learned and documents scored at once.
LEARNED, SCORED = 20_000, 500

SEGMENT = re.compile(r"[ \n]+[^ \n]+")
# White space other than the two before one of them: no place to cut, the slow way finds the others.
UNSAFE = re.compile(r"[^\S \n][ \n]")
SAFE = re.compile(r"(?<=\S)(?=[ \n]+[^ \n])")
# Places in a long text: for A before a space or line end behind a visible ASCII character; for B also
# behind any byte but a space, and on both sides of a line end.
CUT_A = re.compile(rb"(?<=[!-~])(?=[ \n])")
CUT_B = re.compile(rb"(?<=[^ ])(?= )|(?=\n)|(?<=\n)")


def segments(text: str) -> list[str]:
    """Parts of ``text`` (which starts with a space) that both tokenizers encode alone as within the text."""
    if UNSAFE.search(text):
        return SAFE.split(text)
    found = SEGMENT.findall(text)
    if not found:
        return [text]
    if text[-1] in " \n":
        found[-1] += text[len(text.rstrip(" \n")) :]
    return found


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write bytes with: visible Latin-1 ones are themselves, the others
    are the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens(NamedTuple):
    """Ids and the bytes where they end, ascending."""

    ids: np.ndarray
    ends: np.ndarray

    def __add__(self, other):  # type: ignore[override]
        return Tokens(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends]))

    def part(self, a: int, b: int | None = None) -> "Tokens":
        return Tokens(self.ids[a:b], self.ends[a:b])

    def packed(self) -> bytes:
        return np.concatenate([self.ids, self.ends]).astype(np.int64).tobytes()

    @staticmethod
    def unpacked(data: bytes) -> "Tokens":
        return Tokens(*np.frombuffer(data, np.int64).reshape(2, -1))


NOTHING = Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64))


class Codec:
    """Both tokenizers, the bytes of their tokens, and the kept segments of a task."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("the model has pieces that go on behind a space or a line end")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.most_pairs = int(self.length_a.sum() + self.length_b.sum())
        self.names_a, self.names_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(pieces))]
        # Link codes as they are written.
        self.kind = np.uint32 if len(self.bytes_a) * len(self.bytes_b) <= 1 << 32 else np.int64
        # A line end keeps the model from adding its space to the text behind it.
        self.skip = len(self.b.encode("\n"))
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.good = (np.zeros(0, np.int64) for _ in range(4))
        self.offsets, self.codes = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.bytes_b) + b

    def ids_a(self, parts: Sequence[str]) -> list[list[int]]:
        """Ids of each part. Parts that end in a visible character are encoded in one text and told apart by bytes."""
        out: list[list[int]] = []
        whole = self.a.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids
        ends = np.cumsum(self.length_a[np.array(whole, np.int64)])
        wanted = np.cumsum([len(p.encode()) for p in parts])
        at = np.searchsorted(ends, wanted)
        if len(ends) and at[-1] < len(ends) and (ends[at] == wanted).all():
            cuts = [0, *(at + 1).tolist()]
            return [whole[x:y] for x, y in zip(cuts, cuts[1:])]
        for p in parts:
            out.append(self.a.encode_batch_fast([p], add_special_tokens=False)[0].ids)
        return out

    def ids_b(self, parts: Sequence[str]) -> list[list[int]]:
        return [ids[self.skip :] for ids in self.b.encode(["\n" + p for p in parts], num_threads=1)]

    def gives_back(self, parts: Sequence[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        return [
            (data := p.encode()) == b"".join([bytes_b[i] for i in y]) and data == b"".join([bytes_a[i] for i in x])
            for p, x, y in zip(parts, a, b)
        ]

    def written(self, a: Tokens, b: Tokens, cuts: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """Groups between the cuts (places just behind the last token of each group)."""
        names_a, names_b = self.names_a, self.names_b
        xs, ys = [names_a[i] for i in a.ids.tolist()], [names_b[i] for i in b.ids.tolist()]
        at_a, at_b = cuts[0].tolist(), cuts[1].tolist()
        return [
            f"{','.join(xs[p:q])}|{','.join(ys[r:s])}" for p, q, r, s in zip([0, *at_a], at_a, [0, *at_b], at_b)
        ]

    def learn(self, new: list[str]) -> None:
        """Encode and align segments, and keep what came out."""
        visible = [s for s in new if not s[-1].isspace()]
        calls = [visible[i : i + CALL_SEGMENTS] for i in range(0, len(visible), CALL_SEGMENTS)]
        calls += [[s] for s in new if s[-1].isspace()]
        new = [s for c in calls for s in c]
        ids_a, ids_b = [x for c in calls for x in self.ids_a(c)], self.ids_b(new)
        good = self.gives_back(new, ids_a, ids_b)
        for i in (i for i, g in enumerate(good) if not g):
            ids_a[i], ids_b[i] = [], []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat = [np.array(list(chain.from_iterable(ids)), np.int64) for ids in (ids_a, ids_b)]
        a, b = (Tokens(f, np.cumsum(n[f])) for f, n in zip(flat, (self.length_a, self.length_b)))
        # One segment ends where the next begins, so all are aligned in one go.
        cut_a, cut_b = common_ends(a, b)
        texts = self.written(a, b, (cut_a, cut_b))
        last = np.searchsorted(cut_a, np.cumsum(n_a), side="right")
        n_groups = np.diff(last, prepend=0)
        bounds = last.tolist()
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.groups += [";".join(texts[x:y]) for x, y in zip([0, *bounds], bounds)]
        for name, more in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("good", np.array(good, np.int64))):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.offsets = np.concatenate([self.offsets, len(self.codes) + last])
        self.codes = np.concatenate([self.codes, self.code(a.ids[cut_a - 1], b.ids[cut_b - 1])])

    def rows(self, parts: list[str]) -> np.ndarray:
        if len(self.known) > KEPT_SEGMENTS:
            self.reset()
        new = list(dict.fromkeys(s for s in parts if s not in self.known))
        for i in range(0, len(new), LEARNED):
            self.learn(new[i : i + LEARNED])
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def tokens(self, text: str, begin: int, which: str) -> tuple[Tokens, bool]:
        """Tokens of one tokenizer in a byte range that begins at ``begin``, and whether they give it back."""
        if not text:
            return NOTHING, True
        ids = np.array((self.ids_a if which == "a" else self.ids_b)([text])[0], np.int64)
        known, lengths = (self.bytes_a, self.length_a) if which == "a" else (self.bytes_b, self.length_b)
        good = b"".join(known[i] for i in ids.tolist()) == text.encode()
        return Tokens(ids, begin + np.cumsum(lengths[ids])), good


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path_a: str, path_b: str) -> Codec:
    key = (path_a, path_b)
    if key not in _CODECS:
        _CODECS[key] = Codec(path_a, path_b)
    return _CODECS[key]


def common_ends(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places just behind the tokens of A and of B that end together."""
    if not len(a.ends) or not len(b.ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(b.ends, a.ends), len(b.ends) - 1)
    both = np.flatnonzero(b.ends[at] == a.ends)
    return both + 1, at[both] + 1


class Fragment(NamedTuple):
    """Open prefix (up to the first common end, if there is one), closed groups, open suffix."""

    cut: bool
    head_a: Tokens
    head_b: Tokens
    groups: list[str]  # joined stretches of closed groups
    codes: np.ndarray  # links that close them
    tail_a: Tokens
    tail_b: Tokens

    @staticmethod
    def of(coder: Codec, a: Tokens, b: Tokens) -> "Fragment":
        at_a, at_b = common_ends(a, b)
        if not len(at_a):
            return Fragment(False, a, b, [], np.zeros(0, np.int64), NOTHING, NOTHING)
        head_a, head_b = a.part(0, at_a[0]), b.part(0, at_b[0])
        groups, codes = closed(coder, a.part(at_a[0]), b.part(at_b[0]), (at_a[1:] - at_a[0], at_b[1:] - at_b[0]))
        return Fragment(True, head_a, head_b, groups, codes, a.part(at_a[-1]), b.part(at_b[-1]))

    def then(self, coder: Codec, other: "Fragment") -> "Fragment":
        """This fragment and the one behind it as one."""
        if not self.cut:
            seam = Fragment.of(coder, self.head_a + other.head_a, self.head_b + other.head_b)
            head_a, head_b, groups, codes = seam.head_a, seam.head_b, seam.groups, [seam.codes]
            tail_a, tail_b, cut = seam.tail_a, seam.tail_b, seam.cut
        else:
            a, b = self.tail_a + other.head_a, self.tail_b + other.head_b
            at = common_ends(a, b)
            more, links = closed(coder, a, b, at)
            head_a, head_b, groups, codes, cut = self.head_a, self.head_b, self.groups + more, [self.codes, links], True
            tail_a, tail_b = (a.part(at[0][-1]), b.part(at[1][-1])) if len(at[0]) else (a, b)
        if other.cut:
            tail_a, tail_b = other.tail_a, other.tail_b
        return Fragment(cut, head_a, head_b, groups + other.groups, np.concatenate([*codes, other.codes]), tail_a, tail_b)

    def whole(self, coder: Codec) -> tuple[list[str], np.ndarray]:
        """Groups and links of a text of which this is all."""
        cuts = np.array([len(self.head_a.ids)]), np.array([len(self.head_b.ids)])
        groups, codes = closed(coder, self.head_a, self.head_b, cuts)
        return groups + self.groups, np.concatenate([codes, self.codes])


def closed(coder: Codec, a: Tokens, b: Tokens, cuts: tuple[np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray]:
    texts = coder.written(a, b, cuts)
    return ([";".join(texts)] if texts else []), coder.code(a.ids[cuts[0] - 1], b.ids[cuts[1] - 1])


def ranges(text: str, size: int) -> list[dict]:
    """Byte ranges of a text for other tasks: what of each belongs to A and to B, and where that begins."""
    data, out = text.encode(), []
    starts = {"a": 0, "b": 0}
    for k, end in enumerate(range(size, len(data) + size, size)):
        row = {"k": k}
        for which, places in (("a", CUT_A), ("b", CUT_B)):
            found = places.search(data, end) if end < len(data) else None
            stop = max(found.start(), starts[which]) if found else len(data)
            row |= {which: data[starts[which] : stop].decode(), f"{which}_start": starts[which]}
            starts[which] = stop
        out.append(row)
    return out


# --- Spark ---------------------------------------------------------------------------------------

ALIGNED = (
    "kind int, doc_id long, row long, k int, a string, b string, a_start long, b_start long, "
    "n_a long, n_b long, n_groups long, groups_sha256 string, groups string, codes binary, counts binary"
)
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.large_string(), "binary": pa.large_binary(), "boolean": pa.bool_()}
DOCUMENT, LINKS, RANGE = range(3)


def _schema(names: str) -> pa.Schema:
    return pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in names.split(", "))])


class LinkCounts:
    """Counts of link codes, added up in bounded memory."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray) -> None:
        if len(codes):
            self.held.append(np.unique(codes, return_counts=True))
            self.size += len(self.held[-1][0])
            if self.size > HELD_LINKS:
                self.held = [self.total()]
                self.size = len(self.held[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([c for c, _ in self.held]), return_inverse=True)
        return codes, np.bincount(place, weights=np.concatenate([n for _, n in self.held])).astype(np.int64)

    def row(self) -> list[dict]:
        if not self.held:
            return []
        codes, counts = self.total()
        return [{"kind": LINKS, "codes": codes.tobytes(), "counts": counts.tobytes()}]


def scanned(docs: DataFrame, path_a: str, path_b: str, chunk: int, keep: bool) -> DataFrame:
    """Aligned short texts, the link counts of each task, and the ranges of long texts."""
    schema = _schema(ALIGNED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, links, number = codec(path_a, path_b), LinkCounts(), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, texts in text_slices(batch.column("text"), SLICE_BYTES):
                out, parts, counts, owners = [], [], [], []
                for i, text in enumerate(texts.to_pylist()):
                    row = {"kind": DOCUMENT, "doc_id": ids[at + i], "n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": "", "codes": b""}
                    if len(text) * 4 >= chunk and len(text.encode()) >= chunk:
                        number += 1
                        out += [{"kind": RANGE, "doc_id": ids[at + i], "row": number} | r for r in ranges(" " + text, chunk)]
                        continue
                    out.append(row)
                    if text:
                        own = segments(" " + text)
                        parts += own
                        counts.append(len(own))
                        owners.append(row)
                if parts:
                    found = coder.rows(parts)
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    sums = {n: np.add.reduceat(getattr(coder, n)[found], starts).tolist() for n in ("n_a", "n_b", "n_groups")}
                    good = np.minimum.reduceat(coder.good[found], starts).tolist()
                    own = pa.LargeListArray.from_arrays(coder.offsets, coder.codes).take(pa.array(found))
                    bounds, codes, groups = own.offsets.to_numpy(), own.values.to_numpy(), coder.groups
                    for j, (row, x, y) in enumerate(zip(owners, starts.tolist(), ends.tolist())):
                        if good[j]:
                            text = ";".join([groups[g] for g in found[x:y].tolist()])
                            mine = codes[bounds[x] : bounds[y]]
                            row |= {n: sums[n][j] for n in sums}
                            row |= {"groups_sha256": hashlib.sha256(text.encode()).hexdigest(), "codes": mine.astype(coder.kind).tobytes()}
                            if keep:
                                row["groups"] = text
                    kept = np.repeat(np.repeat(np.array(good, bool), counts), np.diff(bounds))
                    links.add(codes[bounds[0] : bounds[-1]][kept])
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        if links.held:
            yield pa.RecordBatch.from_pylist(links.row(), schema=schema)
        release()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(scan, ALIGNED)


FRAGMENTS = (
    "row long, k int, doc_id long, good boolean, cut boolean, n_a long, n_b long, head_a binary, head_b binary, "
    "groups string, codes binary, tail_a binary, tail_b binary"
)
OPEN = ("head_a", "head_b", "tail_a", "tail_b")


def _packed(f: Fragment) -> dict:
    return {
        "cut": f.cut, "groups": ";".join(f.groups), "codes": f.codes.astype(np.int64).tobytes(),
        **{n: getattr(f, n).packed() for n in OPEN},
    }


def _unpacked(row) -> Fragment:
    groups = [row.groups] if row.groups else []
    tokens = {n: Tokens.unpacked(getattr(row, n)) for n in OPEN}
    return Fragment(cut=row.cut, groups=groups, codes=np.frombuffer(row.codes, np.int64), **tokens)


def fragments(cut: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The fragment of every range, wherever it is worked on."""
    schema = _schema(FRAGMENTS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path_a, path_b)
        for batch in batches:
            for r in batch.to_pylist():
                a, good_a = coder.tokens(r["a"], r["a_start"], "a")
                b, good_b = coder.tokens(r["b"], r["b_start"], "b")
                row = {n: r[n] for n in ("row", "k", "doc_id")} | {"good": good_a and good_b, "n_a": len(a.ids), "n_b": len(b.ids)}
                yield pa.RecordBatch.from_pylist([row | _packed(Fragment.of(coder, a, b))], schema=schema)

    # Spread by range, so that one long text is the work of many tasks.
    return cut.select("doc_id", "row", "k", "a", "b", "a_start", "b_start").repartition("row", "k").mapInArrow(find, FRAGMENTS)


def reduced(found: DataFrame, most: int, path_a: str, path_b: str, fan: int = FAN) -> DataFrame:
    """One fragment per text: neighbours are joined ``fan`` at a time until none of ``most`` ranges is alone."""

    def join(part: pd.DataFrame) -> pd.DataFrame:
        coder, rows = codec(path_a, path_b), list(part.sort_values("k").itertuples(index=False))
        total = _unpacked(rows[0])
        for r in rows[1:]:
            total = total.then(coder, _unpacked(r))
        same = {"row": rows[0].row, "k": rows[0].k, "doc_id": rows[0].doc_id, "good": all(r.good for r in rows)}
        sums = {n: sum(getattr(r, n) for r in rows) for n in ("n_a", "n_b")}
        out = pd.DataFrame([same | sums | _packed(total)])[[c.split()[0] for c in FRAGMENTS.split(", ")]]
        return out.astype({"doc_id": "Int64"})

    width = 1
    while width < most:
        width *= fan
        found = found.withColumn("g", F.floor(F.col("k") / width)).groupBy("row", "g").applyInPandas(lambda p: join(p.drop(columns="g")), FRAGMENTS)
    return found


def finished(found: DataFrame, path_a: str, path_b: str, keep: bool) -> DataFrame:
    """Whole texts from their last fragments, in the columns of ``scanned``."""
    schema = _schema(ALIGNED)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, links = codec(path_a, path_b), LinkCounts()
        for batch in batches:
            for i in range(batch.num_rows):
                r = next(pd.DataFrame(batch.slice(i, 1).to_pylist()).itertuples(index=False))
                doc_id = batch.column("doc_id")[i].as_py()
                row = {"kind": DOCUMENT, "doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": "", "codes": b""}
                if r.good:
                    groups, codes = _unpacked(r).whole(coder)
                    text = ";".join(groups)
                    links.add(codes)
                    row |= {"n_a": r.n_a, "n_b": r.n_b, "n_groups": len(codes), "codes": codes.astype(coder.kind).tobytes()}
                    row["groups_sha256"] = hashlib.sha256(text.encode()).hexdigest()
                    if keep:
                        row["groups"] = text
                yield pa.RecordBatch.from_pylist([row], schema=schema)
        if links.held:
            yield pa.RecordBatch.from_pylist(links.row(), schema=schema)

    return found.mapInArrow(close, ALIGNED)


def aligned(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK_BYTES, keep: bool = False) -> DataFrame:
    """Written rows of all documents (kind 0) and of link counts (kind 1)."""
    scratch = Scratch(docs.sparkSession)
    first = scratch.write(scanned(docs, path_a, path_b, chunk, keep), "aligned")
    cut = first.filter(F.col("kind") == RANGE)
    most = cut.agg(F.max("k")).first()[0]
    rows = first.filter(F.col("kind") != RANGE)
    if most is None:
        return rows
    found = scratch.write(fragments(cut, path_a, path_b), "fragments")
    long = scratch.write(finished(reduced(found, most + 1, path_a, path_b), path_a, path_b, keep), "aligned-long")
    return rows.unionByName(long)


def link_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, count, best): how often ids end together in all documents, and whether B's id does so most with A's."""
    width = len(codec(path_a, path_b).bytes_b)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (codes, counts)], ["code", "n"])

    each = rows.filter(F.col("kind") == LINKS).select("codes", "counts").mapInArrow(unpack, "code long, n long")
    total = each.groupBy("code").agg(F.sum("n").alias("count")).withColumn("b", F.col("code") % width)
    most = total.groupBy("b").agg(F.max("count").alias("most"))
    return total.join(most, "b").select(
        F.floor(F.col("code") / width).alias("a"), "b", "count", (F.col("count") == F.col("most")).alias("best")
    )


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK_BYTES, keep: bool = False) -> DataFrame:
    """Alignment of every document of ``docs`` (doc_id, text) with the corpus-wide counts of its links.

    ``keep`` adds the groups themselves (``groups``: ``a1,a2|b1;...``).
    """
    spark = docs.sparkSession
    rows = aligned(docs, path_a, path_b, chunk, keep)
    coder = codec(path_a, path_b)
    # At most ``most_pairs`` rows, whatever the corpus.
    pairs = Scratch(spark).write(link_counts(rows, path_a, path_b), "links").toPandas()
    if len(pairs) > coder.most_pairs:
        raise AssertionError("more id pairs than suffixes in the vocabularies")
    codes = coder.code(pairs["a"].to_numpy(np.int64), pairs["b"].to_numpy(np.int64))
    order = np.argsort(codes)
    table = spark.sparkContext.broadcast((codes[order], pairs["count"].to_numpy(np.int64)[order], pairs["best"].to_numpy(bool)[order]))
    kept = ["groups"] if keep else []
    names, kind = RESULT + (", groups string" if keep else ""), coder.kind
    schema = _schema(names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = table.value
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED):
                batch = whole.slice(start, SCORED)
                lists = [np.frombuffer(c, kind) for c in batch.column("codes").to_pylist()]
                sizes = np.array([len(c) for c in lists])
                at = np.searchsorted(known, np.concatenate(lists).astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                own = {n: batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *kept)}
                own["n_links"] = pa.array(sizes, pa.int64())
                for name, values in (("n_best", best), ("count_sum", counts)):
                    total = np.concatenate([[0], np.cumsum(values[at] if len(at) else np.zeros(0, np.int64), dtype=np.int64)])
                    own[name] = pa.array(total[ends[1:]] - total[ends[:-1]])
                yield pa.RecordBatch.from_arrays([own[n].cast(t) for n, t in zip(schema.names, schema.types)], schema=schema)

    return rows.filter(F.col("kind") == DOCUMENT).select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *kept, "codes").mapInArrow(score, names)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
