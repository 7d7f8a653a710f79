"""Exact Jaccard join of word-shingle sets, and the groups its links form.

The steps skip what earlier answers already decide:

1. Sets. Equal sets are one class. A shingle that no other document has can be in no intersection,
   so a document most of whose shingles are its own has no link; only few documents go on.
2. Index lists. The shared shingles of a class are ordered from rare to common; two linked classes
   share one of the first few (the prefix). Lists are sorted by set size and cut where sizes or
   positions can no longer reach the similarity.
3. Leaders. Each class is first compared with a few leaders of its lists, the classes made of the
   most common shingles. Classes that link to a leader have its group.
4. Derived answers. On a list that still holds several groups, each class is compared once with the
   list's leader C and then described by what sets it apart from C: shingles added, shingles left out.
   Since ``|x & y| = |x & C| + |y & C| - |C| + |differences of x and y in common|``, most answers
   follow from the leader's without looking at the other set; those that do not must have differences
   in common, and these, not the shingles, are indexed. A set far from C has no link to one close to C
   (Jaccard distance is a metric), so only sets of similar distance meet.
5. Sets far from their lists' leaders meet on the lists themselves. Both kinds of lists are sorted by
   position and cut into blocks; pairs of blocks whose positions leave too small an overlap are skipped
   unread. What remains is compared by bitmaps, whose differing bits bound the overlap, then exactly.

Lists too long for a task are cut into parts, each pair of parts being a task of its own.

Defined results: a null or empty text has an empty set, links with nothing and is its own group;
rows with equal ``doc_id`` are separate documents of the same name; equal texts of fewer words than a
shingle link; a null ``doc_id`` never names a group unless all its documents lack one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.encoding import text_slices
from tidemark.llm.exchange import distinct_counts, pack, range_bits, requests, totals, unpack
from tidemark.llm.shingles import mixed, shingle_sets

LEADERS, LEADER_TOKENS = 4, 4
SKIP_ROWS = 32  # rows of an index list that are skipped or read together
HELD_PAIRS = 500_000
BLOCK_LEVEL = 12  # lists of 2^12 and more classes are cut into blocks of about 2^11


def required(n, percent: int):
    """Smallest overlap of a set of n with any partner: ``ceil(n * percent / 100)``."""
    return -(-n * percent // 100)


def overlap_needed(n_a, n_b, percent: int):
    """Smallest i with ``100 i >= percent (n_a + n_b - i)``."""
    return -(-percent * (n_a + n_b) // (100 + percent))


# --- 1. sets -------------------------------------------------------------------------------------

SENT = "range int, batch long, tails binary, counts binary, docs binary, info binary"
ANSWER = "batch long, info binary, docs binary, repeated binary"


def set_info(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, repeated): size and digest of each row's set, and how many of its
    shingles occur in another row."""
    bits = range_bits(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        schema = pa.schema([("range", pa.int32()), ("batch", pa.int64())] + [(n, pa.binary()) for n in ("tails", "counts", "docs", "info")])
        for record in batches:
            ids = record.column("doc_id").to_pylist()
            for at, texts in text_slices(record.column("text")):
                hashes, bounds = shingle_sets(texts)
                sizes = np.diff(bounds)
                distinct, counts, place = _distinct(hashes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                single = counts == 1
                # Shingles shared inside the batch are known to repeat; the others ask the ranges.
                local = np.bincount(owner, weights=~single[place], minlength=len(sizes)).astype(np.int32)
                asking = np.full(len(distinct), -1, np.int32)
                mine = single[place]
                asking[place[mine]] = owner[mine]
                rows = list(requests(number, distinct, counts, bits))
                done = 0
                for row in rows:
                    length = len(row["tails"]) // 4
                    row["docs"] = pack(asking[done : done + length])
                    done += length
                own = ids[at : at + len(texts)]
                digests = b"".join(xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:]))
                plain = np.array([0 if i is None else i for i in own], np.int64)
                null = np.array([i is None for i in own], np.int64)
                info = plain.tobytes() + null.tobytes() + sizes.astype(np.int64).tobytes() + local.astype(np.int64).tobytes() + digests
                rows.append({"range": number % (1 << bits), "batch": number, "info": info})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                number += 1

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        asked = part[part["tails"].notna()]
        out = [{"batch": b, "info": i} for b, i in zip(part["batch"], part["info"]) if i is not None]
        if len(asked):
            parts = [(np.frombuffer(t, np.uint32), unpack(c, np.uint8)) for t, c in zip(asked["tails"], asked["counts"])]
            for batch, docs, sums in zip(asked["batch"], asked["docs"], totals(parts)):
                owner = unpack(docs, np.int32)
                hit = owner[(owner >= 0) & (sums > 1)]
                if len(hit):
                    found, times = np.unique(hit, return_counts=True)
                    out.append({"batch": batch, "docs": found.astype(np.int32).tobytes(), "repeated": times.astype(np.int32).tobytes()})
        return pd.DataFrame(out, columns=["batch", "info", "docs", "repeated"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        blob = next(i for i in part["info"] if i is not None)
        n = len(blob) // 48
        ids, null, sizes, repeated = np.frombuffer(blob[: 32 * n], np.int64).reshape(4, n)
        repeated = repeated.copy()
        for docs, times in zip(part["docs"], part["repeated"]):
            if docs is not None:
                np.add.at(repeated, np.frombuffer(docs, np.int32), np.frombuffer(times, np.int32))
        digests = [blob[32 * n + 16 * i : 32 * n + 16 * i + 16] for i in range(n)]
        names = pd.array(ids, dtype="Int64")
        names[null.astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": names, "n": sizes, "digest": digests, "repeated": repeated})

    answered = source.mapInArrow(send, SENT).groupBy("range").applyInPandas(answer, ANSWER)
    return answered.groupBy("batch").applyInPandas(join, "doc_id long, n long, digest binary, repeated long")


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, place, counts = distinct_counts(hashes)
    return distinct, counts, place


# --- 2. index lists ------------------------------------------------------------------------------

SETS = "cid long, digest binary, n long, r long, central long, tokens binary, bits binary, prefix array<struct<token:long,level:int>>"


def class_sets(docs: DataFrame, viable: DataFrame, batches: int) -> DataFrame:
    """The sets of ``viable`` classes (digest, doc_id of one member), packed into batches."""
    wanted = viable.select(F.col("doc_id").alias("member"), "digest")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(wanted, F.expr("doc_id <=> member")).select("text", "digest")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in parts:
            digests = record.column("digest")
            for at, text in text_slices(record.column("text")):
                hashes, bounds = shingle_sets(text)
                rows = []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    tokens = hashes[a:b].tobytes()
                    # A document id may name several texts: only the one that was meant stays.
                    if xxhash.xxh3_128_digest(tokens) == digests[at + i].as_py():
                        rows.append({"digest": digests[at + i].as_py(), "tokens": tokens})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("digest", pa.binary()), ("tokens", pa.binary())]))

    def bundle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("digest").sort_values("digest")
        batch = int(part["batch"].iloc[0])
        cids = (np.int64(batch) << 32) + np.arange(len(part))
        lengths = np.array([len(t) // 8 for t in part["tokens"]], np.int64)
        return pd.DataFrame([{
            "batch": batch, "cids": cids.tobytes(), "lengths": lengths.tobytes(),
            "digests": b"".join(part["digest"]), "tokens": b"".join(part["tokens"]),
        }])

    rows = found.mapInArrow(sets, "digest binary, tokens binary")
    keyed = rows.withColumn("batch", F.pmod(F.xxhash64("digest"), F.lit(batches)))
    return keyed.groupBy("batch").applyInPandas(bundle, "batch long, cids binary, lengths binary, digests binary, tokens binary")


def indexed_sets(packed: DataFrame, bits: int, percent: int) -> DataFrame:
    """Classes that can still have a link: their shared shingles, bitmap and prefix."""

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                distinct, counts, _ = _distinct(np.frombuffer(row.tokens, np.uint64))
                yield pd.DataFrame(list(requests(row.batch, distinct, counts, bits)), columns=["range", "batch", "tails", "counts"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.frombuffer(t, np.uint32), unpack(c, np.uint8)) for t, c in zip(part["tails"], part["counts"])]
        levels = [pack(np.where(s > 1, np.log2(s).astype(np.uint8), 255)) for s in totals(parts)]
        return pd.DataFrame({"batch": part["batch"], "range": part["range"], "levels": levels})

    def build(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in part.itertuples():
            tokens = np.frombuffer(row.tokens, np.uint64)
            distinct, _, place = _distinct(tokens)
            levels = np.concatenate([unpack(b, np.uint8) for b in answers.sort_values("range")["levels"]]) if len(answers) else np.zeros(0, np.uint8)
            level = levels[place]
            lengths = np.frombuffer(row.lengths, np.int64)
            starts = np.cumsum(lengths) - lengths
            for i, (cid, a, n) in enumerate(zip(np.frombuffer(row.cids, np.int64).tolist(), starts.tolist(), lengths.tolist())):
                own, rank = tokens[a : a + n], level[a : a + n]
                shared = rank != 255
                r, least = int(shared.sum()), required(n, percent)
                if n == 0 or r < least:
                    continue
                own, rank = own[shared], rank[shared]
                order = np.lexsort((own, rank))[: r - least + 1]
                prefix = [{"token": int(t), "level": int(v)} for t, v in zip(own[order].view(np.int64), rank[order])]
                out.append({
                    "cid": cid, "digest": row.digests[16 * i : 16 * i + 16], "n": n, "r": r,
                    "central": int(rank.sum(dtype=np.int64)) * 1000 // n, "tokens": own.tobytes(), "bits": parity_bits(own), "prefix": prefix,
                })
        return pd.DataFrame(out, columns=["cid", "digest", "n", "r", "central", "tokens", "bits", "prefix"])

    asked = packed.select("batch", "tokens").mapInPandas(send, "range int, batch long, tails binary, counts binary")
    answered = asked.groupBy("range").applyInPandas(answer, "batch long, range int, levels binary")
    return packed.groupBy("batch").cogroup(answered.groupBy("batch")).applyInPandas(build, SETS)


def parity_bits(tokens: np.ndarray) -> bytes:
    """One bit per hash slot, set where an odd number of tokens fall; four slots or more a token."""
    slots = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference; the longer bitmap is folded onto the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ folded).sum())


# --- 3. to 5. pairs -----------------------------------------------------------------------------


def checked(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are linked: bitmaps first, then the sets themselves."""

    def side(letter: str, column: str) -> DataFrame:
        return sets.select(F.col("cid").alias(letter), *[F.col(c).alias(f"{c}_{letter}") for c in ("n", "r", column)])

    def by_bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            differ = np.array([differing_bits(x, y) for x, y in zip(p["bits_a"], p["bits_b"])], np.int64)
            most = (p["r_a"] + p["r_b"] - differ) // 2
            yield p.loc[most >= overlap_needed(p["n_a"], p["n_b"], percent), ["a", "b"]]

    def exactly(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            same = np.array([
                len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                for x, y in zip(p["tokens_a"], p["tokens_b"])
            ], np.int64)
            yield p.loc[same >= overlap_needed(p["n_a"], p["n_b"], percent), ["a", "b"]]

    likely = pairs.join(side("a", "bits"), "a").join(side("b", "bits"), "b").mapInPandas(by_bits, "a long, b long")
    likely = scratch.write(likely, f"{name}-likely")
    linked = likely.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").mapInPandas(exactly, "a long, b long")
    return scratch.write(linked, f"{name}-links")


def leader_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of each class with the leaders of its most common prefix shingles: the classes whose own
    shingles are the most common, which sit in the middle of their near copies."""
    rows = sets.select("cid", "n", "central", F.explode(F.slice(F.reverse("prefix"), 1, LEADER_TOKENS)).alias("p")).select(
        "cid", "n", "central", "p.token"
    )
    order = Window.partitionBy("token").orderBy(F.desc("central"), "cid")
    leaders = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= LEADERS).select(
        "token", F.col("cid").alias("leader"), F.col("n").alias("leader_n")
    )
    near = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    both = rows.join(leaders, "token").filter((F.col("cid") != F.col("leader")) & near)
    return both.select(F.least("cid", "leader").alias("a"), F.greatest("cid", "leader").alias("b")).distinct()


DIFFERENCES = "leader long, cid long, reference long, score long, close boolean, tokens binary"


def differences(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What sets each class apart from a leader, for ``rows`` (cid, leader).

    ``score`` is ``(100 + percent) |x & C| - percent |x|`` and ``reference`` ``(100 + percent) |C|``, C being
    the leader's shared shingles: x and y are linked just if ``(100 + percent)`` times the number of their
    common differences reaches ``reference - score(x) - score(y)``. ``close``: no class that is further from
    the leader than three times the allowed distance can be linked to x; such classes have no ``tokens``.
    """
    own = sets.select("cid", "n", F.col("tokens").alias("own"))
    led = sets.select(F.col("cid").alias("leader"), F.col("n").alias("leader_n"), F.col("tokens").alias("led"))

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for row in p.itertuples():
                x, c = np.frombuffer(row.own, np.uint64), np.frombuffer(row.led, np.uint64)
                # Sets are ascending; added shingles come first, they are the rarer ones.
                missing = ~np.isin(c, x, assume_unique=True)
                both = len(c) - int(missing.sum())
                union = row.n + row.leader_n - both
                within = 100 * both >= (3 * percent - 200) * union
                apart = np.concatenate([x[~np.isin(x, c, assume_unique=True)], c[missing]]).tobytes() if within else None
                out.append((row.leader, row.cid, (100 + percent) * len(c), (100 + percent) * both - percent * row.n,
                            100 * both >= (2 * percent - 100) * union, apart))
            yield pd.DataFrame(out, columns=["leader", "cid", "reference", "score", "close", "tokens"])

    return rows.join(own, "cid").join(led, "leader").mapInPandas(compare, DIFFERENCES)


LISTED = "key long, cid long, label long, rest long, weight long, kind int, close boolean"


def derived(apart: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that follow from the leaders' answers, and the index rows of pairs that stay open.

    The class with the highest score of a leader is linked to each class that any other is known to be
    linked to by scores alone, so links to that one class stand for all of them.
    """
    within = apart.filter(F.col("tokens").isNotNull())
    first = within.groupBy("leader").agg(F.max(F.struct("score", "cid")).alias("top")).select(
        "leader", F.col("top.score").alias("best"), F.col("top.cid").alias("middle")
    )
    scored = within.join(first, "leader").withColumn("known", F.col("score") + F.col("best") >= F.col("reference"))
    links = scored.filter("known and cid <> middle").select(F.least("cid", "middle").alias("a"), F.greatest("cid", "middle").alias("b"))
    one = 100 + percent

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            kept, keys, rest, kind = [], [], [], []
            for at, row in enumerate(p.itertuples()):
                tokens = np.frombuffer(row.tokens, np.uint64)
                # Differences that a partner must share: one that is not known, and any partner at all.
                unknown = (row.best - row.score) // one + 1
                least = unknown if row.known else max(1, -((row.score + row.best - row.reference) // one))
                length = max(0, len(tokens) - least + 1)
                pos = np.arange(length)
                kept.append(np.full(length, at))
                keys.append(mixed(tokens[:length] ^ np.uint64(row.leader)).view(np.int64))
                rest.append(len(tokens) - pos)
                kind.append(np.where(row.known, 0, np.where(pos < len(tokens) - max(least, unknown) + 1, 1, 2)))
            if kept:
                rows = p[["cid", "label", "close"]].assign(weight=2 * p["score"] - p["reference"]).iloc[np.concatenate(kept)]
                yield rows.assign(key=np.concatenate(keys), rest=np.concatenate(rest), kind=np.concatenate(kind).astype(np.int32))

    named = scored.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    return links, named.mapInPandas(index, LISTED)


def list_pairs(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs of different groups on an index list that positions allow.

    ``rows``: (key, cid, label, rest, weight, kind, close); a pair is possible if ``2 (100 + percent)`` times the
    smaller ``rest`` (entries from this one on) reaches minus the sum of the weights. Pairs of kinds 0 and 0
    are known, kind 2 meets kind 0 only, and one of the two is close.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"),
                                    F.max("kind").alias("open")).filter("low < high and open > 0").select("key", "size")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / (1 << BLOCK_LEVEL - 1)) - F.lit(1))
    own = rows.join(sizes, "key").withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # A row meets its own block and every other: as the first of the two, or as the second.
    placed = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    keyed = placed.withColumn("part", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.xxhash64("key", "i", "j")))
    one = 2 * (100 + percent)

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "i", "j", "rest", "cid"])
        cid, rest, weight, label, kind, block = (part[c].to_numpy() for c in ("cid", "rest", "weight", "label", "kind", "own"))
        close, same = part["close"].to_numpy(bool), part["i"].to_numpy() == part["j"].to_numpy()
        _, number = np.unique(np.stack([part[c].to_numpy() for c in ("key", "i", "j")]), axis=1, return_inverse=True)
        # Runs of a list's rows in order of position: what the best row of a run cannot reach, none can.
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        within = np.arange(len(number)) - np.repeat(first, np.diff(np.r_[first, len(number)]))
        start = np.flatnonzero(within % SKIP_ROWS == 0)
        end, listed = np.r_[start[1:], len(number)], number[start]
        top_rest, top_weight = np.maximum.reduceat(rest, start), np.maximum.reduceat(weight, start)
        low, high = np.minimum.reduceat(label, start), np.maximum.reduceat(label, start)
        found, held, here, step = [], 0, np.arange(len(start)), 0
        while len(here):
            here = here[here + step < len(start)]
            here = here[listed[here] == listed[here + step]]
            there = here + step
            step += 1
            read = one * np.minimum(top_rest[here], top_rest[there]) + top_weight[here] + top_weight[there] >= 0
            read &= (low[here] != high[there]) | (high[here] != low[there])
            left, right = here[read], there[read]
            for at in range(0, len(left), 512):
                b, c = left[at : at + 512], right[at : at + 512]
                # Every row of a run with every row of the other, SKIP_ROWS squared at most.
                wide = end[c] - start[c]
                count = (end[b] - start[b]) * wide
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                wide = np.repeat(wide, count)
                x, y = np.repeat(start[b], count) + k // wide, np.repeat(start[c], count) + k % wide
                good = (x < y) & (label[x] != label[y]) & (close[x] | close[y]) & (kind[x] + kind[y] > 0)
                good &= (kind[x] == 0) | (kind[y] == 0) | (kind[x] + kind[y] == 2)
                good &= one * np.minimum(rest[x], rest[y]) + weight[x] + weight[y] >= 0
                good &= same[x] | (block[x] != block[y])
                x, y = cid[x[good]], cid[y[good]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                held += len(x)
                if held > HELD_PAIRS:  # a pair that shares several lists is kept once
                    found, held = [np.unique(np.concatenate(found), axis=0)], 0
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return keyed.groupBy("part").applyInPandas(pairs, "a long, b long").distinct()


# --- groups --------------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, label): smallest id connected to each end of ``edges`` (a, b), by alternating stars."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("v", "u")).toDF("u", "v")
        small = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(small, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        after = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        following = scratch.write(after.distinct(), "edges")
        scratch.drop([now])
        now = following
    return now.select(F.col("u").alias("cid"), F.col("v").alias("label"))


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Groups ``labels`` (cid, label) joined by further ``links`` (a, b), each group being one node."""
    ends = links
    for end in ("a", "b"):
        named = labels.select(F.col("cid").alias(end), F.col("label").alias(f"{end}_label"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce(f"{end}_label", end)).drop(f"{end}_label")
    above = components(ends.select("a", "b").distinct(), scratch).select(F.col("cid").alias("node"), F.col("label").alias("top"))
    moved = labels.join(above, F.col("label") == F.col("node"), "left").select("cid", F.coalesce("top", "label").alias("label"))
    # A node that joined another group is a member of it as well.
    return moved.union(above.select("node", "top")).dropDuplicates(["cid"])


def jaccard_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n, component_id) for every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    bits = range_bits(docs)
    info = scratch.write(set_info(docs), "set-info")
    classes = info.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("repeated").alias("repeated"))
    classes = scratch.write(classes, "classes")
    viable = classes.filter((F.col("n") > 0) & (100 * F.col("repeated") >= percent * F.col("n")))
    packed = scratch.write(class_sets(docs, viable, 1 << bits), "class-sets")
    sets = scratch.write(indexed_sets(packed, bits, percent), "index")
    scratch.drop([packed])
    first = checked(leader_pairs(sets, percent), sets, percent, scratch, "leaders")
    labels = components(first, scratch)
    rows = sets.select("cid", "n", "r", "central", F.posexplode("prefix").alias("pos", "p")).select("cid", "n", "r", "central", "pos", "p.token")
    labelled = rows.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    undecided = labelled.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("central", "cid")).alias("top")
    ).filter("low < high").select("token", F.col("top.cid").alias("leader"))
    open_rows = scratch.write(labelled.join(undecided, "token"), "open")
    apart = scratch.write(differences(open_rows.select("cid", "leader").distinct(), sets, percent), "differences")
    known, near = derived(apart, labels, percent)
    far = open_rows.join(apart.filter("not close").select("cid", "leader"), ["cid", "leader"]).select(
        F.xxhash64("token").alias("key"), "cid", "label", (F.col("r") - F.col("pos")).alias("rest"),
        (-2 * percent * F.col("n")).alias("weight"), F.lit(1).alias("kind"), F.lit(True).alias("close"),
    )
    open_pairs = list_pairs(near, percent, 1 << bits).union(list_pairs(far, percent, 1 << bits)).distinct()
    second = checked(open_pairs, sets, percent, scratch, "rest").union(known)
    scratch.drop([open_rows])
    groups = merged(labels, second, scratch)
    member = sets.select("cid", "digest").join(groups, "cid").join(classes.select("digest", "doc_id"), "digest")
    named = member.groupBy("label").agg(F.min("doc_id").alias("name"))
    # The label's own class is a member too: it is the end of its edges, not a row of the groups.
    heads = groups.select(F.col("label").alias("cid")).distinct().join(sets.select("cid", "digest"), "cid").join(
        classes.select("digest", "doc_id"), "digest"
    ).select(F.col("cid").alias("label"), "digest", F.col("doc_id").alias("head"))
    both = named.join(heads.select("label", "head"), "label").select("label", F.least("name", "head").alias("component"))
    renamed = member.select("label", "digest").union(heads.select("label", "digest")).join(both, "label").select("digest", "component")
    final = classes.join(renamed, "digest", "left").select("digest", F.coalesce("component", "doc_id").alias("component"))
    out = info.join(final, "digest")
    return out.select("doc_id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
