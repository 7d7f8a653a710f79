"""Packing: the plan against best fit piece by piece, pieces against direct encoding, gapless sequences."""

import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing as K
from tidemark.llm import queries
from tidemark.llm.records import default_tokenizer


def piecewise(lengths, capacity):
    """Best-fit decreasing, one piece at a time: free space of every sequence."""
    free = []
    for n in sorted(lengths, reverse=True):
        i = bisect_left(free, n)
        room = free.pop(i) if i < len(free) else capacity
        insort(free, room - n)
    return free


def laid_out(slots):
    """(sequence, offset, length) of all pieces that the plan places."""
    for s in slots:
        for rank in range(s.first, s.stop):
            step = rank - s.first
            yield s.sequence + step // s.each, s.offset + step % s.each * s.length, s.length


def check_gapless(places, capacity):
    ends = defaultdict(int)
    for sequence, offset, length in sorted(places):
        assert ends[sequence] == offset and offset + length <= capacity
        ends[sequence] += length
    return ends


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 2048])
    top = rng.choice([capacity, max(1, capacity // 3), min(capacity, 5)])
    lengths = [rng.randint(1, top) for _ in range(rng.choice([0, 1, 50, 800]))] + [capacity] * rng.randint(0, 3)
    counts = {n: lengths.count(n) for n in set(lengths)}
    ends = check_gapless(laid_out(K.plan(counts, capacity)), capacity)
    assert sorted(capacity - e for e in ends.values()) == piecewise(lengths, capacity)
    ranks = defaultdict(list)
    for s in K.plan(counts, capacity):
        ranks[s.length] += range(s.first, s.stop)
    assert ranks == {n: list(range(c)) for n, c in counts.items()}


def test_plan_stays_small_whatever_the_counts():
    counts = {n: 10**12 // n for n in range(1, 2049)}
    slots = K.plan(counts, 2048)
    assert len(slots) < 40 * 2048
    used = max(s.sequence + -(-(s.stop - s.first) // s.each) for s in slots)
    assert used <= 1.001 * sum(n * c for n, c in counts.items()) / 2048


def brute(rows, capacity):
    from tokenizers import Tokenizer

    model, out = Tokenizer.from_file(default_tokenizer()), []
    for doc_id, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            out.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    return out


@pytest.mark.parametrize("capacity, ranked_rows", [(2048, 50_000), (16, 2)])
def test_packed_table(spark, edge, monkeypatch, capacity, ranked_rows):
    monkeypatch.setattr(K, "RANKED_ROWS", ranked_rows)
    odd = spark.createDataFrame([(90, "a | b || c|d"), (91, "|"), (92, "x|" * 30), (93, "tab\there\u00a0too")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(odd).repartition(5)
    rows = K.pack(docs, default_tokenizer(), 0, capacity).collect()
    want = brute([tuple(r) for r in docs.collect()], capacity)
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(want, key=repr)
    ends = check_gapless([(r["sequence_id"], r["offset"], r["length"]) for r in rows], capacity)
    assert len(ends) == len(piecewise([w[3] for w in want], capacity))
    made = K.sequences(K.pack(docs, default_tokenizer(), 0, capacity)).collect()
    assert sorted(r["used"] for r in made) == sorted(ends.values())


def test_query(spark, tmp_path, edge):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11_best_fit_packing(spark, str(tmp_path)).collect()
    want = brute([(r["doc_id"], r["text"]) for r in edge.collect()], 2048)
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(want, key=repr)
    check_gapless([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)


def test_empty_table(empty):
    assert K.pack(empty, default_tokenizer(), 0).count() == 0
