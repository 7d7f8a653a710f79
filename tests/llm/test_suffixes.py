"""Removed bytes against a search for every window."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import suffixes as S
from tidemark.llm.exchange import pack, unpack
from tidemark.llm.suffixes import remove_repeats


def brute(rows, length):
    data = [((1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for (i, b), (name, _) in zip(data, rows):
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        spans = [k for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((name, len(b), sum(gone), len(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [50, 34])
def test_edge_rows(edge, length):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = [
        (r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
        for r in remove_repeats(edge, length).collect()
    ]
    assert sorted(got, key=repr) == sorted(brute(rows, length), key=repr)


def test_shared_passages(spark, texts):
    passage = texts(99, 12)
    rows = [(i, f"{texts(i, 20)}{passage[i % 7 :]} {texts(i + 500, 9)}{passage[: 60 + i % 5]}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [(r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in remove_repeats(df).collect()]
    assert sorted(got) == sorted(brute(rows, 50))


def test_empty_table(empty):
    assert remove_repeats(empty).count() == 0


def test_too_short_windows(edge):
    with pytest.raises(ValueError):
        remove_repeats(edge, 20)


def test_answers_need_little_memory_beside_their_requests(monkeypatch):
    rng, rows, n = np.random.default_rng(2), [], 300_000
    for batch in range(10):
        one, two = rng.integers(0, n, n // 10) * 12_000, rng.integers(0, 3, n // 10)
        order = np.lexsort((two, one))
        row = {"tails": one[order].astype(np.uint32).tobytes(), "second": two[order].astype(np.uint64).tobytes()}
        rows.append({"range": 1, "batch": batch} | row | {"ids": pack(rng.integers(0, 99, n // 10))})
    part = pd.DataFrame(rows)
    whole = S.answer_pairs(2)(part)
    monkeypatch.setattr(S, "SORTED_KEYS", 20_000, raising=False)
    tracemalloc.start()
    found = S.answer_pairs(2)(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * n
    for column, kind in (("result", np.int64), ("differs", np.uint8)):
        assert all((unpack(a, kind) == unpack(b, kind)).all() for a, b in zip(whole[column], found[column]))
