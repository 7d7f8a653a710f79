"""Records: checksums bit by bit, framing, and the round trip against direct encoding."""

import zlib

import numpy as np
import pytest

from tidemark.llm import records as R


def slow_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc = int(R.T0[(crc ^ byte) & 255]) ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    assert slow_crc(b"123456789") == 0xE3069283  # the published check value
    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 127, 128, 129, 500, 256, 1])
    words = rng.integers(0, 1 << 32, int(lengths.sum()), dtype=np.uint32)
    starts = np.cumsum(lengths) - lengths
    want = [slow_crc(words[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert R.crc32c(words, starts, lengths).tolist() == want


@pytest.mark.parametrize("narrow", [True, False])
def test_frames(narrow):
    ids = np.array([5, 6, 7, 49407, 2, 2, 9, 2], np.uint32)
    bounds = np.array([0, 5, 6, 8, 8])
    words, starts, lengths = R.frame([3, None, -(1 << 60), 4], ids, bounds, narrow)
    got = list(R.parse(words.tobytes()))
    assert [(d, i.tolist()) for d, i, _, _ in got] == [(3, [5, 6, 7, 49407, 2]), (None, [2]), (-(1 << 60), [9, 2]), (4, [])]
    assert [(o, n) for _, _, o, n in got] == [(4 * int(s), 4 * int(n)) for s, n in zip(starts, lengths)]
    broken = bytearray(words.tobytes())
    broken[30] ^= 1
    with pytest.raises(ValueError):
        list(R.parse(bytes(broken)))


def test_round_trip(edge):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(R.default_tokenizer())
    shards = R.write_records(edge, R.default_tokenizer(), 2)
    got = [tuple(r) for r in R.read_digests(shards).orderBy("start").collect()]
    start, want = 0, []
    rows = sorted(edge.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for r in rows:
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    index = R.read_index(shards)
    assert index.count() == len(want)
    picked = {(r["doc_id"], len(r["ids"])) for r in R.fetch(index.filter("doc_id IN (9, 5)")).collect()}
    assert picked == {(d, n) for d, _, n, _ in want if d in (9, 5)}


def test_special_strings_and_marks(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(R.default_tokenizer())
    odd = ["a<|endoftext|>b c", "it's 'S don't", "é ́x", "A B C\x0bD\x85E", "日本 語\n\n12 345", "ΣΑΣ ς", "﻿a ​b"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in R.encoded_records(spark, df).collect():
        ids = model.encode(odd[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_empty_table(spark, empty):
    assert R.encoded_records(spark, empty).count() == 0
