"""Hash ranges: their number follows the size without a cap, and every hash is in one."""

import numpy as np
import pytest

from tidemark.llm import exchange as E


def test_bits_follow_the_size():
    assert [E.bits_for(n) for n in (0, E.RANGE_BYTES, 17 * E.RANGE_BYTES, 10**9)] == [4, 4, 5, 7]
    assert 10**14 / 2 ** E.bits_for(10**14) <= E.RANGE_BYTES
    assert E.bits_for(10**15) > E.bits_for(10**14)


def test_bits_without_an_estimate(spark):
    rows = spark.createDataFrame([("x" * 1000,)], "text string")
    unknown = spark.createDataFrame(rows.rdd, rows.schema)
    assert E.range_bits(unknown) == 4 and E.range_bits(unknown.limit(0)) == 4


@pytest.mark.parametrize("bits", [4, 9, 24])
def test_ranges_cover_all_hashes(bits):
    hashes = np.unique(np.random.default_rng(bits).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    cuts = list(E.ranges_of(hashes, bits))
    assert [a for _, a, _ in cuts] + [len(hashes)] == [0] + [b for _, _, b in cuts]
    assert all((int(h) >> (64 - bits)) == r for r, a, b in cuts for h in hashes[a:b])
    assert list(E.ranges_of(hashes[:0], bits)) == []
