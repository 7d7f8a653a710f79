"""Groups against all pairs."""

import re
from itertools import combinations

import numpy as np

from tidemark.llm.jaccard import components, derived, differences, differing_bits, jaccard_groups, list_pairs, parity_bits
from tidemark.llm.common import Scratch

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return [(i, len(s), names.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def check(df, rows):
    got = [tuple(r) for r in jaccard_groups(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_edge_rows(edge):
    check(edge, [(r["doc_id"], r["text"]) for r in edge.collect()])


def test_chains_and_stragglers(spark, texts):
    rows = []
    for family in range(4):
        words = texts(family, 120).split()
        for k in range(40):
            rng = np.random.default_rng(family * 100 + k)
            own = list(words)
            for p in rng.integers(0, len(own), k % 9):
                own[p] = f"w{family}x{k}x{p}"
            rows.append((family * 1000 + k, " ".join(own)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows)


def test_empty_table(empty):
    assert jaccard_groups(empty).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m, common in ((10, 300, 8), (200, 210, 150), (64, 64, 64), (1, 1, 0)):
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        x, y = pool[:n], np.concatenate([pool[:common], pool[n : n + m - common]])
        assert differing_bits(parity_bits(x), parity_bits(y)) <= len(set(x.tolist()) ^ set(y.tolist()))


LISTED = "key long, cid long, label long, rest long, weight long, kind int, close boolean"


def test_long_lists_are_cut_into_parts(spark):
    rows = [(1, c, max(0, 30 - c), 20, -3000, 1, True) for c in range(9000)]
    got = list_pairs(spark.createDataFrame(rows, LISTED), 75, 4)
    assert got.count() == 30 * 29 // 2 + 30 * 8970


def test_positions_and_kinds(spark):
    rng = np.random.default_rng(3)
    rows = [
        (int(k), c, int(rng.integers(0, 40)), int(rng.integers(1, 60)), -int(rng.integers(2000, 9000)), int(rng.integers(0, 3)), bool(rng.integers(0, 2)))
        for k in (1, 2, 3) for c in range(120)
    ]
    want = set()
    for x, y in combinations(rows, 2):
        if x[0] == y[0] and x[2] != y[2] and (x[6] or y[6]) and (x[5], y[5]) not in {(0, 0), (1, 2), (2, 1), (2, 2)}:
            if 350 * min(x[3], y[3]) + x[4] + y[4] >= 0:
                want.add((min(x[1], y[1]), max(x[1], y[1])))
    got = list_pairs(spark.createDataFrame(rows, LISTED), 75, 4).collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_copies_around_a_text_that_is_not_there(spark, texts):
    """Edits of two templates, many of which link to a few others only, and sets that differ in length."""
    rows, base = [], texts(9, 100).split()
    second = base[:60] + texts(10, 40).split()
    for k in range(260):
        rng = np.random.default_rng(k)
        words = list((base, second)[k % 2][: 100 - k % 23])
        for p in rng.integers(0, len(words), k % 6):
            words[p] = f"x{int(rng.integers(0, 3))}"
        rows.append((k, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), rows)


def test_derived_answers_find_all_links(spark):
    """Without links to leaders beforehand, scores and differences alone must find the groups."""
    rng = np.random.default_rng(8)
    core, sets = rng.integers(1, 1 << 62, 90, dtype=np.uint64), []
    for k in range(150):
        keep = core[rng.random(90) > 0.002 * k]
        sets.append(np.unique(np.concatenate([keep, rng.integers(1, 12 + 2 * k, k // 8).astype(np.uint64)])))
    # Each set says it has three shingles more than are shared, as sets with own shingles do.
    frame = spark.createDataFrame([(k, len(s) + 3, s.tobytes()) for k, s in enumerate(sets)], "cid long, n long, tokens binary")
    for leader in (0, 60, 140):
        apart = differences(frame.selectExpr("cid", f"{leader}L AS leader"), frame, 75)
        known, rows = derived(apart, spark.createDataFrame([], "cid long, label long"), 75)
        pairs = {tuple(r) for r in known.collect()}, {tuple(r) for r in list_pairs(rows, 75, 3).collect()}
        size = [len(s) + 3 for s in sets]

        def overlap(a, b):
            return len(np.intersect1d(sets[a], sets[b]))

        def linked(a, b):
            return 175 * overlap(a, b) >= 75 * (size[a] + size[b])

        close = [100 * overlap(k, leader) >= 50 * (size[k] + size[leader] - overlap(k, leader)) for k in range(150)]
        assert all(linked(a, b) for a, b in pairs[0])
        root = list(range(150))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in pairs[0] | {p for p in pairs[1] if linked(*p)}:
            root[find(a)] = find(b)
        wanted = [(a, b) for a, b in combinations(range(150), 2) if linked(a, b) and (close[a] or close[b])]
        assert len(wanted) > 300 and all(find(a) == find(b) for a, b in wanted)


def test_components(spark):
    edges = [(a, a + 1) for a in range(50)] + [(100, 103), (103, 101), (101, 102), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["cid"]: r["label"] for r in components(df, Scratch(spark)).collect()}
    assert got == {**{a: 0 for a in range(1, 51)}, 101: 100, 102: 100, 103: 100}
