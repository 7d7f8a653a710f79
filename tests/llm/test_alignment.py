"""Token alignment: whole texts encoded directly, fragments joined in any grouping, corpus-wide counts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import alignment as A
from tidemark.llm import queries

ODD = [
    "a  b   c", " lead", "trail ", "trail \n", "\n\nx\n\n y", "\t tab\t\tx \ty", "   ", "\n", "x\u00a0 y\u00a0z \u2003 w", "don't can't I'll",
    "<|endoftext|> <s> </s> <unk>", "a\x00b \x1f c\x85 d", "\u65e5\u672c\u8a9e \u306e \u6587", "e\u0301 \ufb01 \u00bd \U0001f600\U0001f600", "mark \u2581 here", "x\u2581y",
    "12345 3.14159,26 == != <= foo_bar(baz)", "y" * 700, " ".join("zz" * 40), "line one\nline two\n  indented\r\nend \r\n", "\u00e9" * 300, "a\n", "\u3000wide\u3000 space",
]


@pytest.fixture(scope="module")
def coder():
    return A.Codec(*A.default_paths())


def direct(coder, text):
    """(n_a, n_b, links, groups) of a text encoded as a whole."""
    if not text:
        return 0, 0, [], ""
    data = (" " + text).encode()
    a = coder.a.encode(" " + text, add_special_tokens=False).ids
    b = coder.b.encode(text)
    if b"".join(coder.bytes_a[i] for i in a) != data or b"".join(coder.bytes_b[i] for i in b) != data:
        return 0, 0, [], ""
    ends_a, ends_b = np.cumsum([len(coder.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(coder.bytes_b[i]) for i in b]).tolist()
    links, groups, x, y = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
        links.append((a[p - 1], b[q - 1]))
        groups.append(f"{','.join(map(str, a[x:p]))}|{','.join(map(str, b[y:q]))}")
        x, y = p, q
    return len(a), len(b), links, ";".join(groups)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def random_text(rng, n):
    alphabet = ["a", "b", "the", "ing", "\u00e9", "1", ".", ",", "'s", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u65e5", "\r\n", "<s>"]
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_segments_encode_as_within_the_text(coder, texts):
    rng = random.Random(3)
    for text in [*ODD, texts(3, 200), *(random_text(rng, rng.randint(1, 60)) for _ in range(1500))]:
        parts = A.segments(" " + text)
        assert "".join(parts) == " " + text
        rows = coder.rows(parts)
        n_a, n_b, links, groups = direct(coder, text)
        if n_a:
            assert coder.good[rows].all() and (coder.n_a[rows].sum(), coder.n_b[rows].sum()) == (n_a, n_b), text
            assert ";".join(coder.groups[r] for r in rows) == groups
        else:
            assert not coder.good[rows].all()


def pieces_of(coder, text, size):
    out = []
    for r in A.ranges(" " + text, size):
        (a, good_a), (b, good_b) = coder.tokens(r["a"], r["a_start"], "a"), coder.tokens(r["b"], r["b_start"], "b")
        assert good_a and good_b
        out.append(A.Fragment.of(coder, a, b))
    return out


def folded(coder, parts, rng):
    """Join neighbours in random order."""
    parts = list(parts)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i].then(coder, parts[i + 1])]
    return parts[0]


@pytest.mark.parametrize("size", [3, 17, 60, 400])
def test_fragments_join_in_any_grouping(coder, texts, size):
    rng = random.Random(size)
    opened = 0
    for text in [texts(8, 150), *(random_text(rng, 120) for _ in range(60)), *[t for t in ODD if direct(coder, t)[0]]]:
        n_a, n_b, links, groups = direct(coder, text)
        parts = pieces_of(coder, text, size)
        opened += sum(len(p.tail_a.ids) + len(p.tail_b.ids) > 0 for p in parts)
        for _ in range(3):
            whole = folded(coder, parts, rng)
            got, codes = whole.whole(coder)
            assert ";".join(got) == groups and codes.tolist() == [coder.code(a, b) for a, b in links]
            assert not len(whole.tail_a.ids) and not len(whole.tail_b.ids)
    assert opened > 0 or size > 60


def wanted(coder, rows):
    found = [(i, *direct(coder, t)) for i, t in rows]
    counts = Counter(p for f in found for p in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (i, n_a, n_b, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest(groups))
        for i, n_a, n_b, links, groups in found
    ]


@pytest.mark.parametrize("chunk", [100, A.CHUNK_BYTES])
def test_aligned_table(spark, coder, edge, chunk, texts):
    odd = [(200 + i, t) for i, t in enumerate(ODD)] + [(300, texts(30, 3000) + "\n" + texts(31, 500)), (300, texts(30, 3000) + "\n" + texts(31, 500)), (301, "\u2581" + texts(32, 300))]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(6)
    got = A.align(docs, *A.default_paths(), chunk=chunk, keep=True).collect()
    want = wanted(coder, [tuple(r) for r in docs.collect()])
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)
    assert all(digest(r["groups"] or "") == r["groups_sha256"] for r in got)


def test_query(spark, coder, edge, tmp_path):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_token_alignment(spark, str(tmp_path))
    assert got.columns == [c.split()[0] for c in A.RESULT.split(", ")]
    want = wanted(coder, [(r["doc_id"], r["text"]) for r in edge.collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(empty):
    assert A.align(empty, *A.default_paths()).count() == 0
