"""Conversation repair: the search against all edit sequences, the job against a plain sequential form."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from tidemark.llm import dialogues as G
from tidemark.llm import queries

SPACES = " \t\n\x0b\x0c\r"


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = text.strip(SPACES)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("ok" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, spare=2):
    """All edit sequences with at most ``spare`` insertions in each place: least (cost, audit, repaired rows)."""
    faults, best = faults_of(rows), None
    choices = []
    for (role, text), fault in zip(rows, faults):
        own = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            own += [(extra, "K", [(role, text)])] + [(1 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append(own)
    inserts = [(5 * n, "I" * n, [(r, "") for r in names]) for n in range(spare + 1) for names in product(("user", "assistant"), repeat=n)]
    options = [inserts]
    for own in choices:
        options += [own, inserts]
    for picked in product(*options):
        out = [m for _, _, made in picked for m in made]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            key = (sum(c for c, _, _ in picked), "".join(a for _, a, _ in picked))
            if best is None or key < best[0]:
                best = key, out
    return best


def plain(rows):
    """Result of one conversation: rows (turn, role, text) in any order, by exhaustive or known-good search."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {r[0] for r in rows if r[0] is not None}
    faults = faults_of([r[1:] for r in rows])
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    codes = "".join(G.code(i, {"ok": G.FINE, "truncated": G.CUT}.get(f, G.GONE)) for i, f in zip(initials, faults))
    cost, audit = forward(codes)
    out, queue, state = [], [r[1:] for r in rows], ""
    for letter in audit:
        after = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((after, ""))
        else:
            role, text = queue.pop(0)
            if letter == "D":
                continue
            out.append((after if letter == "R" else role, text))
        state = out[-1][0][0]
    text = "\n".join(f"{r}:{t}" for r, t in out)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


def forward(codes):
    """Least (cost, audit) by a forward table over (messages read, state)."""

    def relaxed(layer):
        for _ in range(3):
            for q in list(layer):
                to, new = G.NEXT[q], (layer[q][0] + 5, layer[q][1] + "I")
                if to not in layer or new < layer[to]:
                    layer[to] = new
        return layer

    layer = relaxed({G.START: (0, "")})
    for letter in codes:
        after = {}
        for q, (cost, audit) in layer.items():
            for e, c, to in G.STEPS[letter, q]:
                new = (cost + c, audit + e)
                if to not in after or new < after[to]:
                    after[to] = new
        layer = relaxed(after)
    return min(layer[q] for q in G.DONE if q in layer)


@pytest.mark.parametrize("seed", range(25))
def test_search_against_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(12):
        n = rng.randint(0, 3)
        rows = [(rng.choice(["user", "assistant", "system", "tool", "u", ""]), rng.choice(["Yes.", "No", " ", "", "Well!", "So? "])) for _ in range(n)]
        codes = G.Faults().letters(*zip(*[(r, t, t.strip(SPACES)[-1:]) for r, t in rows])) if rows else ""
        (cost, audit), out = cheapest(rows)
        assert G.solve(codes) == (cost, audit), rows
        replay = G.Replay(audit)
        made = list(replay.read([r for r, _ in rows], [t for _, t in rows])) + list(replay._inserted())
        assert [m[1:] for m in made] == out


@pytest.mark.parametrize("seed", range(30))
def test_search_against_a_forward_table(seed):
    rng = random.Random(seed)
    codes = "".join(chr(97 + rng.randrange(12)) for _ in range(rng.randint(0, 120)))
    assert G.solve(codes) == forward(codes)


def test_search_is_linear_in_long_conversations():
    codes = "".join(chr(97 + random.Random(1).randrange(12)) for _ in range(20_000))
    assert G.search(codes, G.START, G.DONE) == forward(codes)


def conversations(seed, long=0):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(30)]:
        n = long if conv == 7 and long else rng.randint(0, 9)
        for turn in range(n):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rng.choice(["Hello there.", "What now?", "It ends", "", "  \n", None, "Même à\tla fin!", "same.", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text, "extra"))
    return rows + rows[:3]


SCHEMA = "conv_id long, turn long, role string, text string, end string"


def wanted(rows):
    held = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        held[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: plain(own) for conv, own in held.items()}


@pytest.mark.parametrize("seed, long, limits", [(1, 0, {}), (2, 300, {"rows": 7}), (3, 60, {"rows": 1}), (4, 120, {"characters": 40})])
def test_repair(spark, seed, long, limits):
    rows = conversations(seed, long)
    messages = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = wanted(rows)
    got = {r["conv_id"]: tuple(r[1:]) for r in G.repair(messages, **limits).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    made = defaultdict(list)
    for r in sorted(G.repaired_messages(messages, **limits).collect(), key=lambda r: r["place"]):
        made[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(made) == {c: w[1] for c, w in want.items() if w[1]}


def test_query(spark, tmp_path):
    rows = conversations(9) + [(100 + i, i, "user", f"One {i}.", "x") for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    hurt = []
    for conv, turn, role, text, _ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        act = zlib.crc32(name.encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        if act:
            hurt += [(conv, turn, "user" if act == 4 else role, text, "")] * (2 if act == 3 else 1)
    want = {c: w[0] for c, w in wanted(hurt).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r["conv_id"]: tuple(r[1:]) for r in queries.op12_dialogue_repair(spark, str(tmp_path)).collect()}
    assert got == {r[0]: want.get(r[0], nothing) for r in rows}
    assert nothing in got.values()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert G.repair(empty).count() == 0 and G.repaired_messages(empty).count() == 0
    assert G.complete(G.repair(empty), empty).count() == 0
