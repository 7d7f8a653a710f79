"""Repair the turn structure of conversations at the least cost, proved by branch and bound.

A conversation's messages are kept (K), given another role (R) or deleted (D), and empty ones inserted
(I), until the initials of the roles read ``(s?(ua)+)?``. What was written so far matters only through
its last role: nothing, system, user or assistant. A node of the search is (messages read, last role),
a step is one edit.

- The search goes depth first over an explicit stack, edits in the order of their letters.
- Suffix lower bounds: the cost of the rest with the order of edits left open, folded once from
  the last message. A prefix whose cost and bound exceed the incumbent's cost is cut.
- The incumbent is (cost, audit). The bound of the root is its first cost; the first audit that meets it
  is the least in ASCII, because steps are taken in that order.
- A table per node keeps the best prefix that reached it. A worse one is dominated: two prefixes of one
  node have read the same messages, so neither audit is the beginning of the other unless it costs less.

Messages are sorted by range partitions of (conversation, turn, role, text) and read in one stream per
task. A conversation that lies within a task is solved there. One that reaches a task's edge, or has more
messages than a fragment holds, goes on as fragments: each is searched from every last role to every
other, and the tables of neighbours are joined pairwise up a tree, as least (cost, audit) is associative.

Defined results: null ids form one conversation; null turns come first; null roles and texts are one
space; messages with equal turns go by role and text; a text without any character besides white space is
blank; an empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

# Costs of the edits; an undeleted truncated message adds its own.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
# Messages and characters of a fragment; joined at once at each level of the tree.
FRAGMENT_ROWS, FRAGMENT_CHARACTERS, FAN = 4096, 4_000_000, 16
MEMO = 50_000

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the role that a new or relabelled message takes after each
NAMES = {USER: "user", ASSISTANT: "assistant"}
# A message is one letter: its initial and whether it is fine, has to go, or is truncated.
FINE, GONE, CUT = range(3)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}


def code(initial: str, fault: int) -> str:
    return chr(97 + 3 * INITIALS.get(initial, 0) + fault)


def steps(letter: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, next state) for reading a message, in ASCII order."""
    initial, fault = divmod(ord(letter) - 97, 3)
    out = [("D", DELETE, state)]
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        if initial == SYSTEM and state == START or initial in NAMES and initial == NEXT[state]:
            out.append(("K", extra, initial))
        out.append(("R", RELABEL + extra, NEXT[state]))
    return tuple(out)


STEPS = {(chr(97 + c), q): steps(chr(97 + c), q) for c in range(12) for q in STATES}


def suffix_bounds(codes: str, targets: frozenset[int]) -> list[list[int]]:
    """Least cost from (messages read, state) to the end in one of ``targets``."""

    def inserted(row: list[int]) -> list[int]:
        for _ in range(2):  # a third insertion would come back to the first state
            row = [min(c, INSERT + row[NEXT[q]]) for q, c in enumerate(row)]
        return row

    bounds = [inserted([0 if q in targets else NEVER for q in STATES])]
    for letter in reversed(codes):
        after = bounds[-1]
        bounds.append(inserted([min(c + after[to] for _, c, to in STEPS[letter, q]) for q in STATES]))
    bounds.reverse()
    return bounds


def search(codes: str, entry: int, targets: frozenset[int]) -> tuple[int, str] | None:
    """Least (cost, audit) that reads all messages from state ``entry`` and ends in one of ``targets``."""
    bounds, end = suffix_bounds(codes, targets), len(codes)
    least = bounds[0][entry]
    if least >= NEVER:
        return None
    reached: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, int, int, tuple]] = [(0, entry, 0, ())]
    while stack:
        i, state, cost, path = stack.pop()
        if cost + bounds[i][state] > least or reached.get((i, state), NEVER) <= cost:
            continue
        reached[i, state] = cost
        if i == end and state in targets:
            letters = []
            while path:
                path, letter = path
                letters.append(letter)
            return cost, "".join(reversed(letters))
        ahead = [("I", INSERT, NEXT[state], i)]
        if i < end:
            ahead = sorted(ahead + [(e, c, to, i + 1) for e, c, to in STEPS[codes[i], state]], reverse=True)
        # The least letter is pushed last and looked at first.
        stack += [(at, to, cost + c, (path, e)) for e, c, to, at in ahead]
    raise AssertionError("the bound of the root is always met")


DONE = frozenset({START, ASSISTANT})


@lru_cache(maxsize=MEMO)
def _known(codes: str) -> tuple[int, str]:
    found = search(codes, START, DONE)
    assert found is not None  # deleting everything is always possible
    return found


def solve(codes: str) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation; short ones are alike, so they are solved once."""
    return _known(codes) if len(codes) <= 64 else search(codes, START, DONE)  # type: ignore[return-value]


class Replay:
    """Applies an audit to messages that come in parts, and hashes what is left."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.place = audit, 0, START, 0
        self.hash = hashlib.sha256()

    def _out(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.place - 1, role, text

    def _inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield self._out(NAMES[self.state], "")

    def read(self, roles: list[str], texts: list[str]) -> Iterator[tuple[int, str, str]]:
        for role, text in zip(roles, texts):
            yield from self._inserted()
            letter, self.at = self.audit[self.at], self.at + 1
            if letter == "D":
                continue
            if letter == "R":
                self.state = NEXT[self.state]
                role = NAMES[self.state]
            else:
                self.state = INITIALS[role[0]]
            yield self._out(role, text)

    def digest(self) -> str:
        for _ in self._inserted():
            pass
        return self.hash.hexdigest()


class Faults:
    """Letters of messages in order, counting faults, and illegal pairs of neighbours."""

    def __init__(self, seen: set | None = None):
        self.seen = set() if seen is None else seen
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None

    def letters(self, roles: list[str], texts: list[str], ends: list[str], key=lambda role, text: (role, text)) -> str:
        out = []
        for role, text, end in zip(roles, texts, ends):
            initial = role[:1]
            if self.last is not None and self.last + initial not in LEGAL:
                self.illegal += 1
            self.last = initial
            if end == "":
                self.blank += 1
                out.append(code(initial, GONE))
                continue
            name = key(role, text)
            if name in self.seen:
                self.duplicate += 1
                out.append(code(initial, GONE))
                continue
            self.seen.add(name)
            self.truncated += end not in ".!?"
            out.append(code(initial, FINE if end in ".!?" else CUT))
        return "".join(out)


# --- Spark ---------------------------------------------------------------------------------------

SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULTS = [c.split()[0] for c in RESULT.split(", ")]
FRAGMENT = "turns array<long>, roles array<string>, texts array<string>, ends array<string>"
PARTS = f"conv_id long, part int, seq int, closed boolean, {RESULT}, {FRAGMENT}"


def _digest_key(role: str, text: str) -> str:
    """As ``md5`` over ``_named`` in the plan."""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _named(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def gaps_of(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def fragments(messages: DataFrame, rows: int = FRAGMENT_ROWS, characters: int = FRAGMENT_CHARACTERS, keep: bool = False) -> DataFrame:
    """Solved conversations, and fragments (in order of part, seq) of those that a task does not hold.

    ``keep`` leaves the messages of solved ones in, too.
    """
    plain = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("end", F.expr(f"right(trim(TRAILING {SPACE} FROM text), 1)"))
    # The beginning of the text splits a turn of very many messages and keeps the sampled keys small.
    ordered = plain.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("closed", pa.bool_())]
        + [(c, pa.int64()) for c in RESULTS[:6]] + [(c, pa.string()) for c in RESULTS[6:]]
        + [("turns", pa.list_(pa.int64()))] + [(c, pa.list_(pa.string())) for c in ("roles", "texts", "ends")]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, size = TaskContext.get().partitionId(), 0, [], 0
        conv, held, length, pieces, first = None, ([], [], [], []), 0, 0, True

        def emit(last: bool, edge: bool) -> None:
            """Close the held fragment: solve it if it is a whole conversation."""
            nonlocal seq, held, length, pieces, size
            turns, roles, texts, ends = held
            row = dict(conv_id=conv, part=part, seq=seq, closed=last and not edge and not pieces)
            if row["closed"]:
                faults = Faults()
                cost, audit = solve(faults.letters(roles, texts, ends))
                replay = Replay(audit)
                for _ in replay.read(roles, texts):
                    pass
                row |= dict(
                    gaps=gaps_of(turns), blank=faults.blank, duplicate=faults.duplicate, truncated=faults.truncated,
                    illegal=faults.illegal, cost=cost, audit=audit, repaired_sha256=replay.digest(),
                )
            if keep or not row["closed"]:
                row |= dict(turns=turns, roles=roles, texts=texts, ends=ends)
                size += length
            out.append(row)
            seq, held, length, pieces = seq + 1, ([], [], [], []), 0, pieces + 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "end")]
            for key, *message in zip(*columns):
                if held[0] and (key != conv or len(held[0]) >= rows or length >= characters):
                    emit(key != conv, first)
                if key != conv:
                    # Only the first conversation of a task may have begun in another.
                    first, pieces = first and seq == 0, 0
                conv = key
                for values, value in zip(held, message):
                    values.append(value)
                length += len(message[2])
                if len(out) >= 2000 or size > characters:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if held[0]:
            emit(True, True)  # the last one may go on in the next task
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(cut, PARTS)


MOVES = "moves array<struct<entry:int,exit:int,cost:long,audit:string>>"
STATE = f"conv_id long, part int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct long, {MOVES}"


def transitions(pieces: DataFrame) -> DataFrame:
    """Searches of every fragment between all states; duplicates of earlier fragments are known."""
    named = pieces.select(
        "conv_id", "part", "seq",
        F.explode(F.array_distinct(F.zip_with("roles", "texts", _named))).alias("name"),
    )
    begun = named.groupBy("conv_id", "name").agg(F.min(F.struct("part", "seq")).alias("begun")).select(
        F.col("conv_id").alias("c"), F.col("name").alias("n"), "begun"
    )
    again = named.join(begun, F.expr("conv_id <=> c AND name = n")).filter(F.struct("part", "seq") > F.col("begun"))
    known = again.groupBy("conv_id", "part", "seq").agg(F.collect_list("name").alias("known")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s"), "known"
    )
    both = pieces.join(known, F.expr("conv_id <=> c AND part = p AND seq = s"), "left")

    def searched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                faults = Faults(set() if r.known is None else set(r.known))
                codes = faults.letters(r.roles, r.texts, r.ends, _digest_key)
                moves = []
                for entry in STATES:
                    for exit in STATES:
                        found = search(codes, entry, frozenset({exit}))
                        if found:
                            moves.append({"entry": entry, "exit": exit, "cost": found[0], "audit": found[1]})
                turns = [int(t) for t in r.turns if t is not None and t == t]
                out.append((
                    r.conv_id, r.part, r.seq, faults.blank, faults.duplicate, faults.truncated, faults.illegal, r.roles[0][:1],
                    r.roles[-1][:1], min(turns, default=None), max(turns, default=None), len(set(turns)), moves,
                ))
            names = ["conv_id", "part", "seq", *[c.split()[0] for c in STATE.split(", ")[2:11]], "moves"]
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({c: "Int64" for c in ("conv_id", "low", "high")})

    return both.select("conv_id", "part", "seq", "turns", "roles", "texts", "ends", "known").mapInPandas(
        searched, STATE.replace("part int", "part int, seq int")
    )


def joined(parts: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring fragments as one; associative."""
    rows = list(parts.itertuples(index=False))
    total = rows[0]._asdict()
    total["moves"] = {(m["entry"], m["exit"]): (m["cost"], m["audit"]) for m in total["moves"]}
    for r in rows[1:]:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            total[name] += getattr(r, name)
        total["illegal"] += total["last"] + r.first not in LEGAL
        # Turns ascend: only the turn at the seam can be counted twice.
        if not pd.isna(r.low):
            total["distinct"] += r.distinct - (not pd.isna(total["high"]) and total["high"] == r.low)
            total["low"] = r.low if pd.isna(total["low"]) else total["low"]
            total["high"] = r.high
        total["last"] = r.last
        moves: dict = {}
        for (entry, middle), (cost, audit) in total["moves"].items():
            for m in r.moves:
                if m["entry"] == middle:
                    key, new = (entry, m["exit"]), (cost + m["cost"], audit + m["audit"])
                    if key not in moves or new < moves[key]:
                        moves[key] = new
        total["moves"] = moves
    total["moves"] = [{"entry": a, "exit": b, "cost": c, "audit": t} for (a, b), (c, t) in total["moves"].items()]
    names = [c.split()[0] for c in STATE.split(", ")[:11]] + ["moves"]
    return pd.DataFrame([total])[names].astype({c: "Int64" for c in ("conv_id", "low", "high")})


def composed(state: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """One row per conversation from its fragments: those of a task first, then ``fan`` tasks, and so on."""
    level = state.groupBy("conv_id", "part").applyInPandas(lambda p: joined(p.sort_values("seq").drop(columns="seq")), STATE)
    width = 1
    while width < parts:
        width *= fan
        grouped = level.withColumn("g", F.floor(F.col("part") / width))
        level = grouped.groupBy("conv_id", "g").applyInPandas(lambda p: joined(p.sort_values("part").drop(columns="g")), STATE)
    return level


def replayed(pieces: DataFrame, audits: DataFrame, messages: bool) -> DataFrame:
    """Audits applied to fragments in order: the repaired messages, or their digest per conversation.

    A digest reads its conversation from the first to the last byte, so one task has it; it is a stream
    that holds one fragment at a time.
    """
    head = audits.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("seq"), "audit", *[F.lit(None).cast("array<string>").alias(c) for c in ("roles", "texts")])
    body = pieces.select("conv_id", "part", "seq", F.lit(None).cast("string").alias("audit"), "roles", "texts")
    ordered = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Replay | None = None
        conv = None

        def end() -> list[dict]:
            if now is None:
                return []
            left = [dict(conv_id=conv, place=p, role=r, text=t) for p, r, t in now._inserted()]
            return left if messages else [dict(conv_id=conv, place=None, role=None, text=now.digest())]

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] == -1:
                    out = end()
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                    now, conv = Replay(row["audit"]), row["conv_id"]
                    continue
                out = [dict(conv_id=conv, place=p, role=r, text=t) for p, r, t in now.read(row["roles"], row["texts"])]
                if messages and out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(read, "conv_id long, place long, role string, text string")


def _open_results(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Results of the conversations that came as fragments."""
    parts = pieces.agg(F.max("part")).first()[0]
    if parts is None:
        return pieces.select("conv_id", *RESULTS)
    state = composed(transitions(pieces), parts + 1)
    best = F.array_min(F.transform(
        F.filter("moves", lambda m: (m["entry"] == START) & m["exit"].isin(*DONE)),
        lambda m: F.struct(m["cost"].alias("cost"), m["audit"].alias("audit")),
    ))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0))
    solved = scratch.write(
        state.withColumn("best", best).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit"),
        "solved",
    )
    digests = replayed(pieces, solved, messages=False).select(F.col("conv_id").alias("c"), F.col("text").alias("repaired_sha256"))
    return solved.join(digests, F.expr("conv_id <=> c")).select("conv_id", *RESULTS)


def repair(messages: DataFrame, **limits) -> DataFrame:
    """Faults, cost and audit of every conversation of ``messages`` (conv_id, turn, role, text)."""
    scratch = Scratch(messages.sparkSession)
    found = scratch.write(fragments(messages, **limits), "dialogues")
    closed = found.filter("closed").select("conv_id", *RESULTS)
    return closed.unionByName(_open_results(found.filter("NOT closed"), scratch))


def repaired_messages(messages: DataFrame, **limits) -> DataFrame:
    """(conv_id, place, role, text): the messages after repair, by place from 0."""
    scratch = Scratch(messages.sparkSession)
    found = scratch.write(fragments(messages, keep=True, **limits), "dialogues")
    opened = found.filter("NOT closed")
    audits = found.filter("closed").select("conv_id", "audit").unionByName(_open_results(opened, scratch).select("conv_id", "audit"))
    return replayed(found, audits, messages=True)


def complete(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Results for all of ``ids`` (conv_id), with zeros for conversations that have no messages left."""
    wanted = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    found = results.withColumnRenamed("conv_id", "c")
    return wanted.join(found, F.expr("conv_id <=> c"), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(nothing[c]) if c in nothing else F.lit(0).cast("long")).alias(c) for c in RESULTS]
    )
