"""Find short licence notices, exact or with a few edits.

A notice may differ from its model by ``k`` edits. Cut into ``k + 1`` pieces, at least one piece then
stands in the text unchanged, so one pass of an automaton over all pieces finds every place where a
notice can be. Only there, the ``regex`` library matches the whole notice with at most ``k`` errors
and tells the span and the edits. Phrases that must match exactly are notices with ``k = 0``.

Texts are compared as their words (ASCII letters lower-cased), joined by single spaces. Where spans
of different notices overlap, the one with the fewest edits stays, then the longer, then the first
of the list; exact phrases always stay, and a span that overlaps one is part of it.

Defined results: a null or empty text has no words and no spans; rows with equal ``doc_id`` are
scanned separately; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

# One edit is allowed for so many characters of a notice.
CHARACTERS_PER_EDIT = 10


class Notice(NamedTuple):
    label: str
    text: str
    exact: bool = False


BASE = (
    Notice("mit", "under the mit license", True),
    Notice("apache-2", "apache license version 2", True),
    Notice("cc-by-nc", "cc by nc", True),
)
NOTICES = (
    Notice("mit", "released under the mit license"),
    Notice("mit", "licensed under the mit license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("apache-2", "licensed under the apache license version 2 0"),
    Notice("gpl-2", "licensed under the gnu general public license version 2"),
    Notice("gpl-3", "licensed under the gnu general public license version 3"),
    Notice("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    Notice("agpl-3", "licensed under the gnu affero general public license version 3"),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification"),
    Notice("bsd", "licensed under the bsd license"),
    Notice("cc-by", "licensed under cc by 4 0"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0"),
    Notice("cc-by-nc", "licensed under cc by nc 4 0"),
    Notice("cc0", "to the extent possible under law the author has waived all copyright"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
)


class Span(NamedTuple):
    label: str
    first: int  # word numbers, end exclusive
    stop: int
    edits: int
    length: int
    exact: bool


class NoticeSearch:
    def __init__(self, notices: Sequence[Notice], per_edit: int = CHARACTERS_PER_EDIT):
        self.notices = tuple(notices)
        self.edits = [0 if n.exact else len(n.text) // per_edit for n in notices]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """All pieces; each knows its (notice, place in it). Exact phrases include word bounds."""
        places: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            if notice.exact:
                places.setdefault(f" {notice.text} ", []).append((n, 0))
                continue
            cuts = [len(notice.text) * i // (self.edits[n] + 1) for i in range(self.edits[n] + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(notice.text[a:b], []).append((n, a))
        found = ahocorasick.Automaton()
        for piece, where in places.items():
            found.add_word(piece, (len(piece), where))
        found.make_automaton()
        return found

    @cached_property
    def patterns(self) -> list:
        return [
            regex.compile(f"(?:{regex.escape(n.text, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH)
            for n, k in zip(self.notices, self.edits)
        ]

    def __getstate__(self):
        return {"notices": self.notices, "edits": self.edits}

    def spans(self, words: list[str]) -> list[Span]:
        text = f" {' '.join(words)} "
        exact, near = [], {}
        for end, (length, where) in self.automaton.iter(text):
            start = end + 1 - length
            for n, at in where:
                if self.notices[n].exact:
                    exact.append((start + 1, end, n))
                else:
                    near.setdefault(n, []).append(start - at)
        found = [(a, b, n, 0) for a, b, n in exact]
        for n, starts in near.items():
            size, k, done = len(self.notices[n].text), self.edits[n], -1
            for start in sorted(set(starts)):
                # Every match with this piece in place lies in the window; windows that overlap grow
                # into the next search, which starts behind the last match.
                low, high = max(start - k, done, 0), start + size + 2 * k
                if low >= high:
                    continue
                match = self.patterns[n].search(text, low, min(high, len(text)))
                if match:
                    found.append((match.start(), match.end(), n, sum(match.fuzzy_counts)))
                    done = match.end()
        return self._resolved(text, found)

    def _resolved(self, text: str, found: list[tuple[int, int, int, int]]) -> list[Span]:
        order = sorted(found, key=lambda s: (not self.notices[s[2]].exact, s[3], s[0] - s[1], s[2], s[0]))
        kept: list[tuple[int, int, int, int]] = []
        for a, b, n, e in order:
            notice = self.notices[n]
            if notice.exact or not any(a < k[1] and k[0] < b for k in kept):
                kept.append((a, b, n, e))
        out, at, words = [], 0, -1
        for a, b, n, e in sorted(kept):
            words += text.count(" ", at, a)
            at = a
            first = words if text[a] != " " else words + 1
            inside = len(text[a:b].split())
            out.append(Span(self.notices[n].label, first, first + inside, e, len(self.notices[n].text), self.notices[n].exact))
        return out


FOUND = "doc_id long, n_words long, spans array<struct<label:string,first:long,stop:long,edits:int,length:int,exact:boolean>>"


def scan_licenses(docs: DataFrame, notices: Sequence[Notice] = BASE + NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its word count and the spans found."""
    search = NoticeSearch(notices)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, spans = [], []
            for text in batch["text"]:
                words = WORD.findall(text.translate(LOWER))
                counts.append(len(words))
                spans.append([s._asdict() for s in search.spans(words)] if words else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": counts, "spans": spans})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(rows, FOUND)
