"""Cleaning and tokenizing as native column expressions; no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of a Unicode text. Spelled out, because the short form means ASCII only in some
# regex dialects. Single characters and one category keep the class to three tests per
# character; long unions of ranges are several times slower and do not scale over threads.
WHITE_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}"
# A tag is the shortest <...> on one line.
TAG = r"<[^>\n]*>"
NOT_LETTER_OR_SPACE = f"[^a-z{WHITE_SPACE}]+"
# After the step above only letters and white space are left.
GAP = "[^a-z]+"


def letters_only(text: Column) -> Column:
    """Lower-case, drop tags, then drop everything but a-z and white space."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.regexp_replace(lowered, TAG, ""), NOT_LETTER_OR_SPACE, "")


def clean_tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Cleaned tokens of a raw text, without the stop words; missing text gives none.

    The word list becomes a hash set at planning time, so a token costs one lookup.
    """
    words = sorted(set(stop_words))
    raw = F.split(letters_only(text), GAP)
    if not words:
        return F.filter(raw, lambda w: w != "")
    return F.filter(raw, lambda w: (w != "") & ~w.isin(words))


def clean_tokens_by_profile(
    text: Column, profile: Column, general: Iterable[str], lists: dict[str, Iterable[str]]
) -> Column:
    """As ``clean_tokens``, with the general list joined to the list named by ``profile``."""
    base = set(general)
    out = None
    for name, words in sorted(lists.items()):
        tokens = clean_tokens(text, base | set(words))
        out = F.when(profile == name, tokens) if out is None else out.when(profile == name, tokens)
    fallback = clean_tokens(text, base)
    return fallback if out is None else out.otherwise(fallback)


def join_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def long_tokens(tokens: Column, min_length: int = 2) -> Column:
    """Tokens the vectorizers see: two or more letters."""
    return F.filter(tokens, lambda w: F.length(w) >= min_length)


def pad_front(sequence: Column, size: int = 100) -> Column:
    """Keep the last ``size`` entries and fill up with zeros at the front."""
    length = F.size(sequence)
    tail = F.slice(sequence, F.greatest(length - size + 1, F.lit(1)), F.lit(size))
    return F.concat(F.array_repeat(F.lit(0), F.greatest(size - length, F.lit(0))), tail)
