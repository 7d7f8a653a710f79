"""From a corpus to documents that every experiment reads."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stoplists import GENERAL, PROFILES
from tidemark.functions.text import clean_tokens, clean_tokens_by_profile
from tidemark.operators.split import hash_part


def prepare(
    corpus: DataFrame,
    general: Iterable[str] = GENERAL,
    profile: Mapping[str, str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """(domain, doc_id, label, part, tokens) out of (domain, doc_id, raw_text, label).

    ``profile`` names the domain stop list of each domain that has one.
    """
    raw = F.col("raw_text")
    if profile:
        lists = {d: PROFILES[p] for d, p in profile.items()}
        tokens = clean_tokens_by_profile(raw, F.col("domain"), general, lists)
    else:
        tokens = clean_tokens(raw, general)
    return corpus.select("domain", "doc_id", "label", hash_part(F.col("doc_id"), seed).alias("part"), tokens.alias("tokens"))
