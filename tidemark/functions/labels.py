"""Label mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_values(col: Column, mapping: Mapping[int, int]) -> Column:
    """Replace values by a fixed mapping; values without an entry become NULL."""
    out = F.lit(None).cast("int")
    for source, target in mapping.items():
        out = F.when(col == source, F.lit(target)).otherwise(out)
    return out.cast("int")


def code_of(col: Column, classes: Sequence[str]) -> Column:
    """Index of a value among the sorted ``classes``; NULL for other values."""
    position = F.array_position(F.array(*[F.lit(c) for c in sorted(classes)]), col)
    return F.when(position > 0, (position - 1).cast("int"))


def above(score: Column, threshold: float = 0.5) -> Column:
    """1 where the score lies above the threshold, else 0."""
    return (score > threshold).cast("int")
