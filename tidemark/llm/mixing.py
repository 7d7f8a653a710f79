"""Mix sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1 (piecewise linear). Its integral is the
source's share of the words; a source is repeated at most ``most`` times, and what it cannot give
is shared out again by weight. Inside a source the documents follow one another in a fixed hash
order; the words of a source are used up at the rate of its schedule, so inverting the cumulative
demand gives each document its training position. All of it is DataFrame expressions.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
ranked last; rows with equal ``doc_id`` are separate documents; where two of them also have equal
size, it does not matter which of the two comes first. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACED_WORD, Scratch

Knots = Sequence[tuple[float, float]]

# Shapes of the schedules, relative to a source's weight; each integrates to 1 over 0..1.
FALLING: Knots = ((0.0, 1.5), (1.0, 0.5))
STEADY: Knots = ((0.0, 1.0), (1.0, 1.0))
LATE: Knots = ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5))

# Rows of one source are ordered by hash; so many hash ranges are summed up independently.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def integral(knots: Knots) -> float:
    """Area under a piecewise-linear schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def pieces(knots: Knots) -> Column:
    """The schedule as an array of segments with their share of demand ``c0..c1``."""
    total, done, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        part = (t1 - t0) * (w0 + w1) / 2 / total
        if part > 0:
            out.append((t0, t1, w0 / total, w1 / total, done, done + part))
        done += part
    names = ("t0", "t1", "s0", "s1", "c0", "c1")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, row)]) for row in out])


def invert(share: Column, segments: Column) -> Column:
    """Time at which the demand ``share`` (0..1) of a schedule has been used up."""
    piece = F.coalesce(
        F.get(F.filter(segments, lambda p: p["c1"] > share), 0), F.element_at(segments, -1)
    )
    span = piece["t1"] - piece["t0"]
    area = share - piece["c0"]
    slope = (piece["s1"] - piece["s0"]) / span
    # Solves s0 * u + slope * u^2 / 2 = area without cancellation, also for slope 0.
    root = F.sqrt(F.greatest(piece["s0"] * piece["s0"] + 2 * slope * area, F.lit(0.0)))
    step = F.when(area <= 0, F.lit(0.0)).otherwise(2 * area / (piece["s0"] + root))
    return piece["t0"] + F.least(step, span)


def source_targets(
    totals: DataFrame, weight: Callable[[Column], Column], total_percent: int, most: int
) -> DataFrame:
    """Target words per source of ``totals`` (source, source_size).

    ``weight`` maps a source's number in code-point order (from 0, null last) to a whole weight.
    Targets are ``level * weight``, but at most ``most`` times the source; the level is found by
    going through the sources from the one that is used up first.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    numbered = totals.withColumn("source_no", F.row_number().over(by_name) - 1)
    limits = numbered.withColumn("weight", weight(F.col("source_no")).cast("long")).withColumn(
        "limit", F.lit(most) * F.col("source_size")
    )
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.lit(total_percent) * F.sum("source_size").over(whole) - 100 * F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = left / (100 * F.sum("weight").over(after))
    leveled = limits.withColumn("level_here", level)
    free = F.col("limit") / F.col("weight") >= F.col("level_here")
    level = F.max(F.when(free, F.col("level_here"))).over(whole)
    target = F.least(level * F.col("weight"), F.col("limit").cast("double"))
    return leveled.select(
        "source", "source_no", "weight", "source_size",
        F.coalesce(target, F.col("limit").cast("double")).alias("target"),
    )


def assign_positions(
    docs: DataFrame,
    weight: Callable[[Column], Column],
    schedule: Callable[[Column], Column],
    total_percent: int = 150,
    most: int = 2,
) -> DataFrame:
    """Add to each row of ``docs`` its ``visits``: (epoch, position, words) in training order.

    ``docs`` has ``doc_id``, ``source`` and ``size`` besides columns that are carried along.
    ``schedule`` maps a source's weight to its segments (see ``pieces``). Added columns:
    source_size, target, visits; a document that is not taken has no visits.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = docs.withColumn("mix_hash", order).withColumn("mix_range", F.substring("mix_hash", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("source", "mix_range").agg(F.sum("size").alias("range_size"))
    totals = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(totals, weight, total_percent, most).withColumn("segments", schedule(F.col("weight")))
    earlier = Window.partitionBy("source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    ledger = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select(
        F.col("s.source").alias("mix_source"), F.col("mix_range").alias("mix_part"),
        "range_start", "source_size", "target", "segments",
    )
    # One hash range of one source to a window: a source with a third of all rows is 4,096 windows.
    inside = Window.partitionBy("source", "mix_range").orderBy("mix_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("offset_in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.expr("source <=> mix_source AND mix_range = mix_part")
    rows = placed.join(ledger, same).withColumn("start", F.col("range_start") + F.col("offset_in_range"))
    quota = F.floor(F.col("target") + 0.5).cast("long")
    rows = rows.withColumn("quota", quota)
    epochs = F.when(F.col("source_size") > 0, F.ceil(F.col("quota") / F.col("source_size"))).otherwise(0)

    def visit(epoch: Column) -> Column:
        at = epoch * F.col("source_size") + F.col("start")
        words = F.least(F.greatest(F.col("quota") - at, F.lit(0)), F.col("size"))
        return F.struct(
            epoch.alias("epoch"), invert(at / F.col("quota"), F.col("segments")).alias("position"), words.alias("words")
        )

    count = F.when(epochs > 0, F.sequence(F.lit(0).cast("long"), epochs.cast("long") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    visits = F.filter(F.transform(count, visit), lambda v: v["words"] > 0)
    return rows.select(*docs.columns, "source_size", "target", visits.alias("visits"))


def training_order(placed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per visit, range-sorted by training position; repeats of a document stay repeats."""
    each = placed.select(*columns, F.explode("visits").alias("visit"))
    return each.orderBy("visit.position", "doc_id", "visit.epoch")


def cycle_weight(number: Column) -> Column:
    """Weights 5, 2, 1, repeating."""
    return F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (number % 3 + 1).cast("int"))


def default_schedule(weight: Column) -> Column:
    """Heavy sources fade, middling ones are steady, light ones come late."""
    return F.when(weight == 5, pieces(FALLING)).when(weight == 2, pieces(STEADY)).otherwise(pieces(LATE))


def mix(spark, docs: DataFrame) -> DataFrame:
    """Positions for ``documents``; sizes are counted once and written, as three passes read them."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return assign_positions(Scratch(spark).write(sized, "mix-sizes"), cycle_weight, default_schedule)
