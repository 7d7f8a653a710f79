"""Linear SVMs that leave out one inner fold each, all fitted in the same passes.

Training rows are packed once into blocks of (column, value) entries; a constant column and a column with the
sign of the label follow the features. The products of all columns, summed over the rows inside the margin, then
hold the normal equations of the next step. They are summed once per inner fold for all models; afterwards only
rows that enter or leave the margin are added or taken off, unless fewer rows are left inside it.
The driver holds these sums and the coefficients: their size follows features and models, never rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import collected, tidy

# Step lengths tried along a Newton direction.
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
# Rows of a block and rows that are multiplied at a time; sums that are added up by one task.
BLOCK_ROWS, PRODUCT_ROWS, SUMS = 1024, 2048, 8


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries per row, their columns and their values, of unwrapped vectors, sparse or dense."""
    lists = vectors.field("values")
    sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    columns = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    sparse = np.asarray(vectors.field("type")) == 0
    columns[np.repeat(sparse, sizes)] = np.asarray(vectors.field("indices").flatten())
    return sizes, columns.astype(np.int32), np.asarray(lists.flatten()).astype(float)


def products(sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of value times weight per row, the same for a row whatever rows and models are beside it."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values * weights[columns], (np.cumsum(sizes) - sizes)[some])
    return out


@dataclass(frozen=True)
class LinearMargin:
    """A linear score, evaluated inside the row."""

    features: str
    coefficients: np.ndarray
    intercept: float

    def add(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, F.get(margins_of([self]), F.lit(0)))


def margins_of(margins: Sequence[LinearMargin]) -> Column:
    """Array of the scores of models on one and the same vector column."""
    weights, shifts = [m.coefficients for m in margins], [m.intercept for m in margins]

    def score(vectors: pa.Array) -> pa.Array:
        rows = entries(vectors)
        found = np.stack([products(*rows, w) + b for w, b in zip(weights, shifts)], axis=1)
        ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(weights))
        return pa.ListArray.from_arrays(ends, pa.array(found.ravel()))

    return F.arrow_udf(score, "array<double>")(F.unwrap_udt(F.col(margins[0].features)))


# --- blocks --------------------------------------------------------------------------------------

BLOCK = "sizes binary, columns binary, values binary, folds binary"
KINDS = {"sizes": np.int64, "columns": np.int32, "values": np.float64, "folds": np.int32}


class Block:
    """Entries of some rows; the last one of a row is the sign of its label (0: no label), the one before a constant."""

    def __init__(self, row: dict, width: int):
        self.sizes, self.columns, self.values, self.folds = (np.frombuffer(row[c], k) for c, k in KINDS.items())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.signs, self.width = self.values[self.starts + self.sizes - 1], width

    def margin(self, w: np.ndarray) -> np.ndarray:
        return products(self.sizes, self.columns, self.values, np.append(w, 0.0))

    def inside(self, margin: np.ndarray, left: int) -> np.ndarray:
        """Rows inside the margin that a model without the inner fold ``left`` is trained on."""
        return (self.signs != 0) & (self.folds != left) & (self.signs * margin < 1)

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, starts = self.sizes[chosen], self.starts[chosen]
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return sizes, self.columns[at], self.values[at]


def packed(rows: DataFrame, features: str, fold: Column, width: int) -> DataFrame:
    """Blocks of rows with a vector and a label; ``width`` counts the features."""
    schema = pa.schema([(c, pa.binary()) for c in KINDS])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                # Taken, so that lists of a slice start at 0.
                own, columns, values = entries(part.column("vector").take(pa.array(np.arange(part.num_rows))))
                sizes, ends = own + 2, np.cumsum(own + 2)
                every, weights = np.empty(sizes.sum(), np.int32), np.empty(sizes.sum())
                place = np.arange(len(columns)) + 2 * np.repeat(np.arange(len(own)), own)
                every[place], weights[place] = columns, values
                every[ends - 2], weights[ends - 2] = width, 1.0
                every[ends - 1], weights[ends - 1] = width + 1, np.asarray(part.column("sign"))
                data = (sizes, every, weights, np.asarray(part.column("fold")).astype(np.int32))
                yield pa.RecordBatch.from_pylist([{c: d.tobytes() for c, d in zip(KINDS, data)}], schema=schema)

    sign = F.coalesce((2 * F.col("label") - 1).cast("double"), F.lit(0.0))
    slim = rows.select(F.unwrap_udt(F.col(features)).alias("vector"), sign.alias("sign"), fold.alias("fold"))
    return slim.mapInArrow(pack, BLOCK)


class SumOfProducts:
    """Products of all columns, summed over rows that are added or taken off. Few rows are kept as they are until
    there are enough to be multiplied, and sent so if that is less."""

    def __init__(self, width: int):
        self.width, self.sum = width, None
        self.held: dict[int, list] = {1: [], -1: []}

    def add(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], sign: int) -> None:
        self.held[sign].append(rows)
        if sum(len(sizes) for sizes, _, _ in self.held[sign]) >= PRODUCT_ROWS:
            self.multiply(sign)

    def multiply(self, sign: int) -> None:
        if not self.held[sign]:
            return
        sizes, columns, values = (np.concatenate(c) for c in zip(*self.held[sign]))
        self.held[sign] = []
        first, ends = 0, np.cumsum(sizes)
        while first < len(sizes):
            some = sizes[first : first + PRODUCT_ROWS]
            span = slice(ends[first] - sizes[first], ends[first + len(some) - 1])
            dense = np.zeros((len(some), self.width))
            dense[np.repeat(np.arange(len(some)), some), columns[span]] = values[span]
            self.grow(sign * (dense.T @ dense))
            first += len(some)

    def grow(self, more: np.ndarray) -> None:
        if self.sum is None:
            self.sum = more
        else:
            self.sum += more

    def take(self, message: dict) -> None:
        """Add what another one sent."""
        if message["products"] is not None:
            self.grow(unfolded(np.frombuffer(message["products"]), self.width))
        sizes = np.frombuffer(message["sizes"], np.int64)
        if len(sizes):
            columns, values = np.frombuffer(message["columns"], np.int32), np.frombuffer(message["values"])
            for sign in (1, -1):
                own = np.sign(sizes) == sign
                span = np.repeat(own, np.abs(sizes))
                if own.any():
                    self.add((np.abs(sizes[own]), columns[span], values[span]), sign)

    def message(self, whole: bool = False) -> dict:
        entry_bytes = sum(12 * len(v) + 8 * len(s) for rows in self.held.values() for s, _, v in rows)
        if whole or self.sum is not None or entry_bytes >= 4 * self.width * (self.width + 1):
            for sign in self.held:
                self.multiply(sign)
        rows = [(sign * s, c, v) for sign, held in self.held.items() for s, c, v in held]
        sizes, columns, values = (b"".join(a[i].tobytes() for a in rows) for i in range(3))
        return {"products": None if self.sum is None else folded(self.sum).tobytes(), "sizes": sizes, "columns": columns, "values": values}


def folded(matrix: np.ndarray) -> np.ndarray:
    """The upper half of a symmetric matrix."""
    return matrix[np.triu(np.ones(matrix.shape, bool))]


def unfolded(half: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu(np.ones(out.shape, bool))] = half
    return out + np.triu(out, 1).T


# --- passes --------------------------------------------------------------------------------------

Choice = Callable[[Block], Iterable[tuple[int, int, np.ndarray]]]
MESSAGE = "model int, part int, products binary, sizes binary, columns binary, values binary"


class Passes:
    """Training blocks that are read again and again."""

    def __init__(self, rows: DataFrame, features: str, fold: Column, width: int):
        self.width, self.features = width, features
        with tidy(rows.sparkSession):
            self.blocks = packed(rows, features, fold, width).persist(StorageLevel.MEMORY_AND_DISK)
        self.context = rows.sparkSession.sparkContext
        self.tasks = self.blocks.rdd.getNumPartitions()

    def close(self) -> None:
        self.blocks.unpersist()

    def read(self, work: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return work(Block(row, width) for batch in batches for row in batch.to_pylist())

        return self.blocks.mapInArrow(run, schema)

    def products(self, choice: Choice) -> dict[int, np.ndarray]:
        """Per model, upper half of the products of all columns, summed over its chosen rows: ``choice`` (block) names
        (model, 1 or -1, rows), once or twice per model."""
        width = self.width + 2
        schema = pa.schema([("model", pa.int32()), ("part", pa.int32())] + [(c, pa.binary()) for c in ("products", "sizes", "columns", "values")])

        def work(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, SumOfProducts] = {}
            for block in blocks:
                for model, sign, chosen in choice(block):
                    if chosen.any():
                        sums.setdefault(model, SumOfProducts(width)).add(block.rows(np.flatnonzero(chosen)), sign)
            part = TaskContext.get().partitionId()
            for model in list(sums):
                message = sums.pop(model).message()
                yield pa.RecordBatch.from_pylist([{"model": model, "part": part} | message], schema=schema)

        def added(group: pd.DataFrame, whole: bool) -> pd.DataFrame:
            total = SumOfProducts(width)
            for row in group.to_dict("records"):
                total.take(row)
            return pd.DataFrame([{"model": group["model"].iloc[0], "part": group["part"].iloc[0]} | total.message(whole)])

        partial, groups = self.read(work, MESSAGE), self.tasks
        while groups > SUMS:
            groups = -(-groups // SUMS)
            dealt = partial.withColumn("part", F.col("part") % groups)
            partial = dealt.groupBy("model", "part").applyInPandas(lambda g: added(g, False), MESSAGE)
        found = collected(partial.groupBy("model").applyInPandas(lambda g: added(g, True), MESSAGE).select("model", "products"))
        return {r["model"]: np.frombuffer(r["products"]) for r in found}

    def along(self, lines: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
        """Per model (fold left out, start, end): loss, rows inside the margin and rows that cross it, after each of ``STEPS``."""
        shared = self.context.broadcast(lines)
        names = "model int, sums array<double>"
        schema = pa.schema([("model", pa.int32()), ("sums", pa.list_(pa.float64()))])

        def work(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            sums = {j: np.zeros((len(STEPS), 3)) for j in shared.value}
            for block in blocks:
                for j, (left, start, end) in shared.value.items():
                    used = (block.signs != 0) & (block.folds != left)
                    here, there = block.margin(start), block.margin(end)
                    before = block.inside(here, left)
                    for i, step in enumerate(STEPS):
                        slack = 1 - block.signs * ((1 - step) * here + step * there)
                        now = used & (slack > 0)
                        sums[j][i] += (slack[now] @ slack[now], now.sum(), (now != before).sum())
            yield pa.RecordBatch.from_pylist([{"model": j, "sums": s.ravel().tolist()} for j, s in sums.items()], schema=schema)

        out = {j: np.zeros((len(STEPS), 3)) for j in lines}
        for r in self.read(work, names).collect():
            out[r["model"]] += np.reshape(r["sums"], (len(STEPS), 3))
        shared.destroy()
        return out

    def held_out(self, weights: dict[int, np.ndarray]) -> DataFrame:
        """(fold, label, m): the margin of every row by the model that left out its fold."""
        schema = pa.schema([("fold", pa.int32()), ("label", pa.float64()), ("m", pa.float64())])

        def work(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                for left, w in weights.items():
                    own = block.folds == left
                    signs, m = block.signs[own], block.margin(w)[own]
                    label = pa.array((signs + 1) / 2, mask=signs == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), left, np.int32)), label, pa.array(m)], schema=schema)

        return self.read(work, "fold int, label double, m double")


# --- descent -------------------------------------------------------------------------------------


@dataclass
class Descent:
    left: int  # inner fold that is left out
    half: np.ndarray  # upper half of the products of all columns over the rows inside the margin
    w: np.ndarray = field(init=False)
    objective: float = math.inf
    done: bool = False


def ridge(products: np.ndarray, penalty: float) -> np.ndarray | None:
    """Coefficients and intercept that minimize 1/2 |w|^2 + penalty * sum (y - f(x))^2, or None if one class is left."""
    x, y = products[:-1, :-1], products[:-1, -1]
    if x[-1, -1] <= abs(y[-1]):
        return None
    system = 2 * penalty * x
    system[np.diag_indices(len(x) - 1)] += 1
    scale = 1 / np.sqrt(np.diag(system))
    return scale * np.linalg.solve(system * scale[:, None] * scale[None, :], 2 * penalty * y * scale)


def svm_weights(passes: Passes, folds: int, left: Sequence[int], penalty: float, rounds: int, tolerance: float) -> list[np.ndarray]:
    """Coefficients and intercept of an SVM without each inner fold of ``left`` (-1: with all rows)."""
    width = passes.width + 2
    zeros = np.zeros(width * (width + 1) // 2)
    # All rows are inside the margin of no coefficients: one sum per fold serves all models.
    by_fold = passes.products(lambda block: [(k, 1, (block.signs != 0) & (block.folds == k)) for k in range(folds)])
    total = sum(by_fold.values(), zeros)
    models = [Descent(f, total - by_fold.get(f, 0.0)) for f in left]
    del by_fold, total
    for model in models:
        model.w = np.zeros(width - 1)
        model.objective = penalty * unfolded(model.half, width)[-2, -2]
    for _ in range(rounds):
        ends = {}
        for j, model in enumerate(models):
            end = None if model.done else ridge(unfolded(model.half, width), penalty)
            model.done = end is None
            if end is not None:
                ends[j] = (model.left, model.w, end)
        if not ends:
            return [m.w for m in models]
        fresh, crossed = {}, {}
        for j, found in passes.along(ends).items():
            model, (_, start, end) = models[j], ends[j]
            points = [(1 - step) * start + step * end for step in STEPS]
            values = [0.5 * float(p[:-1] @ p[:-1]) + penalty * loss for p, loss in zip(points, found[:, 0])]
            best = min(range(len(STEPS)), key=values.__getitem__)
            gain = model.objective - values[best]
            if gain <= 0:
                model.done = True
                continue
            model.w, model.objective = points[best], values[best]
            model.done = gain <= tolerance * values[best]
            if not model.done:
                (fresh if found[best, 1] <= found[best, 2] else crossed)[j] = (model.left, start, model.w)
        if not fresh and not crossed:
            return [m.w for m in models]
        shared = passes.context.broadcast((fresh, crossed))

        def choice(block: Block) -> Iterator[tuple[int, int, np.ndarray]]:
            fresh, crossed = shared.value
            for j, (fold, _, w) in fresh.items():
                yield j, 1, block.inside(block.margin(w), fold)
            for j, (fold, before, w) in crossed.items():
                was, now = block.inside(block.margin(before), fold), block.inside(block.margin(w), fold)
                yield j, 1, now & ~was
                yield j, -1, was & ~now

        sums = passes.products(choice)
        shared.destroy()
        for j in (*fresh, *crossed):
            models[j].half = sums.get(j, zeros) + (models[j].half if j in crossed else 0.0)
    if not all(m.done for m in models):
        warnings.warn(f"the linear SVM still improves after {rounds} steps", stacklevel=3)
    return [m.w for m in models]
