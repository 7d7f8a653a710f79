"""Terms that meet a table held by every task, inside the row: vocabulary entries, weights and sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_set(table: DataFrame, by: str) -> dict[str, pa.Table]:
    rows = table.toArrow()
    return {name: rows.filter(pc.equal(rows.column(by), name)) for name in set(rows.column(by).to_pylist())}


def with_vocabulary(rows: DataFrame, words: DataFrame, by: str) -> DataFrame:
    """``rows`` (by, terms, ...) with ``ranks``, ``counts`` and normed ``weights`` of the vocabulary of its set.

    ``words`` is (by, term, at, idf). A set's words are held by every task, so a document finds its own inside its row.
    """
    own = {
        name: (mine.column("term").combine_chunks(), np.asarray(mine.column("at")).astype(np.int64), np.asarray(mine.column("idf")))
        for name, mine in _by_set(words.select(by, "term", "at", "idf"), by).items()
    }
    shared = rows.sparkSession.sparkContext.broadcast(own)
    names = ("ranks", "counts", "weights")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, trains = batch.column("terms"), np.array(batch.column(by).to_pylist())
            sizes = np.diff(np.asarray(lists.offsets))
            flat, doc = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
            term, tf = flat.field("term").dictionary_encode(), np.asarray(flat.field("tf")).astype(float)
            code, at, idf = np.asarray(term.indices).astype(np.int64), np.full(len(tf), -1), np.zeros(len(tf))
            for name in set(trains) & set(shared.value):
                entries, ranks, weights = shared.value[name]
                place = np.asarray(pc.index_in(term.dictionary, value_set=entries).fill_null(-1)).astype(np.int64)
                mine = np.flatnonzero((trains == name)[doc])
                mine = mine[place[code[mine]] >= 0]
                at[mine], idf[mine] = ranks[place[code[mine]]], weights[place[code[mine]]]
            rows = np.flatnonzero(at >= 0)
            rows = rows[np.lexsort((tf[rows] * idf[rows], tf[rows], at[rows], doc[rows]))]
            raw, own = tf[rows] * idf[rows], doc[rows]
            norm = np.sqrt(np.bincount(own, weights=raw * raw, minlength=len(sizes)))
            offsets = pa.array(np.searchsorted(own, np.arange(len(sizes) + 1)).astype(np.int32))
            columns = at[rows].astype(np.int32), tf[rows], raw / norm[own]
            found = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *names])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return rows.mapInArrow(find, f"{kinds}, ranks array<int>, counts array<double>, weights array<double>")


def with_term_sums(rows: DataFrame, table: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """``rows`` (by, terms, ...) with the sum of ``tf`` times each of ``values`` over the terms known to its set, in
    place of the terms; zeros without any. ``table`` is (by, term, values) with one row per set and term."""
    own = {
        name: (mine.column("term").combine_chunks(), np.stack([np.asarray(mine.column(v)).astype(float) for v in values], axis=1))
        for name, mine in _by_set(table.select(by, "term", *values), by).items()
    }
    shared = rows.sparkSession.sparkContext.broadcast(own)
    others = [c for c in rows.columns if c != "terms"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, names = batch.column("terms"), np.array(batch.column(by).to_pylist())
            sizes = np.diff(np.asarray(lists.offsets))
            flat, doc = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
            term, tf = flat.field("term").dictionary_encode(), np.asarray(flat.field("tf")).astype(float)
            code, sums = np.asarray(term.indices.fill_null(0)).astype(np.int64), np.zeros((len(sizes), len(values)))
            for name in set(names) & set(shared.value):
                entries, weights = shared.value[name]
                place = np.asarray(pc.index_in(term.dictionary, value_set=entries).fill_null(-1)).astype(np.int64)
                mine = np.flatnonzero((names == name)[doc])
                mine = mine[place[code[mine]] >= 0]
                for k in range(len(values)):
                    sums[:, k] += np.bincount(doc[mine], weights=tf[mine] * weights[place[code[mine]], k], minlength=len(sizes))
            added = [pa.array(sums[:, k]) for k in range(len(values))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *added], names=[*others, *values])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "terms")
    slim = rows.select(*others, F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf"))).alias("terms"))
    return slim.mapInArrow(add, f"{kinds}, " + ", ".join(f"`{v}` double" for v in values))
