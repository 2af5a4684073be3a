"""Rows against the places near them, cell by cell of an axis.

A cell gets its rows and every place that they reach. Both travel by one shuffle and
places are sorted before rows, so a task holds the places of one cell and reads rows
batch by batch, by binary search among the places: work grows with rows and places,
not with the pairs that they make.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of cells, of kinds (from 0; rows have ``ROW``) and of where places and rows are.
CELL, KIND, AT, ROW = "_cell", "_kind", "_at", 9

#: Rows that are handed on at once.
FULL = 1 << 13

Read = Callable[[tuple, pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.Table]]


def spread(df: DataFrame, low: Column, high: Column, cell: int) -> DataFrame:
    """A row for each cell of ``cell`` bases from low's to high's."""
    return df.withColumn(CELL, F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))


def _cells(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where a cell ends."""
    for batch in batches:
        if not len(batch):
            continue
        fresh = np.zeros(len(batch) - 1, bool)
        for k in keys:
            column = batch[k]
            if column.null_count:
                column = pc.rank(column, tiebreaker="min")
            fresh |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        for a, b in itertools.pairwise([0, *(np.flatnonzero(fresh) + 1).tolist(), len(batch)]):
            yield tuple(batch[k][a].as_py() for k in keys), batch.slice(a, b - a)


def meet(rows: DataFrame, places: DataFrame, by: Sequence[str], read: Read, schema: str) -> DataFrame:
    """What ``read`` makes of each cell: its key (by, cell), all its places as a table in order, and its rows in order, a batch at a time.

    rows: by, ``CELL``, ``AT`` and further columns; places: also ``KIND``. ``AT`` must not be null.
    """
    keys = [*by, CELL]
    both = places.unionByName(rows.withColumn(KIND, F.lit(ROW)), allowMissingColumns=True)

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, n = [], 0  # what small cells give is handed on together
        for key, found in itertools.groupby(_cells(batches, keys), key=lambda p: p[0]):
            parts = (part for _, part in found)
            held, rest = [], []
            for part in parts:
                first = int(np.searchsorted(part[KIND].to_numpy(), ROW))
                held.append(part.slice(0, first))
                if first < len(part):
                    rest.append(part.slice(first))
                    break
            for out in read(key, pa.Table.from_batches(held), itertools.chain(rest, parts)):
                ready.append(out)
                if (n := n + len(out)) >= FULL:
                    yield from pa.concat_tables(ready).combine_chunks().to_batches(1 << 16)
                    ready, n = [], 0
        if n:
            yield from pa.concat_tables(ready).combine_chunks().to_batches(1 << 16)

    return both.repartition(*keys).sortWithinPartitions(*keys, KIND, AT).mapInArrow(read_all, schema)


def of_kind(places: pa.Table, kind: int) -> pa.Table:
    return places.filter(pc.equal(places[KIND], kind))


def nearest(rows: DataFrame, chrom: str, at: str, places: DataFrame, reach: int, name: str) -> DataFrame:
    """Rows with ``name``, how far their place is from the nearest of ``places`` (chrom, start) at most ``reach`` away; others go.

    Of two equally near the one after the place counts (negative distance).
    """
    cell = max(4 * reach, 1)
    here, start = F.col(at), F.col("start")
    columns = [c for c in rows.columns if c not in (chrom, at)]
    asked = rows.where(F.col(chrom).isNotNull() & here.isNotNull()).select(*columns, F.col(chrom).alias("_chrom"), here.alias(AT), F.floor(here / cell).alias(CELL))
    held = spread(places.select(F.col("chrom").alias("_chrom"), "start").distinct(), start - reach, start + reach, cell)
    held = held.select("_chrom", CELL, F.lit(0).alias(KIND), start.alias(AT))

    def read(key: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        if not len(places):
            return
        hits = np.unique(places[AT].to_numpy())
        for part in parts:
            p = part[AT].to_numpy()
            i = np.searchsorted(hits, p)
            before, after = p - hits[np.maximum(i - 1, 0)], p - hits[np.minimum(i, len(hits) - 1)]
            d = np.where(np.abs(before) < np.abs(after), before, np.where(np.abs(after) < np.abs(before), after, np.minimum(before, after)))
            out = pa.Table.from_batches([part.select([*columns, "_chrom", AT])]).rename_columns([*columns, chrom, at]).append_column(name, pa.array(d))
            yield out.filter(pa.array(np.abs(d) <= reach))

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*columns, chrom, at)), f"`{name}` long"])
    return meet(asked, held, ["_chrom"], read, schema).select(*rows.columns, name)


def covering(rows: DataFrame, chrom: str, at: str, spans: DataFrame, kinds: Sequence[str], choose: Callable[[dict[str, np.ndarray]], np.ndarray], values: Sequence[str], name: str, cell: int = 1_000_000) -> DataFrame:
    """Rows with ``name``: one of ``values``, the number that ``choose`` gives for the kinds of ``spans`` (chrom, start, end_, type) that hold their place.

    ``choose`` gets an array of truth values for each of ``kinds``. Rows without a place are held by none.
    """
    here = F.coalesce(F.col(at).cast("long"), F.lit(-(1 << 62)))
    asked = rows.select("*", F.col(chrom).alias("_chrom"), here.alias(AT), F.floor(here / cell).alias(CELL))
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("type")).cast("int") - 1
    held = spans.where(F.col("type").isin(*kinds) & (F.col("start") < F.col("end_"))).select(F.col("chrom").alias("_chrom"), number.alias(KIND), F.col("start").alias(AT), F.col("end_").alias("_end")).distinct()
    held = spread(held, F.col(AT), F.col("_end") - 1, cell)
    columns = rows.columns

    def read(key: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        ends = [(t[AT].to_numpy(), np.sort(t["_end"].to_numpy())) for t in (of_kind(places, k) for k in range(len(kinds)))]
        for part in parts:
            p = part[AT].to_numpy()
            has = {k: np.searchsorted(s, p, "right") > np.searchsorted(e, p, "right") for k, (s, e) in zip(kinds, ends, strict=True)}
            yield pa.Table.from_batches([part.select(columns)]).append_column(name, pa.array(values).take(pa.array(choose(has))))

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{name}` string"])
    return meet(asked, held, ["_chrom"], read, schema)
