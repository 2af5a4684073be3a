"""Sums over rectangles of a plane of weighted points, by a summed-area table in tiles.

The sum of all points below and left of a corner has four parts: whole tiles below
and left of the corner's tile, the tiles of its column below it as far left as the
corner, the tiles of its row likewise, and the points of its own tile. Each part is
a small plane of its own (tiles; columns of tiles by place; rows by place; one tile),
in which points of one place are summed before anything is shuffled. Rows are sorted by
plane, and a task takes plane after plane as a dense table over just the places that
corners ask for, summed along both axes, and reads it once for each distinct corner. A rectangle is its four
corners' sums with signs. Rows are proportional to points and rectangles, whatever
the rectangles' areas; the points of a crowded tile are dealt to ``SALTS`` tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmap.operators import meetings as M

#: Tables that a tile's own points are dealt to, and cells of a dense table that are held at once.
SALTS, DENSE = 4, 1 << 21


def dominated(px: np.ndarray, py: np.ndarray, w: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each q the sum of w over points with px < qx and py < qy."""
    ux, ix = np.unique(qx, return_inverse=True)
    uy, iy = np.unique(qy, return_inverse=True)
    x, y = np.searchsorted(ux, px, "right"), np.searchsorted(uy, py, "right")  # the first corner right of and above each point
    good = (x < len(ux)) & (y < len(uy))
    x, y, w = x[good], y[good], w[good]
    order, asked = np.argsort(x, kind="stable"), np.argsort(ix, kind="stable")
    x, y, w = x[order], y[order], w[order]
    out, carry = np.zeros(len(qx), w.dtype), np.zeros(len(uy), w.dtype)
    step = max(1, DENSE // max(1, len(uy)))
    for low in range(0, len(ux), step):
        high = min(low + step, len(ux))
        a, b = np.searchsorted(x, [low, high])
        table = np.zeros((high - low, len(uy)), w.dtype)
        np.add.at(table, (x[a:b] - low, y[a:b]), w[a:b])
        table[0] += carry
        np.cumsum(table, 0, out=table)
        carry = table[-1].copy()
        np.cumsum(table, 1, out=table)
        k = asked[slice(*np.searchsorted(ix[asked], [low, high]))]
        out[k] = table[ix[k] - low, iy[k]]
    return out


def _parts(x: Column, y: Column, tile: int, salt: Column) -> Column:
    """The four planes that a point or a corner is in: part, the plane's tiles g1 and g2, salt, and its place there."""
    a, b, none = F.floor(x / tile), F.floor(y / tile), F.lit(0).cast("long")
    one = lambda part, g1, g2, s, u, v: F.struct(F.lit(part).alias("part"), g1.alias("g1"), g2.alias("g2"), s.alias("salt"), u.alias("u"), v.alias("v"))
    zero = F.lit(0).cast("int")
    return F.array(one(0, a, b, salt, x, y), one(1, none, b, zero, a, y), one(2, a, none, zero, x, b), one(3, none, none, zero, a, b))


_PLANE = ("part", "g1", "g2", "salt")


def _borders(rows: pa.Table, columns: Sequence[str]) -> list[int]:
    """0, every row that differs from the one before it in one of the columns, and the number of rows."""
    fresh = np.zeros(rows.num_rows - 1, bool)
    for c in columns:
        column = rows[c].combine_chunks()
        fresh |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(fresh) + 1).tolist(), rows.num_rows]


def rectangle_sums(points: DataFrame, rectangles: DataFrame, keys: Sequence[str], ids: Sequence[str], tile: int) -> DataFrame:
    """keys, ids and ``total``, the sum of w over the points (keys, x, y, w) in each rectangle (keys, ids, x0, x1, y0, y1), ends not included; 0 without points.

    Places are whole numbers of either sign, weights whole numbers; small tiles bound what a task holds, large ones make fewer planes. Keys and ids
    must not be null; a rectangle without area has 0. Rectangles with equal ids are summed.
    """
    keys, ids = list(keys), list(ids)
    name = {k: f"_q_{k}" for k in keys}
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    summed = points.groupBy(*keys, x.alias("x"), y.alias("y")).agg(F.sum("w").cast("long").alias("w"))
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)).cast("int")
    held = summed.select(*keys, F.explode(_parts(F.col("x"), F.col("y"), tile, salt)).alias("_p"), "w").select(*keys, "_p.*", "w")
    held = held.groupBy(*keys, *_PLANE, "u", "v").agg(F.sum("w").alias("w"))
    corner = lambda u, v, sign: F.struct(F.col(u).cast("long").alias("x"), F.col(v).cast("long").alias("y"), F.lit(sign).alias("sign"))
    corners = rectangles.where("x0 < x1 and y0 < y1").select(*keys, *ids, F.explode(F.array(corner("x1", "y1", 1), corner("x0", "y1", -1), corner("x1", "y0", -1), corner("x0", "y0", 1))).alias("_c")).select(*keys, *ids, "_c.*")
    asked = corners.select(*keys, "x", "y").distinct().select(*keys, "x", "y", F.explode(_parts(F.col("x"), F.col("y"), tile, F.lit(-1))).alias("_p")).select(*keys, "x", "y", "_p.*")
    looked = asked.select(*keys, "part", "g1", "g2", "u", "v").distinct()
    looked = looked.withColumn("salt", F.explode(F.when(F.col("part") == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    plane = [*keys, *_PLANE]
    both = held.select(*plane, "u", "v", "w", F.lit(False).alias("ask")).unionByName(looked.select(*plane, "u", "v", F.lit(0).cast("long").alias("w"), F.lit(True).alias("ask")))
    kept = [*keys, "part", "g1", "g2", "u", "v"]
    types = dict(both.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """All of whole planes, in order of planes."""
            asks = rows["ask"].to_numpy()
            u, v, w = (rows[c].to_numpy() for c in ("u", "v", "w"))
            found = np.zeros(len(asks), np.int64)
            for a, b in itertools.pairwise(_borders(rows, plane)):
                ask = asks[a:b]
                if ask.any() and not ask.all():
                    point, at = a + np.flatnonzero(~ask), a + np.flatnonzero(ask)
                    found[at] = dominated(u[point], v[point], w[point], u[at], v[at])
            out = rows.select(kept).append_column("s", pa.array(found)).filter(rows["ask"]).combine_chunks()
            yield from out.to_batches()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 1 << 16:
                rows = pa.Table.from_batches(held)
                last = _borders(rows, plane)[-2]  # where the last plane, perhaps not whole, begins
                if last:
                    yield from done(rows.slice(0, last))
                    held = rows.slice(last).to_batches()
        if held and sum(map(len, held)):
            yield from done(pa.Table.from_batches(held))

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "s long"])
    sums = both.repartition(*plane).sortWithinPartitions(*plane).mapInArrow(read, schema).withColumnsRenamed(name)
    same = [F.col(k) == F.col(name[k]) for k in keys] + [F.col(c) == F.col(f"_{c}") for c in ("part", "g1", "g2", "u", "v")]
    sums = sums.select(*name.values(), *(F.col(c).alias(f"_{c}") for c in ("part", "g1", "g2", "u", "v")), "s")
    at = asked.join(sums, same).groupBy(*keys, "x", "y").agg(F.sum("s").alias("s"))
    total = corners.join(at, [*keys, "x", "y"]).groupBy(*keys, *ids).agg(F.sum(F.col("sign") * F.col("s")).alias("total"))
    return rectangles.select(*keys, *ids).distinct().join(total, [*keys, *ids], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def shifted_areas(contacts: DataFrame, loci: DataFrame, shifts: dict[str, tuple[int, int, int, int]], band: tuple[int, int], tile: int = 10_000_000, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """For every locus (chrom, at) the contacts (or their summed ``weight``) in rectangles around it: a column for each of ``shifts``.

    A rectangle reaches from at + s1 to at + 1 + e1 on the first axis and from at + s2 to at + 1 + e2 on the second, as
    two-dimensional iterators of one base do with shifts (s1, e1, s2, e2); of contacts within chromosomes, as they are stored,
    those at least band[0] and less than band[1] apart count. With ``by``, loci hold those columns too.

    The loci in whose rectangle a contact lies are a run of the axis: it is marked at both ends, and running sums over the loci
    of a tile (see ``meetings``) give the areas. So work grows with contacts and loci.
    """
    x, y = F.col("start1"), F.col("start2")
    gap, keys = y - x, [*by, "chrom"]
    low, high = x - max(s[1] for s in shifts.values()), x - min(s[0] for s in shifts.values())
    cis = contacts.where((F.col("chrom1") == F.col("chrom2")) & (gap >= band[0]) & (gap < band[1]))
    rows = M.spread(cis.where(low <= high), low, high, tile).select(*by, F.col("chrom1").alias("chrom"), M.CELL, x.alias(M.AT), y.alias("_y"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    held = loci.where("chrom is not null and at is not null").select(*keys, F.col("at").cast("long").alias(M.AT)).distinct().withColumns({M.CELL: F.floor(F.col(M.AT) / tile), M.KIND: F.lit(0)})

    def read(key: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        if not len(places):
            return
        at = places[M.AT].to_numpy()
        marks = np.zeros((len(shifts), len(at) + 1), np.int64)
        for part in parts:
            px, py, w = (part[c].to_numpy() for c in (M.AT, "_y", "_w"))
            for row, (s1, e1, s2, e2) in zip(marks, shifts.values(), strict=True):
                first, last = np.searchsorted(at, np.maximum(px - e1, py - e2), "left"), np.searchsorted(at, np.minimum(px - s1, py - s2), "right")
                some = first < last
                np.add.at(row, first[some], w[some])
                np.subtract.at(row, last[some], w[some])
        sums = np.cumsum(marks, 1)[:, :-1]
        yield pa.Table.from_arrays([*(places[k] for k in keys), places[M.AT], *map(pa.array, sums)], [*keys, "at", *shifts])

    types = dict(held.dtypes)
    asked = held.join(rows.select(*keys, M.CELL).distinct(), [*keys, M.CELL], "left_semi")  # tiles without contacts need no task's time
    found = M.meet(rows, asked, keys, read, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "at long", *(f"`{n}` long" for n in shifts)]))
    return held.select(*keys, F.col(M.AT).alias("at")).join(found, [*keys, "at"], "left").na.fill(0, list(shifts))


def window_sums(cells: DataFrame, keys: Sequence[str], windows: Sequence[int], tile: int = 256) -> DataFrame:
    """keys, i, j, sums (one a window of w cells to each side, in order): the points (keys, i, j, n) around every cell with any in the widest.

    Cells are cut into tiles; a tile gets the cells up to the widest window beyond its borders too, at most
    (tile + 2 * widest)^2 of them, and reads all windows from one summed-area table.
    """
    keys, wide = list(keys), max(windows)
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - wide) / tile), F.floor((F.col(c) + wide) / tile)))
    near = cells.select(*keys, "i", "j", F.col("n").cast("long").alias("n"), reach("i").alias("_ti")).withColumn("_tj", reach("j"))
    types = dict(cells.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "i long, j long, sums array<long>"])

    def table(rows: pa.Table) -> pa.Table:
        at = [rows[c][0].as_py() * tile - wide for c in ("_ti", "_tj")]
        side = tile + 2 * wide
        plane = np.zeros((side + 1, side + 1), np.int64)
        i, j = (rows[c].to_numpy() - at[k] for k, c in enumerate(("i", "j")))
        np.add.at(plane, (i + 1, j + 1), rows["n"].to_numpy())
        total = plane.cumsum(0).cumsum(1)
        own = np.arange(wide, wide + tile)
        sums = []
        for w in windows:
            low, high = own - w, own + w + 1
            sums.append(total[np.ix_(high, high)] - total[np.ix_(low, high)] - total[np.ix_(high, low)] + total[np.ix_(low, low)])
        a, b = np.nonzero(sums[int(np.argmax(windows))])
        values = np.stack([s[a, b] for s in sums], 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * len(sums), pa.int32()), pa.array(values.ravel()))
        same = [pa.array([rows[k][0].as_py()] * len(a), rows[k].type) for k in keys]
        return pa.table([*same, pa.array(a + at[0] + wide), pa.array(b + at[1] + wide), lists], [*keys, "i", "j", "sums"])

    return near.groupBy(*keys, "_ti", "_tj").applyInArrow(table, schema)
