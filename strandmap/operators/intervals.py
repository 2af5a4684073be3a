"""Interval algebra over half-open intervals (chrom, start, end_).

Overlap, window and nearest joins cut the axis into cells, put each interval
into the cells that it touches and join by equality of (chrom, cell): a hash or
sort-merge join that Spark can spread and split, instead of a nested loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.operators import meetings as M
from strandmap.operators import scans as S


def _cells(low: Column, high: Column, cell: int) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def overlap_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str, str], right_at: tuple[str, str, str], cell: int = 1_000_000, how: str = "inner") -> DataFrame:
    """Pairs whose intervals share a base; columns of both sides must differ. how: inner, left_semi or left_anti.

    A pair is reported once: in the cell that holds the start of their intersection. left_anti knows rows by their values,
    which are the same however often Spark computes ``left``; row numbers of two computations need not be.
    """
    lc, ls, le = left_at
    rc, rs, re_ = right_at
    if how == "left_semi":
        left = left.withColumn("_row", F.monotonically_increasing_id())
    a = left.withColumn("_cell", F.explode(_cells(F.col(ls), F.col(le) - 1, cell)))
    b = right.withColumn("_other_cell", F.explode(_cells(F.col(rs), F.col(re_) - 1, cell)))
    both = (F.col(lc) == F.col(rc)) & (F.col("_cell") == F.col("_other_cell")) & (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    if how == "inner":
        return a.join(b, both & (F.floor(F.greatest(ls, rs) / cell) == F.col("_cell"))).drop("_cell", "_other_cell")
    if how == "left_semi":
        return a.join(b, both, "left_semi").dropDuplicates(["_row"]).drop("_cell", "_row")
    hit = a.join(b, both, "left_semi").select(*(F.col(c).alias(f"_hit_{c}") for c in left.columns)).distinct()
    return left.join(hit, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_hit_{c}")) for c in left.columns)), "left_anti")


def containing(points: DataFrame, intervals: DataFrame, chrom: str, at: str, key: str, prefix: str, cell: int = 1_000_000) -> DataFrame:
    """Each point with the key of the interval that holds it, as ``prefix``; points outside all go. intervals: disjoint, (chrom, start, end_, key)."""
    named = intervals.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end_").alias("_e"), F.col(key).alias(prefix))
    cut = named.withColumn("_cell", F.explode(_cells(F.col("_s"), F.col("_e") - 1, cell)))
    joined = points.join(cut, (F.col(chrom) == F.col("_c")) & (F.floor(F.col(at) / cell) == F.col("_cell")) & (F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")))
    return joined.drop("_c", "_s", "_e", "_cell")


def neighbours(left: DataFrame, right: DataFrame, k: int = 1, low: int = 0, high: int = 1_000_000, key: str = "id", other: str = "id2", absolute: bool = True) -> DataFrame:
    """The k nearest intervals of ``right`` (chrom2, start2, end2, ``other``) to each of ``left`` (chrom, start, end_, ``key``), with their distance.

    The distance is 0 where they overlap, else the gap, negative where the neighbour lies before;
    ``low`` and ``high`` bound it (its size if ``absolute``). Ties go to the smaller start, then ``other``.
    Each interval looks at the k first after it, the k last before it and the k first that overlap it, not at all in reach.
    """
    reach = max(abs(low), abs(high))
    cell = max(1, reach)
    least, most = (max(low, 1), high) if absolute else (max(-high, 1), -low)  # sizes of the distances to those before
    rows = M.spread(left.dropDuplicates([key]), F.col("start"), F.greatest(F.col("end_") - 1, F.col("start")), cell).withColumns({"_chrom": F.col("chrom"), M.AT: F.col("start")})
    held = M.spread(right.dropDuplicates([other]), F.col("start2") - reach, F.col("end2") + reach, cell).withColumns({"_chrom": F.col("chrom2"), M.AT: F.col("start2"), M.KIND: F.lit(0)})
    columns = (left.columns, right.columns)

    def read(number: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        if not len(places):
            return
        places = places.sort_by([("start2", "ascending"), (other, "ascending")])
        starts, ends = places["start2"].to_numpy(), places["end2"].to_numpy()
        back = np.lexsort((np.arange(len(ends)), -ends))  # the last end first
        longest = [ends]  # most far ends of runs of powers of two
        while 2 * (w := 1 << (len(longest) - 1)) <= len(ends):
            longest.append(np.maximum(longest[-1][:-w], longest[-1][w:]))
        for part in parts:
            lo, hi = part["start"].to_numpy(), part["end_"].to_numpy()
            found = []
            first = np.searchsorted(starts, hi + max(low, 1) - 1, "left")
            before = np.searchsorted(-ends[back], least - 1 - lo, "left")
            at = np.zeros(len(lo), np.int64)
            for step in range(k):
                found.append(np.where(first + step < len(starts), first + step, -1))
                found.append(np.where(before + step < len(starts), back[np.minimum(before + step, len(starts) - 1)], -1))
                if low <= 0 <= high:
                    for power in reversed(range(len(longest))):  # over those that end before the row begins
                        table = longest[power]
                        short = (at < len(table)) & (table[np.minimum(at, len(table) - 1)] <= lo)
                        at = at + (short << power)
                    while (short := (at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] <= lo)).any():
                        at = at + short
                    found.append(np.where((at < len(ends)) & (starts[np.minimum(at, len(ends) - 1)] < hi), at, -1))
                    at = np.minimum(at + 1, len(ends))
            i, j = np.tile(np.arange(len(lo)), len(found)), np.concatenate(found)
            i, j = i[j >= 0], j[j >= 0]
            dist = np.where(starts[j] >= hi[i], starts[j] - hi[i] + 1, np.where(ends[j] <= lo[i], ends[j] - lo[i] - 1, 0))
            size = np.abs(dist) if absolute else dist
            good = (size >= low) & (size <= high)
            i, j, dist = i[good], j[good], dist[good]
            order = np.lexsort((j, np.abs(dist), i))
            i, j, dist = i[order], j[order], dist[order]
            own = np.flatnonzero(np.diff(i, prepend=-1))
            kept = np.arange(len(i)) - np.repeat(own, np.diff(np.append(own, len(i)))) < k
            a = pa.Table.from_batches([part.select(columns[0])]).take(pa.array(i[kept]))
            b = places.select(columns[1]).take(pa.array(j[kept]))
            yield pa.Table.from_arrays([*a.columns, *b.columns, pa.array(dist[kept])], [*columns[0], *columns[1], "dist"])

    pairs = M.meet(rows, held, ["_chrom"], read, ", ".join([*(f"`{c}` {t}" for c, t in left.dtypes + right.dtypes), "dist long"]))
    order = Window.partitionBy(key).orderBy(F.abs("dist"), "start2", other)
    return pairs.dropDuplicates([key, other]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def band_pairs(left: DataFrame, right: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs of points on one chromosome with low <= start2 - start1 <= high. left: chrom, start1; right: chrom2, start2."""
    a = left.withColumn("_cell", F.explode(_cells(F.col("start1") + low, F.col("start1") + high, high)))
    b = right.withColumn("_other_cell", F.floor(F.col("start2") / high))
    gap = F.col("start2") - F.col("start1")
    return a.join(b, (F.col("chrom") == F.col("chrom2")) & (F.col("_cell") == F.col("_other_cell")) & (gap >= low) & (gap <= high)).drop("_cell", "_other_cell")


def canonic(intervals: DataFrame, key: list[str] | None = None, gap: int = 0, cell: int = 1_000_000) -> DataFrame:
    """Overlapping and touching intervals (or those at most ``gap`` apart) merged: chrom, start, end_, n merged.

    Intervals of one start are taken together, so a cell has at most ``cell`` rows; islands are found by chunked scans.
    """
    by = ["chrom", *(key or [])]
    starts = intervals.groupBy(*by, "start").agg(F.max("end_").alias("_end"), F.count("*").alias("_n"))
    rows = S.scan(S.by_cells(starts, "start", cell), by, "start", {"_before": ("max", F.col("_end"), False)})
    fresh = F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before") + gap), F.col("start"))
    rows = S.scan(rows, by, "start", {"_island": ("max", fresh, True)})
    return rows.groupBy(*by, F.col("_island").alias("start")).agg(F.max("_end").alias("end_"), F.sum("_n").alias("n"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    columns = ["chrom", "start", "end_"]
    return canonic(a.select(columns).unionByName(b.select(columns)))


def intersect(a: DataFrame, b: DataFrame, cell: int = 1_000_000) -> DataFrame:
    """Parts that two sets share, one row an overlapping pair."""
    right = b.select(F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("end_").alias("end2"))
    both = overlap_join(a.select("chrom", "start", "end_"), right, ("chrom", "start", "end_"), ("chrom2", "start2", "end2"), cell)
    return both.select("chrom", F.greatest("start", "start2").alias("start"), F.least("end_", "end2").alias("end_"))


def force_range(intervals: DataFrame, chrom_len: int) -> DataFrame:
    """Clip to the chromosomes; what is left empty goes."""
    clipped = intervals.withColumns({"start": F.greatest("start", F.lit(0)), "end_": F.least("end_", F.lit(chrom_len))})
    return clipped.where("start < end_")


def centers(intervals: DataFrame) -> DataFrame:
    mid = F.floor((F.col("start") + F.col("end_")) / 2)
    return intervals.withColumns({"start": mid, "end_": mid + 1})


def expand(intervals: DataFrame, by: int, chrom_len: int) -> DataFrame:
    return force_range(intervals.withColumns({"start": F.col("start") - by, "end_": F.col("end_") + by}), chrom_len)


def bins(chroms: DataFrame, size: int, chrom_len: int) -> DataFrame:
    """Fixed bins of every chromosome of ``chroms`` (chrom)."""
    starts = chroms.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chrom_len - 1).cast("long"), F.lit(size).cast("long"))).alias("start"))
    return starts.withColumn("end_", F.least(F.col("start") + size, F.lit(chrom_len)))


def screen(binned: DataFrame, predicate: Column, size: int, key: list[str] | None = None) -> DataFrame:
    """Maximal runs of neighbouring bins (chrom, start) for which ``predicate`` holds: chrom, start, end_, n bins.

    Bins are put into chunks of 1024; a chunk's last bin is shown to the next one too, so each knows where runs begin, and a
    chunked scan carries a run's beginning on.
    """
    by, wide = ["chrom", *(key or [])], 1024 * size
    bins = binned.where(predicate).select(*by, "start").distinct()
    both = F.when(F.pmod(F.col("start"), F.lit(wide)) >= wide - size, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shown = bins.withColumn("_next", F.explode(both)).withColumn(S.CHUNK, F.floor(F.col("start") / wide) + F.col("_next"))
    before = F.lag("start").over(Window.partitionBy(*by, S.CHUNK).orderBy("start"))
    fresh = F.when(before.isNull() | (before != F.col("start") - size), F.col("start"))
    rows = shown.withColumn("_fresh", fresh).where("_next = 0").drop("_next")
    rows = S.scan(rows, by, "start", {"_island": ("max", F.col("_fresh"), True)})
    return rows.groupBy(*by, F.col("_island").alias("start")).agg((F.max("start") + size).alias("end_"), F.count("*").alias("n"))


def window_average(points: DataFrame, track: DataFrame, chrom: str, at: str, reach: int, size: int, name: str, key: str) -> DataFrame:
    """Mean of the track's bins (chrom, start, v; ``size`` long) that the window at - reach to at + reach touches."""
    a = points.withColumn("_bin", F.explode(_cells(F.greatest(F.col(at) - reach, F.lit(0)), F.col(at) + reach, size)))
    b = track.select(F.col("chrom").alias("_c"), F.floor(F.col("start") / size).alias("_b"), F.col("v").alias("_v"))
    hit = a.join(b, (F.col(chrom) == F.col("_c")) & (F.col("_bin") == F.col("_b")))
    return hit.groupBy(key).agg(F.avg("_v").alias(name))


def nearest_end(points: DataFrame, frags: DataFrame, chrom: str, at: str, scope: int, size: int = 10, least: int = 15) -> DataFrame:
    """The fragment whose end has the nearest bin of ``size`` bases, less than scope / size bins away, the right one on a tie.

    Fragments shorter than ``least`` are left out; of two ends in a bin the later fragment's counts. Adds fid,
    side (5 or 3) and off (bins away, signed); points without one go.
    """
    ends = frags.where(F.col("end_") - F.col("start") >= least).select("fid", F.col("chrom").alias("_c"), F.explode(F.array(F.struct(F.floor(F.col("start") / size).alias("bin"), F.lit(5).alias("side")), F.struct(F.floor(F.col("end_") / size).alias("bin"), F.lit(3).alias("side")))).alias("e"))
    ends = ends.groupBy("_c", F.col("e.bin").alias("_end")).agg(F.max(F.struct("fid", F.col("e.side").alias("side"))).alias("_f"))
    marked = points.withColumn("_at", F.floor(F.col(at) / size))
    reach = max(1, scope // size)
    cut = marked.withColumn("_cell", F.explode(_cells(F.col("_at") - reach, F.col("_at") + reach, reach)))
    near = cut.join(ends.withColumn("_end_cell", F.floor(F.col("_end") / reach)), (F.col(chrom) == F.col("_c")) & (F.col("_cell") == F.col("_end_cell")) & (F.abs(F.col("_end") - F.col("_at")) < reach))
    off = F.col("_end") - F.col("_at")
    best = Window.partitionBy(*points.columns).orderBy(F.abs(off), F.desc(off))
    return near.withColumn("off", off).withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*points.columns, F.col("_f.fid").alias("fid"), F.col("_f.side").alias("side"), "off")
