"""Peaks of bin counts for every key and chromosome, none near a stronger one, with a fragment that stands for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.operators import annotation as A
from strandmap.operators.lineage import cut


def _strength() -> F.Column:
    """What decides between near candidates: the larger count, then the smaller bin."""
    return F.struct("n", (-F.col("at")).alias("_left"))


def candidates(points: DataFrame, size: int, width: int, high: float, around: float) -> DataFrame:
    """Bins (key, chrom, at, n) of points (key, chrom, pos) with ``high`` times the median count of the key's bins with points there, and whose ``width`` neighbours to each side have ``around`` times it on average.

    A bin is named by its end, as places are rounded up to multiples of ``size``. Windows hold bins, whose number a chromosome's length fixes.
    """
    bins = points.where("key is not null and chrom is not null and pos is not null").groupBy("key", "chrom", (F.ceil(F.col("pos") / size) * size).alias("at")).agg(F.count("*").alias("n"))
    median = bins.groupBy("key", "chrom").agg(F.median("n").alias("_median"))
    near = Window.partitionBy("key", "chrom").orderBy("at").rangeBetween(-width * size, width * size)
    rows = bins.withColumn("_around", (F.sum("n").over(near) - F.col("n")) / (2 * width)).join(median, ["key", "chrom"])
    return rows.where((F.col("n") >= high * F.col("_median")) & (F.col("_around") >= around * F.col("_median"))).select("key", "chrom", "at", "n")


def apart(alive: DataFrame, distance: int) -> DataFrame:
    """Of bins (key, chrom, at, n) those that stay when the strongest come first and none stays within less than ``distance`` of one that does.

    In each round every bin that is the strongest of those left in its reach stays, and what is in its reach goes, everywhere at
    once: the same bins as one by one. Rounds end when none is left; the strongest of all goes in the first, so there are as many at most as bins in a chain of falling neighbours.
    """
    reach = Window.partitionBy("key", "chrom").orderBy("at").rangeBetween(-(distance - 1), distance - 1)
    alive = cut(alive)
    kept = alive.limit(0)
    while not alive.isEmpty():
        marked = alive.withColumn("_top", F.max(_strength()).over(reach) == _strength())
        marked = cut(marked.withColumn("_gone", F.max("_top").over(reach)))
        kept = kept.unionByName(marked.where("_top").select(alive.columns))
        alive = marked.where("not _gone").select(alive.columns)
    return kept


def peaks_by_key(points: DataFrame, frags: DataFrame, size: int = 25_000, width: int = 5, high: float = 10.0, around: float = 3.0, distance: int = 500_000, least: int = 100, alone: bool = False) -> DataFrame:
    """key, chrom, at, n, fid: peaks of keys with ``least`` points, with the middle fragment of the bin that is none of the key's own (null without).

    points: key, chrom, pos, fid (the fragment that each lies in). With ``alone`` only keys with a single peak stay.
    """
    many = points.groupBy("key").count().where(F.col("count") >= least).select("key")
    rows = points.join(many, "key", "left_semi")
    found = cut(apart(candidates(rows, size, width, high, around), distance)).withColumn("peak", F.struct("key", "chrom", "at"))
    used = rows.select("key", "fid").distinct()
    near = A.fragments_within(found.select("peak", "key", "chrom", "at"), frags, "peak", size)
    free = near.join(used, ["key", "fid"], "left_anti")
    out = found.join(A.middle_of(free, "peak"), "peak", "left").select("key", "chrom", "at", "n", "fid")
    if alone:
        single = out.groupBy("key").count().where("count = 1").select("key")
        out = out.join(single, "key", "left_semi")
    return out
