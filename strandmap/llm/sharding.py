"""Operator 2, sharding by minimax contiguous partition.

Atomic groups (equal texts) are put in the order of their texts' MD5, and cut
into shards of neighbouring groups so that the largest shard is as small as can
be: the smallest capacity with which a greedy pass needs no more shards than
asked for is found by binary search, and the cuts are that pass's.

The driver never holds all groups. It holds sums of runs of groups that share
leading hexadecimal digits, first three digits; with bounds of where the greedy
pass can cut it searches the capacities that may still be the smallest, and
takes apart only the runs in which a cut may fall, by three digits more, until
every such run is one group. A run that is taken apart gives 4096 at most, and
about one run a shard and level is, so what the driver gathers is bounded.

Null and empty texts have no bytes and form one group. Rows count one byte more
than their text. Repeated rows are rows. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.shared import shared_table

DIGITS = 3
#: Rows that one window of the numbering holds, about.
SLOT_ROWS = 200_000


def _first_cut(bounds: np.ndarray, start: float, capacity: float, inner: bool, single: np.ndarray) -> float:
    """How far a shard from ``start`` reaches: at most (``inner``) or at least, as only the ends of runs are known."""
    goal = start + capacity
    k = int(np.searchsorted(bounds, goal, "right")) - 1
    if inner and k + 1 < len(bounds) and not single[k] and bounds[k] < goal:
        return goal
    return float(bounds[k])


def _needed(bounds: np.ndarray, single: np.ndarray, capacity: int, shards: int, inner: bool) -> list[float] | None:
    """The cuts of a greedy pass, or None if it needs more than ``shards``."""
    cuts, at, total = [], 0.0, float(bounds[-1])
    for _ in range(shards):
        to = _first_cut(bounds, at, capacity, inner, single)
        if to <= at and at < total:
            return None
        cuts.append(to)
        at = to
    return cuts if at >= total else None


def _smallest(bounds: np.ndarray, single: np.ndarray, shards: int, low: int, high: int, inner: bool) -> int:
    while low < high:
        mid = (low + high) // 2
        if _needed(bounds, single, mid, shards, inner) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """The keys at which shards 1, 2, ... begin. groups: key (32 hexadecimal digits), size."""

    def runs(depth: int, within: list[str] | None) -> list[tuple[str, int, int, int]]:
        part = groups if within is None else groups.join(F.broadcast(groups.sparkSession.createDataFrame([(x,) for x in within], "run string")), F.substring("key", 1, depth - DIGITS) == F.col("run"), "left_semi")
        rows = part.groupBy(F.substring("key", 1, depth).alias("run")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
        return [(r.run, r.size, r.n, r.largest) for r in rows]

    atoms = sorted(runs(DIGITS, None))
    depth = DIGITS
    while True:
        size = np.array([a[1] for a in atoms], np.int64)
        single = np.array([a[2] == 1 for a in atoms] + [True])
        bounds = np.concatenate([[0], np.cumsum(size)])
        total = int(bounds[-1]) if len(atoms) else 0
        if not total:
            return []
        least = max(-(-total // shards), max(a[3] for a in atoms))
        low = _smallest(bounds, single, shards, least, total, True)
        high = _smallest(bounds, single, shards, low, total, False)
        reach = _needed(bounds, single, high, shards, True)
        early = _needed(bounds, single, high, shards, False) if low == high else None
        open_ = set()
        at_low = 0.0
        for cut in reach or []:  # a cut lies between where the shortest and the longest pass may put it
            at_low = _first_cut(bounds, at_low, low, False, single)
            a, b = int(np.searchsorted(bounds, at_low, "right")) - 1, int(np.searchsorted(bounds, cut, "left"))
            open_.update(k for k in range(a, min(b + 1, len(atoms))) if not single[k])
        if not open_ or depth >= 32:
            cuts = early or _needed(bounds, single, high, shards, False) or []
            keys = [atoms[int(np.searchsorted(bounds, c))][0] for c in cuts if c < total]
            return sorted({k for k in keys})
        depth += DIGITS
        again = {atoms[k][0] for k in open_}
        finer = runs(depth, sorted(again))
        atoms = sorted([a for a in atoms if a[0] not in again] + finer)


def _shard(key: Column, cuts: list[str]) -> Column:
    """Cuts are leading digits; a key is at or after a cut that it begins with."""
    out = F.lit(0)
    for i, cut in enumerate(cuts, 1):
        out = F.when(key >= cut, F.lit(i)).otherwise(out)
    return out.cast("int")


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id_col, size, text_crc32, shard, slot (from 0 in every shard)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    rows = shared_table(rows, "sizes")
    groups = shared_table(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts = minimax_cuts(groups, shards)
    # numbering: rows of a shard in windows of key digits and salt, then the windows' offsets
    rows = rows.withColumn("shard", _shard(F.col("key"), cuts)).withColumn("digits", F.substring("key", 1, DIGITS))
    counts = rows.groupBy("shard", "digits").agg(F.count("*").alias("n"))
    salts = counts.select("shard", "digits", F.ceil(F.col("n") / SLOT_ROWS).cast("long").alias("salts"))
    rows = rows.join(F.broadcast(salts), ["shard", "digits"])  # 4096 runs and a few cut ones at most
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.col(id_col)), F.col("salts")))
    parts = ["shard", "digits", "salt"]
    windows = rows.groupBy(*parts).agg(F.count("*").alias("n"))
    before = windows.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("digits", "salt")) - F.col("n")).drop("n")
    slot = F.row_number().over(Window.partitionBy(*parts).orderBy("key", F.col(id_col).asc_nulls_first()))
    return rows.withColumn("place", slot).join(before, parts).select(id_col, "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))
