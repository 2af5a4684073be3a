"""How much nearer a contact's neighbours lie than those of a shuffled map: signed distance of two distance distributions.

For every place of an observed map the k nearest other observed contacts and the k
nearest expected ones are found exactly, and the score is 100 times the largest
difference of the two distance distributions, positive where the observed ones are
nearer. Places may hold many contacts; each counts.

The plane is cut into square cells of every power of two. A place uses the smallest
cells for which the 3 x 3 around it hold enough contacts of both maps: then all k lie
within 2 * sqrt(2) cells, and the 7 x 7 cells around it, which reach 3 cells in every
direction, hold them all. Cells are counted for all powers in one pass; a place's 7 x 7
are joined by cell, so crowded regions use small cells and empty ones large cells. A
task takes one cell's places and surroundings at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.operators.areas import _borders

_CELL = ("chrom", "level", "a", "b")


def shuffled_distances(contacts: DataFrame, seed: str, digits: int = 3) -> DataFrame:
    """Contacts within chromosomes (chrom, x, y) with their distances permuted: the n-th first side in one order of digests gets the n-th distance in another.

    First sides and the decay with distance stay as they are. Digests name a contact and its copy, so equal contacts are
    dealt apart; places in the order are counted within buckets of a chromosome and a digest's first ``digits``.
    """
    cis = contacts.where("chrom1 = chrom2 and start2 >= start1").groupBy(F.col("chrom1").alias("chrom"), F.col("start1").alias("x"), (F.col("start2") - F.col("start1")).alias("d")).agg(F.count("*").alias("_n"))
    rows = cis.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in ("chrom", "x", "d", "_i")))

    def numbered(letter: str, value: str) -> DataFrame:
        placed = rows.select("chrom", value, F.md5(F.concat(F.lit(f"{seed}{letter}:"), name).cast("binary")).alias("_h")).withColumn("_bucket", F.substring("_h", 1, digits))
        before = Window.partitionBy("chrom").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 16^digits rows at most
        sizes = placed.groupBy("chrom", "_bucket").agg(F.count("*").alias("_n")).select("chrom", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        within = F.row_number().over(Window.partitionBy("chrom", "_bucket").orderBy("_h"))
        return placed.withColumn("_k", within).join(sizes, ["chrom", "_bucket"]).select("chrom", value, (F.col("_before") + F.col("_k")).alias("_at"))

    return numbered("a", "x").join(numbered("b", "d"), ["chrom", "_at"]).select("chrom", "x", (F.col("x") + F.col("d")).alias("y"))


def _scores(px: np.ndarray, py: np.ndarray, seen: np.ndarray, meant: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each q the signed largest difference of both counts, k at most, over all distances, and both kth squared distances."""
    out, kth = np.zeros(len(qx), np.int64), np.zeros((2, len(qx)), np.int64)
    for i in range(len(qx)):
        far = (px - qx[i]) ** 2 + (py - qy[i]) ** 2
        order = np.argsort(far, kind="stable")
        far = far[order]
        a, b = np.cumsum(seen[order]), np.cumsum(meant[order])
        a = a - 1  # the contact itself, the nearest of all
        last = np.append(far[1:] != far[:-1], True)
        kth[:, i] = far[np.searchsorted(a, k)], far[np.searchsorted(b, k)]
        gap = np.minimum(a[last], k) - np.minimum(b[last], k)
        out[i] = gap.max() if gap.max() >= -gap.min() else gap.min()
    return out, kth[0], kth[1]


def neighbour_scores(observed: DataFrame, expected: DataFrame, k: int, bits: int) -> DataFrame:
    """chrom, x, y, n, observed_kth and expected_kth (squared distances), score: a row each place of ``observed`` (chrom, x, y), from -100 to 100.

    Places are whole numbers; ``bits`` is how many binary digits the largest has. Ties do not matter: a distance counts as
    often as it occurs. A place in a chromosome with at most k observed or fewer than k expected contacts has no row.
    """
    side = lambda df, n, m: df.where("x is not null and y is not null and chrom is not null").select("chrom", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(n).alias("seen"), F.lit(m).alias("meant"))
    points = side(observed, 1, 0).unionByName(side(expected, 0, 1)).groupBy("chrom", "x", "y").agg(F.sum("seen").alias("seen"), F.sum("meant").alias("meant"))
    at = lambda c: F.expr(f"shiftright({c}, level)")
    every = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits)))).select("*", at("x").alias("a"), at("y").alias("b"))
    around = lambda c, r: F.explode(F.sequence(F.col(c) - r, F.col(c) + r))
    cells = every.groupBy(*_CELL).agg(F.sum("seen").alias("seen"), F.sum("meant").alias("meant"))
    blocks = cells.select("chrom", "level", around("a", 1).alias("a"), "b", "seen", "meant").select("chrom", "level", "a", around("b", 1).alias("b"), "seen", "meant")
    blocks = blocks.groupBy(*_CELL).agg(F.sum("seen").alias("seen"), F.sum("meant").alias("meant")).where((F.col("seen") > k) & (F.col("meant") >= k)).select(*_CELL)
    least = every.where("seen > 0").join(blocks, list(_CELL), "left_semi").groupBy("chrom", "x", "y").agg(F.min("level").alias("level"))
    asked = least.select("*", at("x").alias("a"), at("y").alias("b"))
    homes = asked.select(*_CELL).distinct()
    needed = homes.select("chrom", "level", F.col("a").alias("home_a"), F.col("b").alias("home_b"), around("a", 3).alias("a"), "b").withColumn("b", around("b", 3))
    given = every.join(needed, list(_CELL)).select("chrom", "level", F.col("home_a").alias("a"), F.col("home_b").alias("b"), "x", "y", "seen", "meant", F.lit(False).alias("ask"))
    zero = F.lit(0).cast("long")
    rows = given.unionByName(asked.select(*_CELL, "x", "y", zero.alias("seen"), zero.alias("meant"), F.lit(True).alias("ask")))
    kind = dict(rows.dtypes)["chrom"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            x, y, seen, meant, ask = (table[c].to_numpy() for c in ("x", "y", "seen", "meant", "ask"))
            found = np.zeros((3, len(x)), np.int64)
            for a, b in itertools.pairwise(_borders(table, _CELL)):
                p, q = a + np.flatnonzero(~ask[a:b]), a + np.flatnonzero(ask[a:b])
                found[:, q] = _scores(x[p], y[p], seen[p], meant[p], x[q], y[q], k)
            out = table.select(["chrom", "x", "y"])
            for name, column in zip(("gap", "observed_kth", "expected_kth"), found, strict=True):
                out = out.append_column(name, pa.array(column))
            yield from out.filter(table["ask"]).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 1 << 16:
                table = pa.Table.from_batches(held)
                last = _borders(table, _CELL)[-2]
                if last:
                    yield from done(table.slice(0, last))
                    held = table.slice(last).to_batches()
        if sum(map(len, held)):
            yield from done(pa.Table.from_batches(held))

    scored = rows.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(read, f"chrom {kind}, x long, y long, gap long, observed_kth long, expected_kth long")
    n = points.where("seen > 0").select("chrom", "x", "y", F.col("seen").alias("n"))
    score: Column = F.col("gap") * 100.0 / k
    return n.join(scored, ["chrom", "x", "y"]).select("chrom", "x", "y", "n", "observed_kth", "expected_kth", score.alias("score"))
