"""Sums of rectangles and windows against counting point by point."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.operators import areas as AR


@pytest.mark.parametrize("tile,dense", [(1, 1 << 21), (16, 40), (1000, 1 << 21)])
def test_rectangles_of_any_size(spark, tile, dense, monkeypatch):
    monkeypatch.setattr(AR, "DENSE", dense)
    rng = random.Random(tile)
    points = [(rng.randint(1, 2), rng.randint(-50, 150), rng.randint(-50, 150), rng.randint(-2, 5)) for _ in range(600)] + [(1, 20, 20, 1)] * 200
    rectangles = [(rng.randint(1, 3), i, x := rng.randint(-70, 160), x + rng.choice([0, 1, 17, 90, -5]), y := rng.randint(-70, 160), y + rng.choice([1, 17, 90])) for i in range(80)]
    got = AR.rectangle_sums(spark.createDataFrame(points, "c long, x long, y long, w long").repartition(4), spark.createDataFrame(rectangles, "c long, id long, x0 long, x1 long, y0 long, y1 long"), ["c"], ["id"], tile)
    want = {i: sum(w for d, x, y, w in points if d == c and x0 <= x < x1 and y0 <= y < y1) for c, i, x0, x1, y0, y1 in rectangles}
    assert {r.id: r.total for r in got.collect()} == want


def test_without_points_and_without_rectangles(spark):
    points, rectangles = spark.createDataFrame([(1, 2, 3, 4)], "c long, x long, y long, w long"), spark.createDataFrame([(1, 0, 0, 9, 0, 9)], "c long, id long, x0 long, x1 long, y0 long, y1 long")
    assert AR.rectangle_sums(points.limit(0), rectangles, ["c"], ["id"], 8).collect()[0].total == 0
    assert AR.rectangle_sums(points, rectangles.limit(0), ["c"], ["id"], 8).count() == 0


def test_rows_follow_points_and_rectangles_not_areas(spark):
    points = spark.range(500).select(F.lit(1).alias("c"), (F.col("id") * 7919 % 100_000).alias("x"), (F.col("id") * 104_729 % 100_000).alias("y"), F.lit(1).alias("w"))
    one = spark.createDataFrame([(1, 0, 0, 100_000, 0, 100_000)], "c long, id long, x0 long, x1 long, y0 long, y1 long")
    assert AR.rectangle_sums(points, one, ["c"], ["id"], 300).collect()[0].total == 500


def test_dominated_points():
    rng = np.random.default_rng(3)
    px, py, w, qx, qy = (rng.integers(0, 40, 200) for _ in range(5))
    want = [int(w[(px < a) & (py < b)].sum()) for a, b in zip(qx, qy, strict=True)]
    assert AR.dominated(px, py, w, qx, qy).tolist() == want
    assert AR.dominated(px[:0], py[:0], w[:0], qx, qy).tolist() == [0] * 200


@pytest.mark.parametrize("tile", [3, 16, 256])
def test_windows_across_tiles(spark, tile):
    rng = random.Random(tile)
    cells = {(c, rng.randint(-20, 60), rng.randint(-20, 60)): rng.randint(1, 4) for c in (1, 2) for _ in range(60)}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "c long, i long, j long, n long").repartition(3)
    want = {}
    for c in (1, 2):
        for i in range(-26, 67):
            for j in range(-26, 67):
                sums = [sum(cells.get((c, a, b), 0) for a in range(i - w, i + w + 1) for b in range(j - w, j + w + 1)) for w in (0, 2, 5)]
                if sums[-1]:
                    want[c, i, j] = sums
    assert {(r.c, r.i, r.j): r.sums for r in AR.window_sums(df, ["c"], [0, 2, 5], tile).collect()} == want
    assert AR.window_sums(df.limit(0), ["c"], [1], tile).count() == 0
