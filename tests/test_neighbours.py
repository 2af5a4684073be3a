"""The nearest intervals of each, with bounds of both kinds, against all pairs."""

import random

import pytest

from strandmap.operators import intervals as I

IV = "chrom long, start long, end_ long"


@pytest.mark.parametrize("k,low,high,absolute,length", [(1, 0, 50, True, 1), (3, 0, 60, True, 90), (2, 5, 40, True, 30), (2, -30, 10, False, 40), (2, 3, 50, False, 20), (2, -50, -4, False, 20)])
def test_neighbours(spark, k, low, high, absolute, length):
    rng = random.Random(k + high)
    some = lambda n: [(i, rng.choice([1, 2, 3]), s := rng.randint(0, 400), s + rng.randint(1, length)) for i in range(n)]
    a, b = some(80), some(120)
    got = I.neighbours(spark.createDataFrame(a, "id long, " + IV).repartition(3), spark.createDataFrame(b, "id2 long, chrom2 long, start2 long, end2 long"), k, low, high, absolute=absolute)
    want = set()
    for i, c, s, e in a:
        near = []
        for j, c2, s2, e2 in b:
            d = s2 - e + 1 if s2 >= e else e2 - s - 1 if e2 <= s else 0
            if c == c2 and low <= (abs(d) if absolute else d) <= high:
                near.append((abs(d), s2, j, d))
        want |= {(i, j, d, n) for n, (_, _, j, d) in enumerate(sorted(near)[:k], 1)}
    assert {tuple(r) for r in got.select("id", "id2", "dist", "rank").collect()} == want


def test_neighbours_follow_rows_not_pairs(spark):
    rows = spark.range(20_000)
    left, right = rows.selectExpr("id", "1L as chrom", "id as start", "id + 1 as end_"), rows.selectExpr("id as id2", "1L as chrom2", "id as start2", "id + 1 as end2")
    assert I.neighbours(left, right, 1, 0, 100_000).where("dist = 0 and id = id2").count() == 20_000
