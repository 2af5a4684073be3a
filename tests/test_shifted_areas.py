"""Areas of rectangles that move with loci against counting contact by contact."""

import random

import pytest

from strandmap.operators import areas as AR

SHIFTS = {"a": (-60, 0, 0, 60), "b": (-60, -5, -60, -5), "c": (5, 60, 5, 60), "d": (-20, 30, 10, 15), "none": (3, -9, 0, 5)}


@pytest.mark.parametrize("tile", [7, 64, 100_000])
def test_areas_of_loci(spark, tile):
    rng = random.Random(tile)
    contacts = [(rng.choice(["x", "y", None]), c := rng.choice([1, 2]), s := rng.randint(-50, 400), c if rng.random() < 0.9 else 3, s + rng.randint(-5, 130), rng.randint(1, 4)) for _ in range(300)]
    contacts += contacts[:20]
    loci = [(g, rng.choice([1, 2, 3, None]), rng.choice([None, *range(-60, 500)])) for g in ("x", "y", "z") for _ in range(40)]
    c = spark.createDataFrame(contacts, "grp string, chrom1 long, start1 long, chrom2 long, start2 long, cnt long").repartition(3)
    got = AR.shifted_areas(c, spark.createDataFrame(loci * 2, "grp string, chrom long, at long"), SHIFTS, (2, 110), tile, c["cnt"], ("grp",)).collect()
    want = {}
    for g, d, at in loci:
        if None not in (d, at):
            inside = lambda s: sum(n for h, c1, x, c2, y, n in contacts if h == g and c1 == c2 == d and 2 <= y - x < 110 and at + s[0] <= x < at + 1 + s[1] and at + s[2] <= y < at + 1 + s[3])  # noqa: B023, E731
            want[g, d, at] = tuple(inside(s) for s in SHIFTS.values())
    assert {(r.grp, r.chrom, r["at"]): tuple(r[n] for n in SHIFTS) for r in got} == want and len(got) == len(want)


def test_loci_without_contacts_have_none(spark):
    loci = spark.createDataFrame([(1, 5), (1, 5), (2, 7)], "chrom long, at long")
    none = spark.createDataFrame([], "chrom1 long, start1 long, chrom2 long, start2 long")
    assert sorted(map(tuple, AR.shifted_areas(none, loci, {"a": SHIFTS["a"]}, (0, 10)).collect())) == [(1, 5, 0), (2, 7, 0)]


def test_work_follows_contacts_not_areas(spark):
    contacts = spark.range(20_000).selectExpr("1L as chrom1", "id as start1", "1L as chrom2", "id + 1000 as start2")
    loci = spark.range(20_000).selectExpr("1L as chrom", "id as at")  # 400 million contacts and loci within reach
    rows = AR.shifted_areas(contacts, loci, {"a": (-50_000, 50_000, -50_000, 50_000)}, (0, 2000))
    assert rows.agg({"a": "sum"}).collect()[0][0] == 20_000**2
