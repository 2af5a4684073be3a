"""Places against rows near them, and classes of contacts, against looking at every pair."""

import random

import pytest

from strandmap.operators import annotation as A
from strandmap.operators import meetings as M


@pytest.mark.parametrize("reach", [0, 7, 60])
def test_nearest_place(spark, reach):
    rng = random.Random(reach)
    rows = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, *range(-200, 600)])) for i in range(400)]
    hits = [(rng.choice([1, 2, None]), rng.randint(-200, 600)) for _ in range(60)] * 2
    got = M.nearest(spark.createDataFrame(rows, "id long, c long, at long").repartition(3), "c", "at", spark.createDataFrame(hits, "chrom long, start long"), reach, "d")
    want = {}
    for i, c, at in rows:
        near = [(abs(at - h), at - h) for k, h in hits if k == c and abs(at - h) <= reach] if None not in (c, at) else []
        if near:
            want[i, c, at] = min(near)[1]
    assert {(r.id, r.c, r.at): r.d for r in got.collect()} == want
    assert got.columns == ["id", "c", "at", "d"]


def test_rows_follow_places_not_pairs(spark):
    rows = spark.range(20_000).selectExpr("1L as c", "id as at")
    hits = spark.range(20_000).selectExpr("1L as chrom", "id as start")  # 400 million pairs are within reach
    found = M.nearest(rows, "c", "at", hits, 40_000, "d").agg({"d": "sum", "c": "count"}).collect()[0]
    assert sorted(found) == [0, 20_000]
    sites = hits.selectExpr("chrom", "start", "start + 1 as end_", "if(start % 2 = 0, 'F', 'C') as type")
    contacts = rows.selectExpr("c as chrom1", "at as start1", "c as chrom2", "at + 100000 as start2")
    assert [tuple(r) for r in A.contact_classes(contacts, sites, 40_000).groupBy("type1", "type2").count().collect()] == [("F", "N", 20_000)]


def test_classes_of_contacts(spark):
    rng = random.Random(4)
    place = lambda: (rng.choice([1, 2, None]), rng.choice([None, *range(4_000_000, 4_000_300)]))
    contacts = [(i, *place(), *place()) for i in range(300)]
    sites = [(rng.choice([1, 2]), s := rng.randint(4_000_000, 4_000_300), s + rng.randint(1, 30), rng.choice(["F", "R", "C", "B", "X", None])) for _ in range(40)]
    got = A.contact_classes(spark.createDataFrame(contacts, "id long, chrom1 long, start1 long, chrom2 long, start2 long"), spark.createDataFrame(sites, "chrom long, start long, end_ long, type string"), 5)

    def kind(c, at):
        t = {k for d, s, e, k in sites if None not in (c, at) and d == c and s - 5 <= at < e + 5}
        return "B" if "B" in t or {"F", "R"} <= t else next((k for k in "FRC" if k in t), "N")

    assert {r.id: (r.type1, r.type2) for r in got.collect()} == {i: (kind(c, s), kind(d, t)) for i, c, s, d, t in contacts}
