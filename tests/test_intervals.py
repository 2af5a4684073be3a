"""Interval algebra against brute force, and properties of symmetric contacts."""

import random

from strandmap.operators import contacts as C
from strandmap.operators import intervals as I
from strandmap.operators import windows as W

IV = "chrom long, start long, end_ long"


def some(n, seed, span=5000, length=300):
    rng = random.Random(seed)
    return [(rng.randint(1, 3), s := rng.randint(0, span), s + rng.randint(1, length)) for _ in range(n)]


def test_overlap_join_finds_every_pair_once(spark):
    a, b = some(60, 1), some(50, 2)
    left = spark.createDataFrame(a, IV)
    right = spark.createDataFrame(b, "chrom2 long, start2 long, end2 long")
    got = I.overlap_join(left, right, ("chrom", "start", "end_"), ("chrom2", "start2", "end2"), 200).collect()
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert sorted(map(tuple, got)) == want
    anti = I.overlap_join(left, right, ("chrom", "start", "end_"), ("chrom2", "start2", "end2"), 200, "left_anti").collect()
    assert sorted(map(tuple, anti)) == sorted(x for x in a if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b))


def test_neighbours_match_brute_force(spark):
    a = [(i, *x) for i, x in enumerate(some(30, 3))]
    b = [(i, *x) for i, x in enumerate(some(40, 4))]
    got = I.neighbours(spark.createDataFrame(a, "id long, " + IV), spark.createDataFrame(b, "id2 long, chrom2 long, start2 long, end2 long"), 3, 0, 700).select("id", "id2", "dist", "rank").collect()
    want = []
    for i, c, s, e in a:
        near = []
        for j, c2, s2, e2 in b:
            d = s2 - e + 1 if s2 >= e else e2 - s - 1 if e2 <= s else 0
            if c == c2 and abs(d) <= 700:
                near.append((abs(d), s2, j, d))
        want += [(i, j, d, k) for k, (_, _, j, d) in enumerate(sorted(near)[:3], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_canonic_is_idempotent_and_covers_the_same_bases(spark):
    rows = some(80, 5)
    once = I.canonic(spark.createDataFrame(rows, IV))
    twice = I.canonic(once.select("chrom", "start", "end_"))
    key = lambda df: sorted((r.chrom, r.start, r.end_) for r in df.collect())
    assert key(once) == key(twice)
    bases = {(c, x) for c, s, e in rows for x in range(s, e)}
    assert bases == {(c, x) for c, s, e in key(once) for x in range(s, e)}


def test_nearest_end_takes_the_right_one_on_a_tie(spark):
    frags = spark.createDataFrame([(1, 1, 0, 1000), (2, 1, 1000, 2000), (3, 1, 2000, 2010)], "fid long, " + IV)
    points = spark.createDataFrame([(1, 505), (1, 1400), (1, 1600), (1, 90000), (2, 10)], "chrom long, at long")
    got = {r["at"]: (r["fid"], r["side"], r["off"]) for r in I.nearest_end(points, frags, "chrom", "at", 600).collect()}
    # the bin of base 1000 holds ends of fragments 1 and 2, and the later one counts
    assert got == {505: (2, 5, 50), 1400: (2, 5, -40), 1600: (2, 3, 40)}


def test_symmetrised_contacts_canonicalise_back(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 3), rng.randint(1, 3), rng.randint(0, 50), rng.randint(1, 3), rng.randint(0, 50), rng.randint(1, 4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "cell_id long, chrom1 long, start1 long, chrom2 long, start2 long, cnt long")
    one = {tuple(r)[:5]: r.cnt for r in C.canonical(df).collect()}
    two = {tuple(r)[:5]: r.cnt for r in C.canonical(C.symmetrize(df)).collect()}
    assert {k: 2 * v for k, v in one.items()} == two
    assert C.coarse_decay(df.limit(0)).count() == 0


def test_cyclic_mean_of_a_constant(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(1, 12)], "ord long, v double")
    assert {r.rolled for r in W.cyclic_roll(df, "ord", "v", 5).collect()} == {5.0}
    assert {r.rolled for r in W.cyclic_roll(df, "ord", "v", 5, "length").collect()} == {5}
