"""Neighbour scores against sorting all distances: clusters, empty regions, equal places, ties, chromosomes with too few contacts."""

import random

import pytest

from strandmap.operators import neighbour_score as NS

PLACE = "chrom long, x long, y long"


def brute(observed, expected, k):
    out = {}
    for c, x, y in set(observed):
        near = lambda rows: sorted((a - x) ** 2 + (b - y) ** 2 for d, a, b in rows if d == c)
        seen, meant = near(observed)[1 : k + 1], near(expected)[:k]
        if len(seen) < k or len(meant) < k:
            continue
        gaps = [sum(s <= d for s in seen) - sum(m <= d for m in meant) for d in {*seen, *meant}]
        gap = max(gaps) if max(gaps) >= -min(gaps) else min(gaps)
        out[c, x, y] = (observed.count((c, x, y)), seen[-1], meant[-1], gap * 100.0 / k)
    return out


@pytest.mark.parametrize("k,bits", [(1, 12), (5, 12), (30, 12)])
def test_exact_neighbours_at_every_density(spark, k, bits):
    rng = random.Random(k)
    crowd = lambda n: [(1, 900 + rng.randint(0, 12), 1000 + rng.randint(0, 12)) for _ in range(n)]
    loose = lambda n: [(rng.randint(1, 2), rng.randint(0, 4000), rng.randint(0, 4000)) for _ in range(n)]
    observed = crowd(120) + loose(60) + [(1, 0, 0)] * 9 + [(2, 4095, 4095)] + [(3, 5, 5)] * 3
    expected = crowd(20) + loose(150) + [(1, 0, 1)] * 40 + [(3, 5, 6)] * 40
    got = NS.neighbour_scores(spark.createDataFrame(observed, PLACE).repartition(3), spark.createDataFrame(expected, PLACE), k, bits)
    assert {(r.chrom, r.x, r.y): (r.n, r.observed_kth, r.expected_kth, r.score) for r in got.collect()} == brute(observed, expected, k)


def test_empty_maps_have_no_scores(spark):
    none, some = spark.createDataFrame([], PLACE), spark.createDataFrame([(1, 2, 3)] * 5, PLACE)
    assert NS.neighbour_scores(none, some, 1, 4).count() == 0
    assert NS.neighbour_scores(some, none, 1, 4).count() == 0


def test_a_hot_contact_is_shuffled_apart(spark):
    rows = [(1, 10, 1, 20)] * 300 + [(1, i, 1, i + i % 7) for i in range(300)] + [(1, 5, 2, 9), (2, 3, 2, 3)]
    df = spark.createDataFrame(rows, "chrom1 long, start1 long, chrom2 long, start2 long").repartition(4)
    got = sorted(tuple(r) for r in NS.shuffled_distances(df, "t").collect())
    cis = [(c, s, e - s) for c, s, d, e in rows if c == d]
    assert sorted((c, x) for c, x, _ in got) == sorted((c, x) for c, x, _ in cis)
    assert sorted((c, y - x) for c, x, y in got) == sorted((c, d) for c, _, d in cis)
    assert sum((c, x, y) == (1, 10, 20) for c, x, y in got) < 250  # about half keep their distance by chance
    assert got == sorted(tuple(r) for r in NS.shuffled_distances(df.repartition(2), "t").collect())
