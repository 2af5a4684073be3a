"""Contacts around loops against all pairs of sites and contacts."""

import random
from collections import Counter

import pytest

from strandmap.operators import loops as L

BAND, REACH, INNER = (20, 100), 20, 6


def tables(spark, seed, n_sites=70, n=300, span=500):
    rng = random.Random(seed)
    sites = [(i, rng.choice([1, 2, None]), rng.randint(0, span), rng.choice("FR")) for i in range(n_sites)]
    sites += [(n_sites + i, 1, 3 * span + 150 * i, t) for i, t in enumerate("FRFRFR")] + sites[:6]  # lonely ones, and sites that occur twice
    contacts = [(rng.randint(1, 3), rng.choice(["x", "y", None]), c := rng.choice([1, 2, None]), s := rng.randint(-20, span), c if rng.random() < 0.9 else 2, s + rng.randint(-40, 160)) for _ in range(n)]
    contacts += contacts[:9]
    return sites, contacts, spark.createDataFrame(sites, "site_id long, chrom long, start long, type string").repartition(2), spark.createDataFrame(contacts, "cell_id long, grp string, chrom1 long, start1 long, chrom2 long, start2 long").repartition(3)


def pairs(sites):
    """chrom, site1, start1, site2, start2."""
    return [(c, i, s, j, e) for i, c, s, t in sites for j, d, e, u in sites if t == "F" and u == "R" and c is not None and c == d and BAND[0] <= e - s <= BAND[1]]


def near(sites, contacts, reach=REACH):
    """contact, loop, dx, dy."""
    return [(k, p, k[3] - p[2], k[5] - p[4]) for k in contacts if k[2] is not None and k[2] == k[4] for p in pairs(sites) if p[0] == k[2] and abs(k[3] - p[2]) <= reach and abs(k[5] - p[4]) <= reach]


def corners(rows):
    return tuple(sum(f(dx, dy) for dx, dy in rows) for f in (lambda x, y: x <= 0 <= y, lambda x, y: x <= 0 and y <= 0, lambda x, y: x >= 0 and y >= 0, lambda x, y: x >= 0 >= y, lambda x, y: True))


def grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def dense(spark, n=3000):
    """One place with n sites of each type and 300 contacts: 300 * n * n pairs."""
    sites = spark.range(2 * n).selectExpr("id as site_id", "1L as chrom", "if(id % 2 = 0, 50, 100) as start", "if(id % 2 = 0, 'F', 'R') as type").selectExpr("site_id", "chrom", "cast(start as long) as start", "type")
    return sites, spark.range(300).selectExpr("id as cell_id", "1L as chrom1", "50L as start1", "1L as chrom2", "100L as start2")


# F5, F12
@pytest.mark.parametrize("seed", [1, 2])
def test_corners(spark, seed):
    sites, contacts, s, c = tables(spark, seed)
    for by, key in ((["cell_id"], lambda r: (r[0][0],)), (["grp", "cell_id"], lambda r: (r[0][1], r[0][0]))):
        want = {k: corners([r[2:] for r in v]) for k, v in grouped(near(sites, contacts), key).items()}
        assert {tuple(r[: len(by)]): tuple(r[len(by) :]) for r in L.quadrants(c, s, BAND, REACH, by).collect()} == want


def test_corners_follow_rows_not_pairs(spark):
    s, c = dense(spark)
    assert L.quadrants(c, s, BAND, REACH, ["chrom1"]).collect()[0].n == 300 * 3000 * 3000


# F8
@pytest.mark.parametrize("seed", [1, 2])
def test_lonely_loops(spark, seed):
    sites, _, s, _ = tables(spark, seed, 24)
    p = pairs(sites)
    want = [a for a in p if not any(a[0] == b[0] and (a[1], a[3]) != (b[1], b[3]) and abs(a[2] - b[2]) <= REACH and abs(a[4] - b[4]) <= REACH for b in p)]
    assert want and sorted(map(tuple, L.lonely(s, BAND, REACH).collect())) == sorted(want)


# F11
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_loop(spark, seed):
    sites, contacts, s, c = tables(spark, seed, 40 * seed, 400)
    want = Counter()
    for k, found in grouped(near(sites, contacts), lambda r: r[0]).items():
        rank = lambda r: (abs(r[2]) + abs(r[3]), r[1][1], r[1][3])
        best = min(map(rank, found))
        want.update((k[0], k[1], r[1][1], r[1][3], r[2], r[3]) for r in found if rank(r) == best)
    got = Counter(map(tuple, L.nearest(c, s, BAND, REACH, ["cell_id", "grp"]).collect()))
    assert got == want


# F13, F14
@pytest.mark.parametrize("bins", [1, 5, 7])
def test_pile_up(spark, bins):
    sites, contacts, s, c = tables(spark, bins)
    for by, key in (((), lambda r: ()), (("grp",), lambda r: (r[0][1],))):
        cell = lambda d: (d + REACH) * bins // (2 * REACH + 1)
        want = Counter((*key(r), cell(r[2]), cell(r[3])) for r in near(sites, contacts))
        assert {tuple(r[: len(by) + 2]): r.n for r in L.pile_up(c, s, BAND, REACH, bins, by).collect()} == want


# F15, F16
@pytest.mark.parametrize("held", [1 << 24, 100])
def test_contacts_of_every_loop(spark, held, monkeypatch):
    monkeypatch.setattr(L, "DENSE", held)
    monkeypatch.setattr(L, "BLOCK", held)
    sites, contacts, s, c = tables(spark, 6)
    close = Counter(r[1] for r in near(sites, contacts, INNER))
    want = {k: (close[k], n) for k, n in Counter(r[1] for r in near(sites, contacts)).items()}
    assert {tuple(r[:5]): tuple(r[5:]) for r in L.counts(c, s, BAND, INNER, REACH).collect()} == want
