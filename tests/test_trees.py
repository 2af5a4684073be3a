"""Trees by rounds of mutual neighbours against closest pairs one by one."""

import numpy as np
import pytest

from strandmap.operators import trees as T

SCHEMA = "row long, col long, v double"


def plainly(rows):
    """Leaf sets and heights of Ward's merges, the closest pair each time."""
    alive = [([i], r.astype(float)) for i, r in rows.items()]
    out = {}
    while len(alive) > 1:
        cost = {}
        for i, (a, x) in enumerate(alive):
            for j, (b, y) in enumerate(alive[:i]):
                cost[j, i] = ((x - y) ** 2).sum() * 2 * len(a) * len(b) / (len(a) + len(b))
        j, i = min(cost, key=cost.get)
        (a, x), (b, y) = alive[j], alive[i]
        out[frozenset(a + b)] = cost[j, i] ** 0.5
        alive = [c for k, c in enumerate(alive) if k not in (i, j)] + [(a + b, (x * len(a) + y * len(b)) / len(a + b))]
    return out


def members(merges):
    sets, out = {}, {}
    for r in sorted(merges, key=lambda r: r.made):
        both = [sets.get((m, x), frozenset([x])) for m, x in ((r.left_made, r.left_row), (r.right_made, r.right_row))]
        sets[r.made, r.row] = both[0] | both[1]
        assert not both[0] & both[1] and r.size == len(both[0] | both[1]) and r.row == min(both[0] | both[1])
        out[both[0] | both[1]] = r.height
    return out


def entries(spark, rows):
    return spark.createDataFrame([(i, c, float(v)) for i, r in rows.items() for c, v in enumerate(r) if v], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [1024, 7])
def test_merges_are_those_of_closest_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = {5 * i + 2: r for i, r in enumerate(np.concatenate([rng.normal(1, 1, (12, 3)), rng.normal(9, 2, (9, 3))]))}
    merges = T.ward(T.leaves(entries(spark, rows)))
    got, want = members(merges.collect()), plainly(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    order = {r.row: r.place for r in T.leaf_order(merges).collect()}
    assert sorted(order) == sorted(rows) and sorted(order.values()) == list(range(len(rows)))
    for group in want:  # every cluster is a run of the order
        places = sorted(order[i] for i in group)
        assert places == list(range(places[0], places[0] + len(group)))


def test_equal_rows_chains_and_gaps(spark):
    same = T.ward(T.leaves(entries(spark, {i: np.array([1.0, 2.0]) for i in range(9)})))
    assert [r.height for r in same.collect()] == [0.0] * 8 and T.leaf_order(same).count() == 9
    chain = {i: np.array([3.0**i]) for i in range(1, 12)}
    assert members(T.ward(T.leaves(entries(spark, chain))).collect()).keys() == plainly(chain).keys()
    odd = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (2, 1, 5.0), (2, None, 1.0), (None, 1, 1.0), (2, 2, float("nan")), (3, 1, None)], SCHEMA)
    assert [(r.left_row, r.right_row, r.height, r.size) for r in T.ward(T.leaves(odd)).collect()] == [(1, 2, 0.0, 2)]


def test_merges_in_order(spark):
    merges = T.ward(T.leaves(entries(spark, {i: np.array([x]) for i, x in enumerate((0.5, 0.6, 5.5, 5.7))}))).orderBy("made").collect()
    assert [(r.left_made, r.left_row, r.right_made, r.right_row) for r in merges] == [(0, 0, 0, 1), (0, 2, 0, 3), (1, 0, 2, 2)]


def test_sides_by_mean_weight(spark):
    rng = np.random.default_rng(3)
    rows = {i: r for i, r in enumerate(rng.normal(5, 2, (17, 2)))}
    weight = {i: float(rng.normal()) for i in rows if i % 5}  # some leaves have none
    merges = T.ward(T.leaves(entries(spark, rows)))
    turned = T.reordered(merges, spark.createDataFrame([(i, w) for i, w in weight.items()], "row long, weight double"))
    assert members(turned.collect()).keys() == members(merges.collect()).keys()
    sets = {}
    for r in sorted(turned.collect(), key=lambda r: r.made):
        a, b = (sets.get((m, x), [x]) for m, x in ((r.left_made, r.left_row), (r.right_made, r.right_row)))
        means = [np.mean([weight[i] for i in s if i in weight] or [np.nan]) for s in (a, b)]
        assert not means[0] > means[1] + 1e-12
        sets[r.made, r.row] = a + b
    assert [r.row for r in T.leaf_order(turned).orderBy("place").collect()] == max(sets.values(), key=len)


def test_no_leaves_or_one(spark):
    one = entries(spark, {4: np.array([1.0])})
    for df in (one, one.limit(0)):
        merges = T.ward(T.leaves(df))
        assert merges.count() == 0 and T.leaf_order(merges).count() == 0
