"""Neighbours by divergence and eigenvectors of graphs against dense numpy."""

import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from strandmap.operators import projection as PR

SF = "/root/testdata/sf0.001"


def dense(edges):
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for i, j in edges:
        a[at[i], at[j]] = a[at[j], at[i]] = 1
    return nodes, *np.linalg.eigh(np.diag(a.sum(1)) - a)


@pytest.mark.parametrize(("n", "steps"), [(40, 3)])
def test_eigenvectors_of_a_graph(spark, n, steps):
    rng = random.Random(n)
    edges = [(7 * i, 7 * (i + 1)) for i in range(n - 1)] + [(7 * rng.randrange(n), 7 * rng.randrange(n)) for _ in range(4 * n)]
    edges = [e for e in edges if e[0] != e[1]]
    nodes, values, vectors = dense(edges)
    df = spark.createDataFrame([*edges, *edges[:9], (7, 7), (None, 3)], "i long, j long").repartition(3)
    got, found = PR.embedding(df, 2, steps=steps)
    rows = {r.node: r.vector for r in got.collect()}
    assert sorted(rows) == nodes
    assert np.allclose(found, values[1:3], atol=1e-9)
    have = np.array([rows[x] for x in nodes])
    want = vectors[:, 1:3]
    want = want * np.sign(want[np.abs(want).argmax(0), [0, 1]])
    assert np.abs(have - want).max() < 1e-6


def test_graphs_in_parts_and_small_ones(spark):
    two = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    got, values = PR.embedding(spark.createDataFrame(two, "i long, j long"), 2)
    v = {r.node: r.vector[0] for r in got.collect()}
    assert np.allclose(values, [0, 3], atol=1e-9)
    assert np.allclose([v[0], v[1], v[3], v[4]], [v[2], v[2], v[5], v[5]], atol=1e-9) and v[0] * v[3] < 0
    pair, values = PR.embedding(spark.createDataFrame([(5, 9)], "i long, j long"), 2)
    assert np.allclose(values, [2.0]) and {r.node: round(r.vector[0], 9) for r in pair.collect()} == {5: round(0.5**0.5, 9), 9: -round(0.5**0.5, 9)}
    none, values = PR.embedding(spark.createDataFrame([(1, 1)], "i long, j long"), 2)
    assert none.count() == 0 and values == []
    with pytest.raises(ValueError, match="rounds"):
        PR.embedding(spark.createDataFrame([(i, i + 1) for i in range(300)], "i long, j long"), 2, rounds=1, steps=1)


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(PR, "BLOCK", 7)
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, (30, 6))
    counts[11] = counts[4]  # equal profiles
    entries = [(i, c, float(x)) for i, r in enumerate(counts) for c, x in enumerate(r) if x]
    df = spark.createDataFrame([*entries, (None, 0, 1.0), (3, None, 1.0)], "row long, col long, v double")
    p = np.where(counts == 0, 1, counts) / np.where(counts == 0, 1, counts).sum(1, keepdims=True)
    d = np.round(((p[:, None] - p) * (np.log(p)[:, None] - np.log(p))).sum(2), 9)
    want = {(i, int(j), r) for i in range(30) for r, j in enumerate(sorted(set(range(30)) - {i}, key=lambda j: (d[i, j], j))[:4], 1)}
    assert {(r.row, r.to_row, r["rank"]) for r in PR.nearest_profiles(PR.shares(df), 4).collect()} == want
    assert PR.projected(df.limit(0))[0].count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from read_parquet('{SF}/lineitem.parquet')")
    found = con.sql(entry.oracle_sql()["g32_projection"])
    got = entry.queries()["g32_projection"](spark, SF).select(found.columns).collect()
    assert len(got) == 64
    assert sorted(tuple(r) for r in got) == sorted(found.fetchall())
