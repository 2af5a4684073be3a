"""Peaks against one-by-one choice; k-means with gaps against plain numpy; kept tables by key."""

import random

import numpy as np
import pytest

from strandmap.operators import clusters as CL
from strandmap.operators import peaks as PK
from strandmap.plans import build


@pytest.mark.parametrize("distance", [1, 40, 1000])
def test_rounds_choose_what_one_by_one_does(spark, distance):
    rng = random.Random(distance)
    bins = {(rng.choice("ab"), 1, 10 * rng.randint(0, 120)): rng.randint(1, 6) for _ in range(150)}
    want = []
    for k, n in sorted(bins.items(), key=lambda x: (-x[1], x[0][2])):
        if all(k[0] != a[0] or abs(k[2] - a[2]) >= distance for a in want):
            want.append(k)
    df = spark.createDataFrame([(*k, n) for k, n in bins.items()], "key string, chrom long, at long, n long").repartition(3)
    assert sorted((r.key, r.chrom, r["at"]) for r in PK.apart(df, distance).collect()) == sorted(want)
    assert PK.apart(df.limit(0), distance).count() == 0


def test_peaks_with_fragments(spark):
    rows = [("k", 1, 100 * i + 1, i) for i in range(60)] + [("k", 1, 2050, 20)] * 40 + [("k", 1, 2150, 21)] * 30 + [("k", 1, 1950, 19)] * 9 + [("few", 1, 5, 0)] * 9 + [(None, 1, 5, 0), ("k", 1, None, None)]
    frags = spark.createDataFrame([(1000 + i, 1, 2000 + 10 * i, 2009 + 10 * i) for i in range(9)] + [(20, 1, 2045, 2050)], "fid long, chrom long, start long, end_ long")
    points = spark.createDataFrame(rows, "key string, chrom long, pos long, fid long")
    got = PK.peaks_by_key(points, frags, 100, 2, 10.0, 3.0, 300, 50)
    assert [tuple(r) for r in got.collect()] == [("k", 1, 2100, 41, 1003)]
    assert PK.peaks_by_key(points, frags, 100, 2, 10.0, 3.0, 300, 50, alone=True).count() == 1


def test_kmeans_with_missing_values(spark):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 1, (30, 5)), rng.normal(4, 1, (30, 5)), rng.normal((0, 8, 0, 8, 0), 1, (30, 5))])
    rows[rng.random(rows.shape) < 0.2] = np.nan
    entries = [(i, c, float(v)) for i, r in enumerate(rows) for c, v in enumerate(r) if not np.isnan(v)]
    df = spark.createDataFrame([*entries, (500, 99, 1.0), (None, 1, 1.0), (3, 4, None)], "row long, col long, v double").repartition(4)
    first = spark.createDataFrame([(k, c, float(x)) for k, i in enumerate((0, 30, 60)) for c, x in enumerate(np.nan_to_num(rows[i]))], "cluster int, col long, c double")
    labels, _ = CL.kmeans(df, first, 3, 5)
    centre = np.nan_to_num(rows[[0, 30, 60]])
    for _ in range(6):
        label = np.round(np.nanmean((rows[:, None] - centre[None]) ** 2, 2), 9).argmin(1)
        centre = np.array([np.nanmean(rows[label == k], 0) for k in range(3)])
    assert {r.row: r.cluster for r in labels.collect()} == dict(enumerate(label.tolist()))  # row 500 shares no column
    ordered = {r.row: r.cluster for r in CL.by_order_of_means(labels, df.where("row < 90")).collect()}
    assert len({(label[i], ordered[i]) for i in ordered}) == 3
    chosen = CL.seeds(df.where("row < 90"), 3)
    assert chosen.select("cluster").distinct().count() == 3
    assert CL.seeds(df.limit(0), 3).count() == 0


def test_tables_of_other_parameters_are_others(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    keys = [build.key_of(spark, {"n": n}, source) for n in (1, 2, 1)]
    assert keys[0] == keys[2] != keys[1]
    for n, key in enumerate(keys[:2], 1):
        assert build.build_all(spark, {"t": lambda n=n: source.limit(n)}, str(tmp_path / "out"), key=key)["t"].count() == n
    spark.range(7).write.mode("append").parquet(str(tmp_path / "in"))
    assert build.key_of(spark, {"n": 1}, spark.read.parquet(str(tmp_path / "in"))) != keys[0]
