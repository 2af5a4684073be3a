"""Chunked scans against plain loops: chunks of every size, missing chunks, ties, nulls, empty tables, hot places."""

import random

import pytest
from pyspark.sql import functions as F

from strandmap.operators import intervals as I
from strandmap.operators import maps as MA
from strandmap.operators import scans as S
from strandmap.operators import statistics as K
from strandmap.operators import windows as W


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_running_values(spark, width):
    rng = random.Random(width)
    places = sorted(rng.sample(range(-500, 3000), 400))
    rows = [(rng.choice(["a", None]), p, rng.choice([None, -3, 0, 1, 9])) for p in places]
    df = spark.createDataFrame(rows, "k string, p long, v long").repartition(5)
    found = {"total": ("sum", F.col("v"), True), "before": ("sum", F.col("v"), False), "most": ("max", F.col("v"), True), "earlier": ("max", F.col("v"), False), "last": ("last", F.col("v"), False)}
    got = {(r.k, r.p): (r.total, r.before, r.most, r.earlier, r.last) for r in S.scan(S.by_cells(df, "p", width), ["k"], "p", found).collect()}
    want, seen = {}, {"a": [], None: []}
    for k, p, v in rows:
        old = [x for x in seen[k] if x is not None]
        new = old + ([v] if v is not None else [])
        want[k, p] = (sum(new), sum(old), max(new, default=None), max(old, default=None), old[-1] if old else None)
        seen[k].append(v)
    assert got == want


def merged(rows, gap):
    out = []
    for c, s, e in sorted(rows):
        if out and out[-1][0] == c and s <= out[-1][2] + gap:
            out[-1][2], out[-1][3] = max(out[-1][2], e), out[-1][3] + 1
        else:
            out.append([c, s, e, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("gap,cell", [(0, 10), (0, 1000), (25, 64), (0, 10**6)])
def test_canonic_across_cells(spark, gap, cell):
    rng = random.Random(gap + cell)
    rows = [(rng.randint(1, 3), s := rng.randint(0, 5000), s + rng.choice([1, 5, 40, 900])) for _ in range(150)]
    rows += [(1, 0, 5000)] + [(2, 77, 80)] * 50
    df = spark.createDataFrame(rows, "chrom long, start long, end_ long").repartition(4)
    assert sorted((r.chrom, r.start, r.end_, r.n) for r in I.canonic(df, gap=gap, cell=cell).collect()) == merged(rows, gap)
    assert I.canonic(df.where("chrom > 9")).count() == 0


@pytest.mark.parametrize("size,first", [(1, 0), (1, -3000), (500, 120)])
def test_screen_over_chunk_borders(spark, size, first):
    rng = random.Random(size)
    bins = [(c, first + size * i, rng.random() < 0.995) for c in (1, 2) for i in range(4200)]
    df = spark.createDataFrame(bins + bins[:10], "chrom long, start long, ok boolean").repartition(3)
    want = [(c, s, e, (e - s) // size) for c, s, e, _ in merged([(c, s, s + size) for c, s, ok in bins if ok], 0)]
    assert sorted((r.chrom, r.start, r.end_, r.n) for r in I.screen(df, F.col("ok"), size).collect()) == want


def test_orders_of_numbers(spark):
    rng = random.Random(2)
    values = [rng.choice([0.5, 0.5, rng.random(), -rng.random() * 1e9, 2.0**60]) for _ in range(500)]
    df = spark.createDataFrame([(v, rng.randint(0, 1)) for v in values] + [(None, 1)], "v double, g long").repartition(4)
    ordered = sorted(values)
    got = {r.v: (r.t, r.r) for r in K.value_ranks(df, "v").collect()}
    assert got == {v: (ordered.count(v), ordered.index(v) + (ordered.count(v) + 1) / 2) for v in set(values)}
    assert K.value_ranks(df.where("v is null"), "v").count() == 0


def test_runs_offsets_and_gaps(spark):
    rng = random.Random(4)
    rows = [(i * 3, rng.choice("xy"), rng.randint(0, 5), rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "o long, b string, p long, q long").repartition(4)
    want, at, best = [], 0, None
    for i, (o, b, p, q) in enumerate(rows):
        if want and want[-1][0] == b:
            want[-1] = (b, want[-1][1], want[-1][2] + 1, o)
        else:
            want.append((b, o, 1, o))
    assert sorted((r.b, r.first, r.length, r.last) for r in W.runs(df, "o", "b").collect()) == sorted(want)
    offset, gap = {}, 0
    for o, _, p, q in rows:
        offset[o] = at
        at += p
        gap += q - p
        best = (gap, o) if best is None or gap > best[0] else best
    assert {r.o: r.offset for r in W.offsets(df, "o", "p").collect()} == offset
    assert [(r.gap, r.o) for r in W.widest_gap(df, "o", "p", "q").collect()] == [best]


def test_insulation_of_fine_edges(spark):
    rng = random.Random(9)
    rows = [(1, s := rng.randint(0, 3000), 1, s + rng.randint(0, 900), rng.randint(1, 3)) for _ in range(200)] + [(1, 10, 2, 20, 1), (2, 5, 2, 40, 2)]
    df = spark.createDataFrame(rows, "chrom1 long, start1 long, chrom2 long, start2 long, cnt long")
    for scale, res in ((200, 10), (130, 7)):
        want = set()
        for c in (1, 2):
            for at in range(0, 5000, res):
                inside = [r for r in rows if r[0] == r[2] == c and 20 <= r[3] - r[1] < 2 * scale and r[1] >= at - scale and r[3] < at + scale]
                if inside:
                    want.add((c, at, sum(r[4] for r in inside), sum(r[4] for r in inside if r[1] < at <= r[3])))
        got = [(r.chrom, r.start, r.big, r.ins) for r in MA.insulation(df, scale, res, 20).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_window_takes_a_whole_chromosome(spark):
    df = spark.createDataFrame([(1, 5, 9)], "chrom long, start long, end_ long")
    plan = I.canonic(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("_chunk" in x for x in windows)
