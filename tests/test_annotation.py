"""Annotation and chain queries against their SQL on the smallest tables, and their edge cases."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandmap.operators import annotation as A
from strandmap.plans import annotation_queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "customer part orders lineitem documents".split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(annotation_queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert want and plain(df.select(columns).collect()) == plain(want)


def test_places_without_bins_keep_their_row(spark):
    places = spark.createDataFrame([(1, 1, 0, 10), (2, 9, 0, 10), (3, 1, 500, 500)], "id long, chrom long, start long, end_ long")
    track = spark.createDataFrame([(1, 0, 2.0), (1, 100, None)], "chrom long, start long, v double")
    got = {r["id"]: (r["n"], r["weighted"]) for r in A.window_values(places, track, "id", 100, 0, 95).collect()}
    assert got == {1: (1, 200.0), 2: (0, None), 3: (0, None)}


def test_natural_order(spark):
    names = spark.createDataFrame([("b10",), ("b2",), ("a",), ("b002x",)], "n string")
    assert [r["n"] for r in names.orderBy(A.natural_key(names["n"]), "n").collect()] == ["a", "b2", "b002x", "b10"]


def test_shuffling_keeps_both_sides(spark):
    rows = [(1, i % 7, 2, 100 + i) for i in range(50)]
    contacts = spark.createDataFrame([*rows, *rows[:5]], "chrom1 long, start1 long, chrom2 long, start2 long")
    got = [tuple(r) for r in A.shuffled(contacts, "x", 1).collect()]
    assert sorted(r[:2] for r in got) == sorted(r[:2] for r in [*rows, *rows[:5]])
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in [*rows, *rows[:5]])
    assert sorted(got) != sorted([*rows, *rows[:5]])


def test_baits_and_kinds_of_contacts(spark):
    kinds = spark.createDataFrame([(["F", "R"], "F"), (["C"], "N"), (["R", "C"], "F"), ([], "N")], "k array<string>, b string")
    typed = kinds.withColumn("a", A.side_type(kinds["k"]))
    got = [tuple(r) for r in typed.select("a", A.contact_type(typed["a"], typed["b"])).collect()]
    assert got == [("B", "conv"), ("C", "chip"), ("R", "conv"), ("N", "none")]
