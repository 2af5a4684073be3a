"""Report queries against their SQL on the smallest tables, and their edge cases."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandmap.operators import reports as R
from strandmap.plans import build, report_queries
from strandmap.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "customer part orders lineitem documents".split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(report_queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(df.select(columns).collect()) == plain(want)


def test_splicing_moves_qualities_along(spark):
    reads = spark.createDataFrame([("ACGTT", "abcde"), ("TTTTT", "abcde"), ("ACGTT", "abc"), (None, "a"), ("", "")], "seq string, qual string")
    assert [tuple(r) for r in R.spliced(reads, ["A", "C+", "G", ".*"], [3, 1]).collect()] == [("TTC", "deb")]


def test_nearest_hit_is_the_closer_one(spark):
    contacts = spark.createDataFrame([(1, 100, 1, 900), (1, 100, 1, 900), (1, 5000, 1, 900)], "chrom1 long, start1 long, chrom2 long, start2 long")
    hits = spark.createDataFrame([(1, 90), (1, 130), (1, 890), (1, 910), (2, 100), (None, 5)], "chrom long, start long")
    assert [(r["x"], r["y"]) for r in R.hit_distances(contacts, hits, hits, 50).collect()] == [(10, -10), (10, -10)]


def test_cut_needs_both_classes(spark):
    rows = spark.createDataFrame([("A", 0.9), ("A", 0.8), ("B", 0.1), ("B", None)], "ab string, v double")
    assert sorted((r["v"], r["cut"], r["label"]) for r in R.cut_by_difference(rows).collect()) == [(0.1, 0.1, "B"), (0.8, 0.1, "A"), (0.9, 0.1, "A")]
    assert R.cut_by_difference(rows.where("ab = 'A'")).count() == 0


def test_orders_put_nulls_last(spark):
    cells = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 1)], "cell_id long, n long")
    got = R.ordered_by(cells, {"by_n": cells["n"], "down": -cells["n"]})
    assert sorted(tuple(r) for r in got.collect()) == [(1, 4, 4), (2, 2, 1), (3, 3, 2), (4, 1, 3)]


def test_empty_tables_stay_empty(spark):
    none = spark.createDataFrame([], "cell_id long, chrom1 long, start1 long, chrom2 long, start2 long, cnt long")
    for f in (R.karyotype, R.duplicate_report, lambda c: R.quality_series(c, (1000, 2000), 4000), lambda c: R.density_2d(c, "start1", "start2", 10.0, 1.0, 1)):
        assert f(none).count() == 0


def test_tables_are_built_once(spark, tmp_path):
    contacts, tor, cells = (view(spark, SF, v) for v in ("contacts", "tor", "cells"))
    plans = build.tables(contacts, tor, cells, report_queries.BANDS)
    got = build.build_all(spark, {k: plans[k] for k in ("karyotype", "cell_stats")}, str(tmp_path))
    assert got["cell_stats"].count() == contacts.select("cell_id").distinct().count()
    refused = {"karyotype": lambda: pytest.fail("built again")}
    assert build.build_all(spark, refused, str(tmp_path))["karyotype"].count() == got["karyotype"].count()
    assert build.load(spark, str(tmp_path), "none") is None
    assert set(plans) >= {"insulation", "fine_decay", "replication"}


def test_alignments_become_contacts(spark, tmp_path):
    row = "{}:R1SEG{}:{}:{}\t{}\tchr1\t{}\t40\t50M\t*\t0\t0\t" + "A" * 50 + "\t" + "I" * 50
    rows = ["@HD", *(row.format(r, s, 50 * s, 50 * s + 50, 0, at) for r in ("a", "b") for s, at in ((0, 1100), (1, 5200)))]
    (tmp_path / "x.sam").write_text("\n".join(rows) + "\n")
    frags = spark.createDataFrame([(i, c, i * 1000, i * 1000 + 1000) for i in range(1, 8) for c in ("chr1",)], "fid long, chrom string, start long, end_ long")
    got = build.contacts_from_sam(spark, str(tmp_path / "x.sam"), frags).collect()
    assert [(r["fend1"] // 2, r["fend2"] // 2, r["mol"], r["reads"]) for r in got] == [(1, 5, 1, 2)]
    assert got[0]["chrom1"] == got[0]["chrom2"] == "chr1"
