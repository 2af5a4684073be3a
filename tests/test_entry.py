"""Registered queries against their SQL on the smallest tables, and incremental ingestion."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandmap.plans import MODULES
from strandmap.plans.fixtures import view
from strandmap.streaming import decay

SF = "/root/testdata/sf0.001"
NAMES = ["f16_coarse_decay", "f19_fine_decay", "f22_marginal_z", "e13_two_nearest", "g02_insulation", "h01_cyclic_mean", "j05_canonic", "k02_rank_sum", "f11_digest"]


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(df.select(columns).collect()) == plain(want)


def test_every_query_has_sql_but_clusterings():
    missing = {n for m in MODULES for n in m.QUERIES} - {n for m in MODULES for n in m.SQL}
    assert missing <= {"g19_decay_clusters"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_ingestion_adds_up(spark, tmp_path):
    rows = view(spark, SF, "contacts").select("cell_id", "chrom1", "start1", "chrom2", "start2", "cnt")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        decay.ingest(decay.contact_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = {tuple(r) for r in entry.queries()["f19_fine_decay"](spark, SF).select("cell_id", "bin", "n").collect()}
    assert {tuple(r) for r in decay.totals(spark, str(tmp_path / "out")).collect()} == want
