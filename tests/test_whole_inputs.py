"""Queries over whole inputs, against brute force on small tables."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from strandmap.plans.contact_queries import _OCT
from strandmap.plans.fixtures import duckdb_sql

TEXTS = [(1, "the quick brown fox jumps over the lazy dog and " * 7), (2, "short one"), (3, "x" * 40), (4, ""), (5, None), (6, "abcdefghijklmnopqrstuvwxyz" * 5 + "abc")]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def sequences():
    table = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return {i: re.sub("[^a-z]", "", t.lower()).translate(table) for i, t in TEXTS if t is not None}


def reads():
    return [(i, q[k : k + 40]) for i, q in sequences().items() for k in range(0, len(q), 40)]


def quals(seq):
    return [ord(c) - 33 for c in seq.translate(str.maketrans("ACGT", "#+5I"))]


def rounded(rows):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def ask(spark, at, name, *columns):
    return rounded(entry.queries()[name](spark, at).select(*columns).collect())


def test_reads_cover_every_letter(spark, texts):
    got = [r.n for r in entry.queries()["b01_demultiplexed"](spark, texts).collect()]
    assert sum(got) == len(reads()) and sum(len(s) for _, s in reads()) == sum(map(len, sequences().values()))
    assert ask(spark, texts, "c03_share_of_good", "doc_id", "share", "mean") == rounded((i, sum(x >= 20 for x in quals(s)) / len(s), sum(quals(s)) / len(s)) for i, s in reads())


def test_profile_and_trim_position(spark, texts):
    def shares(least):
        at = [[quals(s)[k] >= least for _, s in reads() if len(s) > k] for k in range(40)]
        return [sum(x) / len(x) for x in at]

    assert ask(spark, texts, "c04_quality_profile", "pos", "share") == rounded(enumerate(shares(20)))
    assert ask(spark, texts, "c06_trim_position", "pos") == Counter({(min((k for k, x in enumerate(shares(10)) if k >= 19 and x < 0.99), default=None),): 1})
    assert ask(spark, texts, "c07_trimmed", "doc_id", "seq") == Counter((i, s[:25]) for i, s in reads() if sum(quals(s[:25])) / len(s[:25]) >= 18)


def test_barcodes_of_all_reads(spark, texts):
    assert ask(spark, texts, "c09_barcodes", "code", "n") == Counter(Counter(f"{s[:2]}_{s[2:4]}" if len(s) >= 4 else None for _, s in reads()).items())
    assert ask(spark, texts, "b01_demultiplexed", "code", "n") == Counter(Counter(s[:3] if s[:3] in ("ACG", "CAT", "GGA") else "NoCode" for _, s in reads()).items())
    codes = Counter(s[:3] for _, s in reads() if len(s) >= 3)
    assert ask(spark, texts, "f10_barcode_report", "barcode", "n", "freq", "expected") == rounded((b, n, n / len(reads()), b in ("ACG", "TTT")) for b, n in codes.items() if n / len(reads()) >= 0.02 or b in ("ACG", "TTT"))


SF = "/root/testdata/sf0.001"
#: What narrows each query's SQL to part of its input; without it, the SQL is over all rows.
NARROW = {
    "n13_tiles": " WHERE doc_id % 20 = 0",
    "e01_nearest_fragment": " WHERE cell_id < 8",
    "k04_correlations": " AND b.cell_id < 12",
    "c36_shades": " WHERE cell_id < 4",
    "c33_expanded_2d": " WHERE cell_id = 3",
    "c34_short_numbers": " WHERE cell_id = 1",
    "e07_offsets_merged": " WHERE cell_id = 1",
    "l06_genome_map": " WHERE cell_id = 2",
    "j06_union": " WHERE fid % 5 = 0",
    "j07_intersection": " AND fid % 3 = 0",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part", "customer", "documents"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def equal(spark, con, name, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    six = lambda rows: Counter(tuple(float(f"{v:.6g}") if isinstance(v, float) else v for v in r) for r in rows)
    assert six(got.select(columns).collect()) == six(found.fetchall())


@pytest.mark.parametrize("name", sorted(NARROW))
def test_query_takes_all_rows(spark, con, name):
    sql = entry.oracle_sql()[name]
    equal(spark, con, name, sql.replace(NARROW[name], ""))


def test_decays_of_all_cells(spark, con):
    equal(spark, con, "f42_decays_side_by_side", duckdb_sql(_OCT + " SELECT octave, cell_id, count(*) AS n FROM o GROUP BY ALL", "contacts"))
