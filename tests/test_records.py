"""Files in many splits with borders inside records; tables that are published whole or not at all."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandmap.operators.annotation import natural_key
from strandmap.sources import files as R
from strandmap.sources import pair_tables as P


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "700")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def reads(n, seed, name):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 300) for _ in range(n)]
    return [(f"{name}{i}", "".join(rng.choice("ACGT") for _ in range(k)), "".join(chr(rng.randint(33, 73)) for _ in range(k))) for i, k in enumerate(sizes)]


def fastq(rows):
    return "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rows)


def test_every_record_once_from_many_splits(spark, tmp_path, small_splits):
    a, b, c = reads(200, 1, "a"), reads(3, 2, "b"), reads(60, 3, "c")
    (tmp_path / "a.fastq").write_text(fastq(a))
    (tmp_path / "b.fastq").write_text(fastq(b) + "@cut\nACGT\n")  # an incomplete last record
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as f:
        f.write(fastq(c))
    lines = R._lines(spark, str(tmp_path))
    assert lines.where("file like '%a.fastq'").select("split").distinct().count() > 50
    got = R.read_fastq(spark, str(tmp_path))
    assert sorted((r.id, r.seq, r.qual) for r in got.collect()) == sorted(a + b + c)
    assert [r.id for r in got.where("file like '%a.fastq'").orderBy("ord").collect()] == [x[0] for x in a]
    parts = R.ranged(got, 4).groupBy("part").agg(F.count("*").alias("n"), F.min(natural_key(F.concat_ws("/", "file", F.col("ord").cast("string")))).alias("first")).orderBy("part").collect()
    assert [r.n for r in parts] == [66, 66, 66, 65] and [r.first for r in parts] == sorted(r.first for r in parts)


def test_sequences_longer_than_a_split(spark, tmp_path, small_splits):
    rng = random.Random(5)
    whole = {name: "".join(rng.choice("acgtN") for _ in range(n)) for name, n in (("1", 5000), ("2", 0), ("X", 61), ("M", 60))}
    text = "".join(f">chr{k} some words\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for k, s in whole.items())
    (tmp_path / "g.fa").write_text("before any header\n" + text)
    got = {}
    for r in R.read_fasta_pieces(spark, str(tmp_path)).collect():
        assert whole[r.chrom][r["at"] : r["at"] + len(r.seq)].upper() == r.seq
        got[r.chrom] = got.get(r.chrom, 0) + len(r.seq)
    assert got == {k: len(s) for k, s in whole.items() if s}
    assert {r.chrom: r.seq for r in R.read_fasta(spark, str(tmp_path)).collect()} == {k: s.upper() for k, s in whole.items() if s}


PAIRS = "fend1 long, fend2 long, count long"


def test_pairs_come_back_and_ranges_open_few_files(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(0, 999), rng.randint(0, 999), rng.randint(1, 9)) for _ in range(800)] + [(500, 1, 1)] * 300
    path = str(tmp_path / "adj")
    P.write_pairs(spark.createDataFrame(rows, PAIRS).repartition(5), path, files=8)
    assert sorted(map(tuple, P.read_pairs(spark, path).collect())) == sorted(rows)
    some = P.read_pairs(spark, path, 100, 220)
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if 100 <= r[0] < 220)
    assert len(some.inputFiles()) < len(P.read_pairs(spark, path).inputFiles())
    assert P.read_pairs(spark, path, 5000).count() == 0
    for name in P.read_pairs(spark, path).inputFiles():
        keys = [(r.fend1, r.fend2) for r in spark.read.parquet(name).collect()]
        assert keys == sorted(keys)


def test_nothing_shows_before_it_is_whole(spark, tmp_path):
    path = str(tmp_path / "adj")
    assert P.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        P.read_pairs(spark, path)
    first = P.write_pairs(spark.createDataFrame([(1, 2, 3)], PAIRS), path)
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error("lost")).otherwise(F.col("id")).cast("long").alias("fend1"), F.col("id").alias("fend2"), F.lit(1).cast("long").alias("count"))
    with pytest.raises(Exception, match="lost"):
        P.write_pairs(broken, path)
    with pytest.raises(Exception, match="fend2 is null"):
        P.write_pairs(spark.createDataFrame([(1, None, 3)], PAIRS), path)
    assert P.current(spark, path) == first and P.read_pairs(spark, path).collect()[0][:] == (1, 2, 3)
    second = P.write_pairs(spark.createDataFrame([], PAIRS), path)
    assert P.current(spark, path) == second and P.read_pairs(spark, path).count() == 0
    P.drop_old(spark, path)
    assert sorted(x.name for x in (tmp_path / "adj").iterdir() if not x.name.startswith(".")) == sorted(["CURRENT", f"data-{second}", f"index-{second}", f"schema-{second}"])


def test_a_killed_task_is_run_again(spark, tmp_path):
    marker = tmp_path / "died"

    def die_once(batches):
        import os

        for batch in batches:
            if batch["fend1"].to_numpy().max() == 299 and not marker.exists():
                marker.write_text("x")
                os._exit(1)
            yield batch

    rows = [(i, i % 7, 1) for i in range(300)]
    df = spark.createDataFrame(rows, PAIRS).repartition(3).mapInArrow(die_once, PAIRS)
    try:
        P.write_pairs(df, str(tmp_path / "adj"))
    except Exception:  # local masters do not run a task twice
        assert P.current(spark, str(tmp_path / "adj")) is None
        P.write_pairs(df, str(tmp_path / "adj"))
    assert marker.exists() and sorted(map(tuple, P.read_pairs(spark, str(tmp_path / "adj")).collect())) == sorted(rows)


def test_both_orders_of_a_pair_are_one(spark):
    rows = [(3, 1, 2), (1, 3, 5), (2, 2, 1)]
    assert sorted(map(tuple, P.merged(spark.createDataFrame(rows, "fend1 long, fend2 long, mol long")).collect())) == [(1, 3, 7), (2, 2, 1)]


def test_motif_energy_does_not_overflow(spark):
    weights = [[400.0, -400.0, -400.0, -400.0]] * 3
    got = {r.chrom: (r.best, r.energy) for r in R.motif_energy(spark.createDataFrame([("a", "AAA"), ("c", "CCCC"), ("n", "NNN")], "chrom string, seq string"), weights).collect()}
    assert got["a"] == (1200.0, 1200.0) and got["c"][0] == -1200.0 and abs(got["c"][1] + 1200 - 0.6931471805599453) < 1e-9 and got["n"][1] is None
