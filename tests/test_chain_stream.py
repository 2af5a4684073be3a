"""Chains from a stream against those of the batch: reads cut by micro-batches, restarts, late rows, state that goes."""

import datetime as dt
import random

from pyspark.sql import functions as F

from strandmap.operators import chains as H
from strandmap.streaming import chains as SC

SAM = "read_id string, mate int, seg int, rfr int, rto int, flag int, chrom string, pos long, mapq int, cigar string, len int, seen timestamp"
BEGIN = dt.datetime(2020, 1, 1)


def at(seconds):
    return BEGIN + dt.timedelta(seconds=seconds)


def segments():
    rng, rows = random.Random(3), []
    for r in range(40):
        first = r * 20
        for mate in (1, 2):
            for seg in range(rng.randint(0 if mate == 2 else 1, 3)):
                rows.append((f"r{r}", mate, seg, seg * 30, seg * 30 + 30, rng.choice([0, 16]), rng.choice("12"), rng.randint(1, 5000), 40, "30M", 30, at(first + rng.randint(0, 8))))
    return rows


def plain(df):
    return sorted((r.read_id, r.err, [tuple(h) for h in r.hits]) for r in df.collect())


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, SAM).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, out, state):
    stream = spark.readStream.schema(SAM).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    query = SC.start(SC.chain_stream(stream, "10 seconds", "5 seconds"), out, state)
    query.awaitTermination()
    return query


def test_chains_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = sorted(segments(), key=lambda r: r[-1])
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    cut = [rows[i : i + 17] for i in range(0, len(rows), 17)]  # borders inside reads
    half = len(cut) // 2
    for i, part in enumerate(cut[:half]):
        write(spark, part, folder, f"a{i:02d}")
    run(spark, folder, out, state)
    early = plain(spark.read.schema(H.CHAIN).parquet(out))
    for i, part in enumerate(cut[half:]):
        write(spark, part, folder, f"b{i:02d}")
    write(spark, [("end", 1, 0, 0, 30, 0, "1", 1, 40, "30M", 30, at(5000))], folder, "c0")
    query = run(spark, folder, out, state)  # goes on where the first run stopped
    want = plain(H.chains(H.usable_segments(spark.createDataFrame(rows, SAM))))
    assert 0 < len(early) < len(want)
    assert plain(spark.read.schema(H.CHAIN).parquet(out)) == want
    assert query.lastProgress["stateOperators"][0]["customMetrics"] is not None
    assert sum(p["observedMetrics"]["segments"]["rows"] for p in query.recentProgress if "segments" in p["observedMetrics"]) == sum(map(len, cut[half:])) + 1
    run(spark, folder, out, state)  # nothing new
    assert plain(spark.read.schema(H.CHAIN).parquet(out)) == want


def test_rows_behind_the_watermark_go(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    row = lambda read, second, seg=0: (read, 1, seg, 0, 30, 0, "1", 100, 40, "30M", 30, at(second))
    write(spark, [row("a", 0), row("b", 100)], folder, "a0")
    run(spark, folder, out, state)
    write(spark, [row("a", 1, 1), row("c", 300)], folder, "a1")  # a was closed long ago
    run(spark, folder, out, state)
    assert [(r.read_id, len(r.hits)) for r in spark.read.schema(H.CHAIN).parquet(out).orderBy("read_id").collect()] == [("a", 1), ("b", 1)]


def test_sam_text_streams_with_its_files_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.sam").write_text("@HD\n" + "\t".join(["r:R1SEG0:0:30", "0", "1", "100", "40", "30M", "*", "0", "0", "A" * 30, "I" * 30]) + "\n")
    stream = SC.segment_stream(spark, str(tmp_path / "in"))
    assert stream.isStreaming and stream.schema["seen"].dataType.simpleString() == "timestamp"
    query = stream.writeStream.format("memory").queryName("sam_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("sam_rows").select("read_id", "mate", "seg", "pos", "len", F.col("seen").isNotNull()).collect()
    assert [tuple(r) for r in got] == [("r", 1, 0, 100, 30, True)]
