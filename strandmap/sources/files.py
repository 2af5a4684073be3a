"""Text formats as DataFrames: FASTQ, FASTA, SAM, fragment and contact tables, run folders, motif tables.

Everything is read by Spark's own readers, so paths may be in any store that Spark reaches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmap.operators import scans as S


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, the split of it that they were read in, and their number in the file.

    A plain file is read in as many splits as Spark cuts it into; a row a split says how many lines come before it, so no
    task holds a whole file. Packed files are one split.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = rows.groupBy(F.col("file").alias("_file"), F.col("split").alias("_split")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    both = rows.join(splits, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    return both.select("value", "file", "split", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line"))


def ranged(records: DataFrame, parts: int) -> DataFrame:
    """Records (file, ord) with ``part``, one of ``parts`` ranges of equally many neighbours over all files in order of their names, from 0."""
    sizes = records.groupBy(F.col("file").alias("_file")).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(1))  # a row a file
    sizes = sizes.select("_file", (F.sum("_n").over(every.orderBy("_file")) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("_total"))
    both = records.join(sizes, F.col("file") == F.col("_file"))
    return both.withColumn("part", F.expr(f"int((_before + ord) div (_total div {parts} + 1))")).drop("_file", "_before", "_total")


def read_fastq(spark: SparkSession, path: str | list[str], hard_trim: int | None = None, min_phred: int | None = None) -> DataFrame:
    """id, seq, qual, file and ord of every record; incomplete ones at a file's end go. ``hard_trim`` cuts reads, ``min_phred`` drops those with a base below it."""
    rows = _lines(spark, path).withColumn("ord", F.floor(F.col("line") / 4))
    records = rows.groupBy("file", "ord").agg(*(F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(n) for i, n in enumerate(("id", "seq", "plus", "qual"))))
    records = records.where(F.col("qual").isNotNull() & F.col("id").startswith("@")).select(F.expr("substring(id, 2)").alias("id"), "seq", "qual", "file", "ord")
    if hard_trim is not None:
        records = records.withColumns({"seq": F.substring("seq", 1, hard_trim), "qual": F.substring("qual", 1, hard_trim)})
    if min_phred is not None:
        records = records.where(~F.col("qual").rlike("[" + re.escape(chr(33)) + "-" + re.escape(chr(32 + min_phred)) + "]")) if min_phred > 0 else records
    return records


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by their number in the file; reads without a mate go."""
    b = second.select("ord", F.col("id").alias("id2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return first.join(b, "ord")


def sampled(records: DataFrame, every: int = 123) -> DataFrame:
    return records.where(F.col("ord") % every == 0)


def read_fasta_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, at (from 0), seq (upper case): the lines of every sequence with the place where they begin; chrom without its chr.

    Headers and places are carried from split to split, so a sequence of any length is read by many tasks.
    """
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(?:chr)?(\S+)", 1))
    rows = _lines(spark, path).withColumn(S.CHUNK, F.col("split")).withColumn("_head", F.when(head.isNotNull(), F.struct("line", head.alias("chrom"))))
    rows = S.scan(rows, ["file"], "line", {"_of": ("last", F.col("_head"), True), "_end": ("sum", F.when(F.col("_head").isNull(), F.length("value")).otherwise(0), True)})
    rows = rows.withColumn("_from", F.when(F.col("_head").isNotNull(), F.col("_end")))
    rows = S.scan(rows, ["file"], "line", {"_begun": ("last", F.col("_from"), True)})
    return rows.where("_head is null and _of is not null").select(F.col("_of.chrom").alias("chrom"), (F.col("_end") - F.length("value") - F.col("_begun")).alias("at"), F.upper("value").alias("seq"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom and seq, lines joined, upper case; chrom without its chr. For sequences of bounded length; ``read_fasta_pieces`` is for any."""
    pieces = read_fasta_pieces(spark, path)
    return pieces.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fields of alignment rows, with read, mate and segment from ids like name:R1SEG0:0:35."""
    return sam_fields(spark.read.text(path))


def sam_fields(lines: DataFrame, *further: str) -> DataFrame:
    """The same of lines (value) that were read in another way, with ``further`` columns of theirs."""
    rows = lines.where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"), *further)
    field = lambda i: F.get("f", F.lit(i))
    pattern = r"^(.*):R(\d)SEG(\d+):(\d+):(\d+)$"
    part = lambda i: F.regexp_extract(field(0), pattern, i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("int")
    return rows.select(F.coalesce(F.nullif(part(1), F.lit("")), field(0)).alias("read_id"), number(2).alias("mate"), number(3).alias("seg"), number(4).alias("rfr"), number(5).alias("rto"), field(1).cast("int").alias("flag"), field(2).alias("chrom"), field(3).cast("long").alias("pos"), field(4).cast("int").alias("mapq"), field(5).alias("cigar"), F.length(field(9)).alias("len"), *further)


def read_frags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="fid long, chrom string, start long, end_ long")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header line; empty if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_adj(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Contact tables, one file a cell, with the file's base name as cell."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="fend1 long, fend2 long, count long")
    return rows.withColumn("cell", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.adj)?$", 1))


def contacts_of(adj: DataFrame, fends: DataFrame) -> DataFrame:
    """Contacts with coordinates: both ends looked up in fends (fend, chr, coord); ends that are not there are null."""
    side = lambda i: fends.select(F.col("fend").alias(f"fend{i}"), F.col("chr").alias(f"chrom{i}"), F.col("coord").alias(f"start{i}"))
    return adj.join(side(1), "fend1", "left").join(side(2), "fend2", "left")


def write_by_code(reads: DataFrame, path: str) -> None:
    """De-multiplexed reads, a folder a barcode."""
    reads.write.partitionBy("code").mode("overwrite").parquet(path)


def run_reads(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of a run's reads and whether they are index reads, from its RunInfo.xml (attributes in any order)."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(<Read\b[^>]*>)"), F.lit(1))).alias("tag"))
    return rows.select(F.regexp_extract("tag", r'Number="(\d+)"', 1).cast("int").alias("number"), F.regexp_extract("tag", r'NumCycles="(\d+)"', 1).cast("int").alias("cycles"), (F.regexp_extract("tag", r'IsIndexedRead="(\w)"', 1) == "Y").alias("index"))


def files_of(spark: SparkSession, glob: str, pattern: str = "") -> DataFrame:
    """Files that a glob and a regular expression name, with their sizes."""
    rows = spark.read.format("binaryFile").load(glob).select("path", "length")
    return rows.where(F.col("path").rlike(pattern)) if pattern else rows


def run_barcodes(run: DataFrame, flowcell: DataFrame, lane: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Barcodes of every lane of every run: three joins on their keys, names cleaned and blanks taken out."""
    from strandmap.functions.sequence import clean_name

    rows = run.join(flowcell, "run_id").join(lane, "flowcell_id").join(barcodes, "lane_id")
    return rows.select("run", "lane", F.replace(F.col("barcode"), F.lit(" "), F.lit("")).alias("barcode"), clean_name(F.col("sample")).alias("sample"))


def motif_energy(seqs: DataFrame, weights: list[list[float]], reverse: bool = False) -> DataFrame:
    """Best and summed log-odds of a position weight matrix (rows of A, C, G, T) over every sequence (chrom, seq); numpy over Arrow batches."""
    import numpy as np
    import pandas as pd

    table = np.asarray(weights, float)
    table = table[::-1, ::-1] if reverse else table

    def scan(batches):
        code = np.full(256, -1)
        code[[65, 67, 71, 84]] = range(4)
        for frame in batches:
            out = []
            for chrom, seq in zip(frame["chrom"], frame["seq"], strict=True):
                x = code[np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8)]
                n = len(x) - len(table) + 1
                if n <= 0:
                    out.append((chrom, None, None))
                    continue
                wide = np.concatenate([table, np.full((len(table), 1), -np.inf)], 1)
                score = sum(wide[k][x[k : k + n]] for k in range(len(table)))
                best = score.max()
                out.append((chrom, float(best), float(best + np.log(np.exp(score - best).sum())) if np.isfinite(best) else None))
            yield pd.DataFrame(out, columns=["chrom", "best", "energy"])

    return seqs.select("chrom", "seq").mapInPandas(scan, "chrom string, best double, energy double")
