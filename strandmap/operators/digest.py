"""Restriction digests of sequences, fragment tables and barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.functions.sequence import barcode, piece_ends, pieces


def digest(seqs: DataFrame, site: str = "GATC", max_len: int = 10**9) -> DataFrame:
    """Fragments between recognition sites of every sequence (chrom, seq): fid, start, end_, length, base counts, gc; what follows the last site is no fragment."""
    parts = seqs.select("chrom", F.startswith("seq", F.lit(site)).cast("int").alias("_first"), pieces(F.col("seq"), site).alias("_parts"))
    parts = parts.select("chrom", "_first", "_parts", piece_ends(F.col("_parts")).alias("_ends"))
    body, whole = F.col("p.body"), F.size("_parts") - 1
    cuts = parts.select("chrom", "_first", F.posexplode(F.arrays_zip(F.slice("_parts", 1, whole).alias("body"), F.slice("_ends", 1, whole).alias("end"))).alias("_at", "p"))
    count = lambda b: F.length(body) - F.length(F.replace(body, F.lit(b), F.lit("")))
    rows = cuts.select("chrom", (F.col("_at") + F.col("_first")).alias("k"), (F.col("p.end") - F.length(body)).alias("start"), F.col("p.end").alias("end_"), F.length(body).alias("length"), *(count(b).alias(f"n_{b.lower()}") for b in "ACGT"))
    return rows.where(F.col("length") <= max_len).withColumn("gc", F.floor((F.col("n_g") + F.col("n_c")) / F.col("length") * 1000) / 1000)


def length_histogram(frags: DataFrame, size: int, most: int) -> DataFrame:
    return frags.groupBy((F.least(F.floor(F.col("length") / size), F.lit(most // size)) * size).alias("bin")).agg(F.count("*").alias("n"))


def fends(frags: DataFrame) -> DataFrame:
    """Both ends of every fragment, one base long."""
    ends = F.explode(F.array(F.struct((F.col("fid") * 2).alias("fend"), F.col("start").alias("coord"), (F.col("start") + 1).alias("coord_end")), F.struct((F.col("fid") * 2 + 1).alias("fend"), (F.col("end_") - 1).alias("coord"), F.col("end_").alias("coord_end"))))
    return frags.select("chrom", ends.alias("e")).select("e.fend", "chrom", "e.coord", "e.coord_end")


def barcode_report(reads: DataFrame, length: int, expected: list[str], least: float = 0.01) -> DataFrame:
    """Barcodes with their reads and share of all reads (those with N included); kept from ``least`` on or if expected."""
    code = barcode(F.col("seq"), length)
    n = reads.groupBy(code.alias("barcode")).agg(F.count("*").alias("n"))
    rows = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).withColumn("freq", F.col("n") / F.col("_all")).drop("_all")
    known = F.col("barcode").isin(expected)
    return rows.where(F.col("barcode").isNotNull() & ((F.col("freq") >= least) | known)).withColumn("expected", known)


def demultiplex(reads: DataFrame, length: int, expected: list[str]) -> DataFrame:
    """Reads with the barcode that they belong to, NoCode for others; write with partitionBy('code')."""
    code = barcode(F.col("seq"), length)
    return reads.withColumn("code", F.when(code.isin(expected), code).otherwise("NoCode"))


def quality_profile(reads: DataFrame, least: int) -> DataFrame:
    """Share of reads whose quality at each position is ``least`` or more. reads: quals."""
    return reads.select(F.posexplode("quals").alias("pos", "q")).groupBy("pos").agg(F.avg((F.col("q") >= least).cast("int")).alias("share"))


def trim_position(profile: DataFrame, min_len: int, share: float = 0.8) -> DataFrame:
    """The first position, from ``min_len`` - 1 on, at which too few reads are good."""
    return profile.where((F.col("pos") >= min_len - 1) & (F.col("share") < share)).agg(F.min("pos").alias("pos"))
