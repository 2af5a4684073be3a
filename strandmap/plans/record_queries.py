"""Queries over files that are rendered from the driver's tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap.operators.lineage import shared_folder
from strandmap.plans.fixtures import duckdb_sql, view
from strandmap.sources import files, pair_tables


def _fastq(spark, sf):
    """Sequences as FASTQ, each base's quality from its place."""
    path = shared_folder(spark)
    qual = F.expr("concat_ws('', transform(sequence(1, length(q)), i -> char(33 + i % 40)))")
    lines = view(spark, sf, "seqs").where("q <> ''").select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("doc_id").cast("string")), F.col("q"), F.lit("+"), qual).alias("value"))
    lines.write.text(path)
    return path


def _records(spark, sf):
    return files.read_fastq(spark, _fastq(spark, sf)).select(F.col("id").cast("long").alias("doc_id"), F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(F.col("qual").cast("binary")).alias("qual_md5"))


def _parts(spark, sf):
    return files.ranged(files.read_fastq(spark, _fastq(spark, sf)), 7).groupBy("part").agg(F.count("*").alias("n"))


def _fasta(spark, sf):
    """Sequences as FASTA, in lines of 60 bases, read as pieces."""
    path = shared_folder(spark)
    cut = F.expr("concat_ws('\n', transform(sequence(1, length(q), 60), i -> substring(q, i, 60)))")
    view(spark, sf, "seqs").where("q <> ''").select(F.concat(F.lit(">chr"), F.col("doc_id").cast("string"), F.lit("\n"), cut).alias("value")).write.text(path)
    return files.read_fasta_pieces(spark, path).select(F.col("chrom").cast("long").alias("doc_id"), "at", "seq")


def _pairs(spark, sf):
    """Pairs of bins as ends with their contacts, published and read back by a range of the first end."""
    path = shared_folder(spark)
    contacts = view(spark, sf, "contacts")
    ends = contacts.select((F.col("chrom1") * 1000 + F.floor(F.col("start1") / 1_000_000)).alias("fend1"), (F.col("chrom2") * 1000 + F.floor(F.col("start2") / 1_000_000)).alias("fend2"), F.col("cnt").alias("mol"))
    pair_tables.write_pairs(pair_tables.merged(ends), path)
    return pair_tables.read_pairs(spark, path, 3000, 9050)


QUERIES = {"a02_fastq_records": _records, "a07_record_ranges": _parts, "a14_fasta_pieces": _fasta, "b02_pair_table": _pairs}

SQL = {
    "a02_fastq_records": duckdb_sql(" SELECT doc_id, length(q)::INTEGER AS n, md5(q) AS seq_md5, md5(array_to_string(list_transform(range(1, length(q) + 1), lambda i: chr((33 + i % 40)::INTEGER)), '')) AS qual_md5 FROM seqs WHERE q <> ''", "seqs"),
    "a07_record_ranges": duckdb_sql(", r AS (SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS total FROM seqs WHERE q <> '') SELECT (i // (total // 7 + 1))::INTEGER AS part, count(*) AS n FROM r GROUP BY ALL", "seqs"),
    "a14_fasta_pieces": duckdb_sql(" SELECT doc_id, i - 1 AS at, substr(q, i, 60) AS seq FROM (SELECT doc_id, q, unnest(range(1, length(q) + 1, 60)) AS i FROM seqs WHERE q <> '')", "seqs"),
    "b02_pair_table": duckdb_sql(", e AS (SELECT chrom1 * 1000 + start1 // 1000000 AS a, chrom2 * 1000 + start2 // 1000000 AS b, cnt FROM contacts) SELECT least(a, b) AS fend1, greatest(a, b) AS fend2, sum(cnt)::BIGINT AS count FROM e WHERE least(a, b) >= 3000 AND least(a, b) < 9050 GROUP BY ALL", "contacts"),
}
