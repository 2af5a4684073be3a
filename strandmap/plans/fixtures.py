"""Contacts, tracks, sequences, fragments, sites and cells as views over the driver's tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHROM_LEN = 200_000_000
CHROMS = 19

_CONTACTS = """
WITH b AS (
  SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q,
         l_partkey % 19 + 1 AS c1, (l_orderkey + l_linenumber) % 5 AS tr, CAST(8 + (l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 19 AS INT) AS e
  FROM {lineitem})
SELECT k % 64 AS cell_id, c1 AS chrom1, (p * 48271 + k * 16807) % 60000000 AS start1,
       CASE WHEN tr <> 0 THEN c1 ELSE (c1 + s % 18) % 19 + 1 END AS chrom2,
       CASE WHEN tr <> 0 THEN (p * 48271 + k * 16807) % 60000000 + {two_e} + (p * 69621 + s * 7919 + n) % {two_e} ELSE (s * 69621 + k * 40692) % 60000000 END AS start2,
       q % 4 + 1 AS cnt
FROM b"""
_TOR = """
SELECT o_orderkey % 19 + 1 AS chrom, (CAST(floor(o_orderkey / 19) AS BIGINT) * 100000) % 200000000 AS start, avg((o_totalprice - 250000) / 125000) AS v, count(*) AS n
FROM {orders} GROUP BY 1, 2"""
_SEQS = """
SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', ''{flags}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS q FROM {documents}"""
_FRAGS = """
SELECT fid, chrom, start, end_ FROM (
  SELECT p_partkey AS fid, p_partkey % 19 + 1 AS chrom, CAST(floor(p_partkey / 19) AS BIGINT) * 1000000 + p_size * 1000 AS start,
         lead(CAST(floor(p_partkey / 19) AS BIGINT) * 1000000 + p_size * 1000) OVER (PARTITION BY p_partkey % 19 ORDER BY p_partkey) AS end_
  FROM {part}) x WHERE end_ IS NOT NULL"""
_SITES = """
SELECT c_custkey AS site_id, c_custkey % 19 + 1 AS chrom, (c_custkey * c_custkey * 7919 + c_custkey * 104729) % 60000000 AS start,
       (c_custkey * c_custkey * 7919 + c_custkey * 104729) % 60000000 + 1 AS end_, CASE WHEN floor(c_custkey / 19) % 2 = 0 THEN 'F' ELSE 'R' END AS type
FROM {customer}"""
_CELLS = """
SELECT c_custkey AS cell_id, c_mktsegment AS cond, c_nationkey AS batch_id, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS valid FROM {customer} WHERE c_custkey < 64"""
_HITS = """
SELECT l_orderkey AS read_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS i, l_partkey % 40 + 1 AS fid,
       l_suppkey AS pos, l_suppkey + CAST(l_quantity AS BIGINT) AS end_, CASE WHEN (l_linenumber + l_suppkey) % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(l_quantity AS INT) AS qual
FROM {lineitem}"""

_VIEWS = {"contacts": (_CONTACTS, "lineitem"), "tor": (_TOR, "orders"), "seqs": (_SEQS, "documents"), "frags": (_FRAGS, "part"), "sites": (_SITES, "customer"), "cells": (_CELLS, "customer"), "hits": (_HITS, "lineitem")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    text, base = _VIEWS[name]
    return spark.sql(text.replace("{two_e}", "shiftleft(CAST(1 AS BIGINT), e)").replace("{flags}", "").replace("{" + base + "}", "{source}"), source=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def duckdb_sql(body: str, *views: str) -> str:
    """DuckDB SQL with the views in front; ``body`` may go on with further tables (", x AS (...) SELECT ...")."""
    parts = []
    for name in views:
        text, base = _VIEWS[name]
        parts.append(f"{name} AS ({text.replace('{two_e}', '(CAST(1 AS BIGINT) << e)').replace('{flags}', chr(44) + ' ' + chr(39) + 'g' + chr(39)).replace('{' + base + '}', base)})")
    return "WITH " + ", ".join(parts) + body
