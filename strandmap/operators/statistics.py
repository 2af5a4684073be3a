"""Tests, correlations, densities and clusterings.

What works on cells (some thousands) may use dense matrices on the driver; what works on contacts stays distributed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.operators import scans as S


def ks_statistic(df: DataFrame, group: str, value: str) -> DataFrame:
    """Largest difference of the two groups' distribution functions: group is 0 or 1; d, n0, n1, p (asymptotic)."""
    steps = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    rows = S.scan(S.by_ranges(steps, value), [], value, {"_a": ("sum", F.col("a"), True), "_b": ("sum", F.col("b"), True)})
    total = F.broadcast(steps.agg(F.sum("a").alias("n0"), F.sum("b").alias("n1")))  # one row
    out = rows.crossJoin(total).agg(F.max(F.abs(F.col("_a") / F.col("n0") - F.col("_b") / F.col("n1"))).alias("d"), F.first("n0").alias("n0"), F.first("n1").alias("n1"))
    x = F.col("d") * F.sqrt(F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    p = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 21)), F.lit(0.0))
    return out.withColumn("p", F.least(F.greatest(F.when(x < 0.2, 1.0).otherwise(p), F.lit(0.0)), F.lit(1.0)))


def adjusted(df: DataFrame, p: str) -> DataFrame:
    """Benjamini-Hochberg values of a column of p-values, as ``q``."""
    up, down = Window.partitionBy(F.lit(1)).orderBy(p), Window.partitionBy(F.lit(1)).orderBy(F.desc(p), F.desc("_rank"))
    rows = df.withColumns({"_rank": F.row_number().over(up), "_n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return rows.withColumn("q", F.least(F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_rank", "_n")


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """A row for each value that is not null: its number ``t`` and rank ``r`` from 1, ties at their mean, by a chunked scan over distinct values."""
    steps = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("t"))
    rows = S.scan(S.by_ranges(steps, value), [], value, {"_before": ("sum", F.col("t"), False)})
    return rows.select(value, "t", (F.col("_before") + (F.col("t") + 1) / 2).alias("r"))


def rank_sum(df: DataFrame, group: str, value: str) -> DataFrame:
    """Wilcoxon's W of group 1 over group 0 with its normal approximation z (ties corrected, continuity 0.5)."""
    rows = df.where(F.col(value).isNotNull())
    each = rows.groupBy(value).agg(F.count_if(F.col(group) == 1).alias("g1"), F.count_if(F.col(group) == 0).alias("g0"))
    out = each.join(value_ranks(rows, value), value).agg(F.sum("g1").alias("n1"), F.sum("g0").alias("n0"), F.sum(F.col("g1") * F.col("r")).alias("ranks"), F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).alias("ties"))
    n = F.col("n0") + F.col("n1")
    w = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n0") * F.col("n1") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return out.select("n0", "n1", w.alias("w"), ((w - F.col("n0") * F.col("n1") / 2 - 0.5) / sd).alias("z"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = lambda c, name: value_ranks(rows, c).select(F.col(c).alias(f"_{c}"), F.col("r").alias(name))
    both = rows.join(ranks(x, "_rx"), F.col(x) == F.col(f"_{x}")).join(ranks(y, "_ry"), F.col(y) == F.col(f"_{y}"))
    return both.agg(F.corr("_rx", "_ry").alias("rho"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of the columns' z-scores, as ``z``; means and deviations come from one aggregate row."""
    about = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    total = sum(((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns), F.lit(0.0))
    return df.crossJoin(F.broadcast(about)).withColumn("z", total).select(*df.columns, "z")


def density(df: DataFrame, value: str, low: float, high: float, points: int, bandwidth: float) -> DataFrame:
    """Gaussian kernel density at ``points`` places, from a fine histogram (eight bins a bandwidth)."""
    size = bandwidth / 8
    bins = df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / size).alias("b")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("x"))
    near = bins.withColumn("v", (F.col("b") + 0.5) * size).crossJoin(F.broadcast(grid))  # bins x points, no rows
    kernel = F.col("n") * F.exp(-F.pow((F.col("x") - F.col("v")) / bandwidth, 2) / 2)
    total = near.groupBy("x").agg(F.sum(kernel).alias("s"), F.sum("n").alias("n"))
    return total.select("x", (F.col("s") / (F.col("n") * bandwidth * float(np.sqrt(2 * np.pi)))).alias("density"))


def correlation_matrix(df: DataFrame, item: str, at: str, value: str) -> DataFrame:
    """Pearson's r of every two items over the places that both have (long table: i, j, r)."""
    from strandmap.operators.contacts import correlation

    a = df.select(F.col(item).alias("i"), F.col(at).alias("_at"), F.col(value).alias("x"))
    b = df.select(F.col(item).alias("j"), F.col(at).alias("_at"), F.col(value).alias("y"))
    return a.join(b, "_at").where("i < j").groupBy("i", "j").agg(correlation(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n"))


def js_distances(profiles: DataFrame, key: str, shares: str, block: int = 64) -> DataFrame:
    """Square root of the Jensen-Shannon divergence of every two profiles (arrays); of cells, in blocks of rows."""
    from strandmap.functions.measures import js_divergence

    groups = F.pmod(F.xxhash64(key), F.lit(block))
    a = profiles.select(F.col(key).alias("i"), F.col(shares).alias("x"), groups.alias("_g"))
    b = profiles.select(F.col(key).alias("j"), F.col(shares).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_h"))
    return a.join(b, F.col("_g") == F.col("_h")).where("i < j").select("i", "j", F.sqrt(F.greatest(js_divergence(F.col("x"), F.col("y")), F.lit(0.0))).alias("d"))


def nearest_rows(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest of every row, ties to the smaller number."""
    both = distances.select("i", "j", "d").unionByName(distances.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def spectral_embedding(edges: DataFrame, dims: int = 2) -> list[tuple[int, list[float]]]:
    """Laplacian eigenvectors 1 .. dims of a graph over cells (edges i, j; either direction counts), a row a cell; ``projection.embedding`` keeps them as a table."""
    from strandmap.operators.projection import embedding

    return sorted((r.node, list(r.vector)) for r in embedding(edges, dims)[0].collect())
