"""Rolling, cyclic and rank windows, and groups of ranks.

Rolling windows over a whole order need all its rows in one place; those orders are
of cells or chromosomes, some thousands at most, unless ``by`` splits them. Sums,
runs and gaps over an order of any length are chunked scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandmap.operators import scans as S


def _order(order: str, by: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*(by or (F.lit(1),))).orderBy(order)


def cyclic_roll(df: DataFrame, order: str, value: str, width: int, how: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """Centred window of odd ``width`` over a closed circle (``order`` from 1 without gaps): mean, sum, sd or length, as ``rolled``."""
    half = width // 2
    n = df.groupBy(*by).agg(F.count("*").alias("_n")) if by else df.agg(F.count("*").alias("_n"))
    rows = df.join(F.broadcast(n), list(by)) if by else df.crossJoin(F.broadcast(n))  # a row a group
    turns = F.explode(F.array(*(F.lit(x) for x in (-1, 0, 1)))).alias("_turn")
    rows = rows.select("*", turns).withColumn("_at", F.col(order) + F.col("_turn") * F.col("_n")).where((F.col("_at") > -half) & (F.col("_at") <= F.col("_n") + half))
    w = _order("_at", by).rowsBetween(-half, half)
    f = {"mean": F.avg, "sum": F.sum, "sd": F.stddev_samp, "length": F.count}[how]
    return rows.withColumn("rolled", f(value).over(w)).where("_turn = 0").drop("_turn", "_at", "_n")


def rolling_mean(df: DataFrame, order: str, value: str, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Centred window, cut off at the ends, as ``rolled``."""
    return df.withColumn("rolled", F.avg(value).over(_order(order, by).rowsBetween(-(width // 2), width // 2)))


def block_sums(df: DataFrame, order: str, value: str, size: int) -> DataFrame:
    """Sums of ``size`` neighbours in rank; an incomplete last block goes."""
    blocks = df.groupBy(F.floor((F.col(order) - 1) / size).alias("block")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return blocks.where(F.col("n") == size).drop("n")


def offsets(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Where each begins when they are laid end to end, as ``offset``."""
    return S.unchunked(S.scan(S.by_ranges(sizes, order), [], order, {"offset": ("sum", F.col(size), False)}))


def runs(df: DataFrame, order: str, value: str) -> DataFrame:
    """Run lengths of equal values in order of a number: run, value, first, length, last. Of equal places any comes first; nulls end a run and are runs of one."""
    rows = S.scan(S.by_ranges(df, order), [], order, {"_last": ("last", F.struct(value), False)})
    fresh = F.coalesce((F.col(value) != F.col(f"_last.{value}")).cast("int"), F.lit(1))
    rows = S.scan(rows.withColumn("_fresh", fresh), [], order, {"run": ("sum", F.col("_fresh"), True)})
    return rows.groupBy("run", value).agg(F.min(order).alias("first"), F.count("*").alias("length"), F.max(order).alias("last"))


def widest_gap(df: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """The first place at which the running sum of ``b`` is most above that of ``a``."""
    rows = S.scan(S.by_ranges(df, order), [], order, {"gap": ("sum", F.col(b) - F.col(a), True)})
    return rows.agg(F.max(F.struct("gap", (-F.col(order)).alias("o"))).alias("m")).select((-F.col("m.o")).alias(order), F.col("m.gap").alias("gap"))


def equal_ranges(order: Column, n: Column, parts: int) -> Column:
    """Which of ``parts`` ranges of equal width, right-closed, holds rank ``order`` of n, from 1."""
    return F.least(F.greatest(F.ceil((order - 1) * parts / (n - 1)).cast("int"), F.lit(1)), F.lit(parts))


def fixed_groups(order: Column, n: Column, groups: int) -> Column:
    """Groups of equal size, numbered from ``groups`` down."""
    return (groups - F.floor((order - 1) / F.ceil(n / groups))).cast("int")
