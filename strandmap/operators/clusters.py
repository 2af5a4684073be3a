"""k-means over sparse long rows with missing values, and what is clustered with it.

Rows are entries (row, col, v); what is missing has no entry and takes no part in
distances or centres. A distance is the mean squared difference over the columns a row
has. Centres are k x columns, at most ``CENTRES`` numbers, and go to every task; entries
are read twice a round, once summed by row and once by cluster and column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.operators.lineage import cut

#: Numbers that centres may hold.
CENTRES = 4_000_000


def _wide(centres: DataFrame, k: int) -> DataFrame:
    """col, c0 .. c(k - 1), checked for its size; a centre without a value there has null."""
    if centres.count() > CENTRES:
        raise ValueError(f"centres hold more than {CENTRES} numbers")
    return F.broadcast(centres.groupBy(F.col("col").alias("_col")).agg(*(F.max(F.when(F.col("cluster") == i, F.col("c"))).alias(f"c{i}") for i in range(k))))


def distances(entries: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """row and d0 .. d(k - 1), to nine places; null where a row and a centre share no column."""
    both = entries.join(_wide(centres, k), F.col("col") == F.col("_col"), "left")
    return both.groupBy("row").agg(*(F.round(F.avg(F.pow(F.col("v") - F.col(f"c{i}"), 2)), 9).alias(f"d{i}") for i in range(k)))


def assigned(entries: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """row, cluster: the nearest centre, the first of equally near ones; rows that share no column with any have none."""
    rows = distances(entries, centres, k)
    least = F.least(*(F.col(f"d{i}") for i in range(k))) if k > 1 else F.col("d0")
    label: Column = reduce(lambda rest, i: F.when(F.col(f"d{i}") == least, i).otherwise(rest), reversed(range(k)), F.lit(None).cast("int"))
    return rows.select("row", label.alias("cluster")).where("cluster is not null")


def centres_of(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, col, c: the mean of the members that have the column."""
    return entries.join(labels, "row").groupBy("cluster", "col").agg(F.avg("v").alias("c"))


def seeds(entries: DataFrame, k: int, quantile: float = 0.825, seed: str = "s") -> DataFrame:
    """k rows as first centres (cluster, col, c): one by digest, then each time the row at ``quantile`` of the distances to the nearest chosen one, the smallest of equal rows."""
    names = entries.select("row").distinct()
    first = names.orderBy(F.md5(F.concat(F.lit(seed), F.col("row").cast("string"))), "row").first()
    chosen = [] if first is None else [first.row]
    take = lambda: reduce(DataFrame.unionByName, (entries.where(F.col("row") == r).select(F.lit(i).alias("cluster"), "col", F.col("v").alias("c")) for i, r in enumerate(chosen)))
    while 0 < len(chosen) < k:
        apart = distances(entries.where(~F.col("row").isin(chosen)), take(), len(chosen))
        nearest = F.least(*(F.col(f"d{i}") for i in range(len(chosen)))) if len(chosen) > 1 else F.col("d0")
        apart = cut(apart.select("row", nearest.alias("d")).where("d is not null"))
        at = apart.agg(F.expr(f"percentile_disc({quantile}) within group (order by d)").alias("d")).first().d
        if at is None:
            break
        chosen.append(apart.where(F.col("d") == at).agg(F.min("row").alias("row")).first().row)
    if not chosen:
        return entries.select(F.lit(0).alias("cluster"), "col", F.col("v").alias("c")).limit(0)
    return take()


def kmeans(entries: DataFrame, first: DataFrame, k: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Labels (row, cluster) and the centres they were given by, after ``rounds`` of moving centres or when no row moves. A centre keeps its value in columns that no member has."""
    entries = cut(entries.where("row is not null and col is not null and v is not null and not isnan(v)"))
    centres, labels = cut(first), None
    for _ in range(rounds):
        now = cut(assigned(entries, centres, k))
        if labels is not None and now.exceptAll(labels).isEmpty():
            break
        labels = now
        moved = centres_of(entries, labels).select("cluster", "col", F.col("c").alias("_c"))
        centres = cut(centres.join(moved, ["cluster", "col"], "full").select("cluster", "col", F.coalesce("_c", "c").alias("c")))
    return assigned(entries, centres, k), centres


def normalised_pairs(pairs: DataFrame, lengths: DataFrame, scale: str, delta: float, trim: float | None = None) -> DataFrame:
    """Entries (row, col, v) of domain pairs (fid1, fid2, n; both orders): log2 of contacts over what ``scale`` expects, not below ``trim``.

    mean: the mean of all pairs; area: the product of both lengths (fid, len); marginal: that of both domains' shares. Pairs
    that are not there are missing.
    """
    total = pairs.agg(F.avg(F.col("n") + delta).alias("_mean"), F.sum(F.col("n") + delta).alias("_sum"), F.sum(F.col("n") + 1).alias("_plus"))  # one row
    rows = pairs.crossJoin(F.broadcast(total))
    if scale == "mean":
        expected = F.col("_mean")
    elif scale == "area":
        for i in (1, 2):
            rows = rows.join(lengths.select(F.col("fid").alias(f"fid{i}"), F.col("len").alias(f"_len{i}")), f"fid{i}")
        area = F.col("_len1").cast("double") * F.col("_len2")
        rows = cut(rows.withColumn("_area", area))
        rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("_area").alias("_all"))))
        expected = F.col("_area") * F.col("_sum") / F.col("_all")
    elif scale == "marginal":
        margin = pairs.groupBy("fid1").agg(F.sum(F.col("n") + 1).alias("_m"))
        for i in (1, 2):
            rows = rows.join(margin.select(F.col("fid1").alias(f"fid{i}"), F.col("_m").alias(f"_m{i}")), f"fid{i}")
        expected = F.col("_m1") / F.col("_plus") * (F.col("_m2") / F.col("_plus")) * F.col("_sum")
    else:
        raise ValueError(f"scale is mean, area or marginal, not {scale}")
    value = F.log2((F.col("n") + delta) / expected)
    return rows.select(F.col("fid1").alias("row"), F.col("fid2").alias("col"), (value if trim is None else F.greatest(value, F.lit(trim))).alias("v"))


def by_order_of_means(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """Labels renumbered from 1 by the mean of their members' values, the lowest first: names of clusters that do not depend on where centres began."""
    means = entries.join(labels, "row").groupBy("cluster").agg(F.round(F.avg("v"), 9).alias("_m"))
    rank = means.select("cluster", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_m", "cluster")).alias("place"))  # a row a cluster
    return labels.join(F.broadcast(rank), "cluster").select("row", F.col("place").alias("cluster"))
