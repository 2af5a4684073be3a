"""Cell-cycle phasing: metrics of decay profiles, rule groups, order within groups, cross-validation.

Bins are the right-closed decay bins of ``functions.distance`` (bin k ends at 2^(10 + k / 8)).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PhaseRules:
    """Thresholds of the rules; the defaults are those of the diploid set."""

    near_s_start: float = 0.63
    near_mid_s: float = 0.785
    mitotic_min_post_m: float = 0.3
    near_max_post_m: float = 0.5
    pre_m_slope: float = -1.8
    pre_m_intercept: float = 1.0


HAPLOID = PhaseRules(0.611, 0.77, 0.3, 0.42, -1.8, 1.0)
#: Bands as bins: near (2^14.5, 2^21], mitotic (2^21, 2^23.5], far 2^22.125 to 2^27.75.
NEAR, MITOTIC, FAR, DISCARD = (36, 88), (88, 108), (97, 142), 36


def decay_metrics(decay: DataFrame) -> DataFrame:
    """From (cell_id, bin, n) shares over bins beyond the near discard: near and mitotic bands, mean far distance, largest far share, peak."""
    rows = decay.where(F.col("bin") > DISCARD)
    total = F.sum("n")
    edge = F.pow(F.lit(2.0), 10 + F.col("bin") / 8)
    band = lambda b: F.sum(F.when((F.col("bin") > b[0]) & (F.col("bin") <= b[1]), F.col("n")).otherwise(0)) / total
    far = F.when(F.col("bin").between(*FAR), F.col("n"))
    return rows.groupBy("cell_id").agg(band(NEAR).alias("near"), band(MITOTIC).alias("mitotic"), (F.sum(far * edge) / F.sum(far)).alias("far_mu"), (F.max(far) / F.sum(far)).alias("far_tightness"), (F.max(F.struct(F.col("n"), (-F.col("bin")).alias("b"))).getField("b") * F.lit(-1)).alias("peak"), total.alias("n"))


def phase_group(near: Column, mitotic: Column, rules: PhaseRules = PhaseRules()) -> Column:
    """1 after mitosis, 2 G1, 3 early S, 4 mid S to G2, 5 before mitosis; later rules win."""
    r = rules
    group = F.when(near <= r.near_s_start, 2).when(near <= r.near_mid_s, 3).otherwise(4)
    group = F.when((mitotic >= r.mitotic_min_post_m) & (near <= r.near_max_post_m), 1).otherwise(group)
    return F.when((near > r.near_max_post_m) & (r.pre_m_slope * mitotic - near + r.pre_m_intercept < 0), 5).otherwise(group)


def phased(metrics: DataFrame, rules: PhaseRules = PhaseRules()) -> DataFrame:
    """Cells (cell_id, near, mitotic, far_mu, early_f) with their group and their place in the whole order (ord)."""
    group = Window.partitionBy("group")
    rows = metrics.withColumn("group", phase_group(F.col("near"), F.col("mitotic"), rules))
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(group), F.stddev_samp(c).over(group)), F.lit(0.0))
    by_var = lambda c: F.coalesce(F.try_divide(F.col(c), F.var_samp(c).over(group)), F.lit(0.0))
    key = F.when(F.col("group") == 1, -F.col("mitotic")).when(F.col("group") == 2, z("near") + z("far_mu")).when(F.col("group") == 3, by_var("near") + by_var("early_f")).when(F.col("group") == 4, by_var("near") - by_var("early_f")).otherwise(F.col("mitotic"))
    rows = rows.withColumn("key", key)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("group", F.round("key", 9), "cell_id")))  # a row a cell


def majority(groups: DataFrame) -> DataFrame:
    """Give every cluster (cluster, group) its most frequent group, the smaller on a tie."""
    n = groups.groupBy("cluster", "group").agg(F.count("*").alias("n"))
    best = n.groupBy("cluster").agg(F.max(F.struct("n", (-F.col("group")).alias("g"))).alias("m")).select("cluster", (-F.col("m.g")).alias("group"))
    return groups.drop("group").join(best, "cluster")


def clustered(decay: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k-means clusters of the decay profiles: cell_id, cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = decay.where(F.col("bin") > DISCARD)
    share = rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cell_id")))
    profile = share.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "p"))).alias("m")).select("cell_id", array_to_vector(F.transform(F.sequence(F.lit(DISCARD + 1), F.lit(142)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=50).fit(profile).transform(profile).select("cell_id", F.col("prediction").alias("cluster"))


def order_agreement(a: DataFrame, b: DataFrame, margin: float = 0.1) -> DataFrame:
    """Cyclic difference of every cell's place in two orders (cell_id, ord), and whether it is an outlier (``margin`` of the circle or more)."""
    both = a.select("cell_id", F.col("ord").alias("x")).join(b.select("cell_id", F.col("ord").alias("y")), "cell_id")
    n = both.agg(F.count("*").alias("_n"))
    gap = F.abs(F.col("x") - F.col("y"))
    rows = both.crossJoin(F.broadcast(n)).withColumn("gap", F.least(gap, F.col("_n") - gap))  # one row
    return rows.select("cell_id", "x", "y", "gap", (F.col("gap") >= margin * F.col("_n")).alias("outlier"))


def on_a_wheel(order: DataFrame) -> DataFrame:
    """Angle of every cell's place."""
    n = order.agg(F.count("*").alias("_n"))
    return order.crossJoin(F.broadcast(n)).select("cell_id", "ord", (2 * F.pi() * F.col("ord") / F.col("_n")).alias("angle"))


def features_table(*tables: DataFrame) -> DataFrame:
    """One wide row a cell of the first table: the others joined on cell_id."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "cell_id", "left")
    return out
