"""Ward's hierarchical clustering by rounds of reciprocal nearest neighbours, and the order of a tree's leaves.

In each round every two clusters that are each other's nearest merge at once. Ward's
distance never shrinks by a merge elsewhere, so these are the merges that taking the
closest pair one by one makes, and a cluster whose nearest one lives on keeps it: only
new clusters and those that lost their nearest look again. They meet all clusters in
blocks of ``BLOCK``, and a task returns one row a cluster that looks, never a pair. The
last ``BLOCK`` clusters are one block and merge in one task, closest pair first.
Clusters are (made, row): the round that made it, 0 for a leaf, and its smallest leaf.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.operators import scans as S
from strandmap.operators.lineage import cut

#: Clusters of a block, and columns that a leaf may have.
BLOCK, COLUMNS = 1024, 10_000

_FOUND = "row long, made int, d double, to_made int, to_row long"
_MERGES = "left_made int, left_row long, right_made int, right_row long, height double, size long, made int, row long"


def leaves(entries: DataFrame) -> DataFrame:
    """row, made, size, centre of long rows (row, col, v); columns that a row lacks are 0, those that none has do not occur. The sum is taken of repeated entries; null, infinite and NaN ones do not count."""
    entries = cut(entries.where("row is not null and col is not null and v is not null and abs(v) < double('inf')"))
    columns = [r.col for r in entries.select("col").distinct().orderBy("col").limit(COLUMNS + 1).collect()]
    if len(columns) > COLUMNS:
        raise ValueError(f"leaves have more than {COLUMNS} columns")
    given = F.map_from_entries(F.collect_list(F.struct("col", "v")))
    centre = F.transform(F.array(*map(F.lit, columns)), lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(0.0)))
    rows = entries.groupBy("row", "col").agg(F.sum(F.col("v").cast("double")).alias("v")).groupBy("row").agg(given.alias("_m"))
    return rows.select(F.col("row").cast("long").alias("row"), F.lit(0).alias("made"), F.lit(1).cast("long").alias("size"), centre.alias("centre"))


def _nearest_of_block(looking: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Each looking cluster's nearest of one block, itself apart; of equally near ones the first made, then the smallest row."""
    if looking.empty or others.empty:
        return pd.DataFrame(columns=["row", "made", "d", "to_made", "to_row"])
    others = others.sort_values(["made", "row"])
    names, made, sizes = others["row"].to_numpy(), others["made"].to_numpy(), others["size"].to_numpy(float)
    centres, out = np.stack(others["centre"].to_list()), []
    for row, own, size, centre in looking[["row", "made", "size", "centre"]].itertuples(index=False):
        cost = ((centres - centre) ** 2).sum(1) * (2 * (sizes * size) / (sizes + size))
        cost[names == row] = np.inf
        i = int(cost.argmin())
        if cost[i] < np.inf:
            out.append((row, own, cost[i], made[i], names[i]))
    return pd.DataFrame(out, columns=["row", "made", "d", "to_made", "to_row"])


def _nearest(looking: DataFrame, alive: DataFrame, n: int) -> DataFrame:
    """row, made, d, to_made, to_row: the nearest other cluster of each that looks; ``d`` is the squared height of their merge."""
    blocks = ceil(n / BLOCK)
    at, every = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = [F.col(c).alias(c) for c in ("row", "made", "size", "centre")]  # aliases, so that both sides of the cogroup have columns of their own
    a = looking.select(*own, at.cast("int").alias("_g"), every.alias("_h"))
    b = alive.select(*own, every.alias("_g"), at.cast("int").alias("_h"))
    met = a.groupBy("_g", "_h").cogroup(b.groupBy("_g", "_h")).applyInPandas(_nearest_of_block, _FOUND)
    return met.groupBy("row", "made").agg(F.min(F.struct("d", "to_made", "to_row")).alias("_x")).select("row", "made", "_x.*")


def _last_merges(alive: pd.DataFrame, made: int) -> pd.DataFrame:
    """All merges of the clusters of one block, each a round of its own after ``made``."""
    alive = alive.sort_values(["made", "row"])
    ids = list(zip(alive["made"].tolist(), alive["row"].tolist(), strict=True))
    sizes, centres, out = alive["size"].to_numpy(float), np.stack(alive["centre"].to_list()), []
    cost = np.full((len(ids), len(ids)), np.inf)  # above the diagonal; a merge takes the place of its left side
    apart = lambda i: ((centres - centres[i]) ** 2).sum(1) * (2 * (sizes * sizes[i]) / (sizes + sizes[i]))
    for i in range(len(ids)):
        cost[i, i + 1 :] = apart(i)[i + 1 :]
    live = np.ones(len(ids), bool)
    for _ in range(len(ids) - 1):
        i, j = divmod(int(cost.argmin()), len(ids))
        made, (a, b), total = made + 1, sorted((ids[i], ids[j])), sizes[i] + sizes[j]
        out.append((*a, *b, cost[i, j] ** 0.5, int(total), made, min(a[1], b[1])))
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / total
        ids[i], sizes[i], live[j] = (made, min(a[1], b[1])), total, False
        cost[j, :] = cost[:, j] = np.inf
        now = np.where(live, apart(i), np.inf)
        cost[i, i + 1 :], cost[:i, i] = now[i + 1 :], now[:i]
    return pd.DataFrame(out, columns=[part.split()[0] for part in _MERGES.split(", ")])


def ward(items: DataFrame) -> DataFrame:
    """Merges of ``leaves``: left_made, left_row, right_made, right_row, height, size, made, row (the cluster that is made); one row fewer than leaves.

    left is the cluster made first, or of the smaller row. Heights are those of Ward's
    criterion over distances (not squared ones). Ties go by (made, row) and by places in
    the block, so a tree with ties is the same on every run. Fewer than two
    leaves merge not at all.
    """
    alive = cut(items.select("row", "made", "size", "centre"))
    n, made, merges, anew = alive.count(), 0, [], True
    found = cut(_nearest(alive, alive, n)) if n > BLOCK else None
    while n > BLOCK:
        made += 1
        back = found.select(F.col("row").alias("to_row"), F.col("to_row").alias("row"))  # rows alone tell living clusters apart
        mutual = found.join(back, ["row", "to_row"]).where(F.struct("made", "row") < F.struct(F.col("to_made").alias("made"), F.col("to_row").alias("row")))
        sides = [alive.select(F.col("row").alias(key), F.col("size").alias(f"_n{i}"), F.col("centre").alias(f"_c{i}")) for i, key in enumerate(("row", "to_row"))]
        total = F.col("_n0") + F.col("_n1")
        centre = F.zip_with("_c0", "_c1", lambda x, y: (x * F.col("_n0") + y * F.col("_n1")) / total)
        born = cut(
            mutual.join(sides[0], "row").join(sides[1], "to_row").select(
                F.col("made").alias("left_made"), F.col("row").alias("left_row"), F.col("to_made").alias("right_made"), F.col("to_row").alias("right_row"),
                F.sqrt("d").alias("height"), total.alias("size"), F.lit(made).alias("made"), F.least("row", "to_row").alias("row"), centre.alias("centre"),
            )
        )
        count = born.count()
        if count == 0:  # rounding may leave a nearest one that no longer is
            if anew:
                raise ValueError(f"no two of {n} clusters are each other's nearest")
            found, anew = cut(_nearest(alive, alive, n)), True
            continue
        merges.append(born.drop("centre"))
        anew = False
        gone = cut(born.select(F.explode(F.array("left_row", "right_row")).alias("row")))
        alive = cut(alive.join(gone, "row", "left_anti").unionByName(born.select("row", "made", "size", "centre")))
        n -= count
        kept = found.join(gone, "row", "left_anti").join(gone.withColumnRenamed("row", "to_row"), "to_row", "left_anti")
        if n > BLOCK:
            looking = alive.join(kept.select("row"), "row", "left_anti")
            found = cut(kept.select("row", "made", "d", "to_made", "to_row").unionByName(_nearest(looking, alive, n)))
    last = alive.groupBy().applyInPandas(lambda block: _last_merges(block, made), _MERGES)
    return reduce(DataFrame.unionByName, [*merges, last])


def _starts(merges: DataFrame) -> DataFrame:
    """node (made, row), start: how many leaves the tree draws left of each cluster but the root.

    At each ancestor that a cluster is to the right of, the left side's size counts. Steps up
    the tree double, so a tree of depth h takes log h rounds of joins whatever its shape.
    """
    name = lambda side: F.struct(F.col(f"{side}made").alias("made"), F.col(f"{side}row").alias("row"))
    sizes = merges.select(name("").alias("left"), F.col("size").alias("_n"))
    rows = merges.select(name("left_").alias("left"), name("right_").alias("right"), name("").alias("up")).join(sizes, "left", "left")
    side = lambda node, start: F.struct(F.col(node).alias("node"), start.cast("long").alias("start"))
    at = cut(rows.select(F.explode(F.array(side("left", F.lit(0)), side("right", F.coalesce("_n", F.lit(1))))).alias("_s"), "up").select("_s.*", "up"))
    while True:
        higher = at.select(F.col("node").alias("up"), F.col("start").alias("_start"), F.col("up").alias("_up"))
        at = cut(at.join(higher, "up", "left").select("node", (F.col("start") + F.coalesce("_start", F.lit(0))).alias("start"), F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("_moved")))
        if at.where("_moved").isEmpty():
            return at.select("node", "start")
        at = at.drop("_moved")


def leaf_order(merges: DataFrame) -> DataFrame:
    """row, place (from 0) of the leaves as the tree draws them, left before right."""
    return _starts(merges).where("node.made = 0").select(F.col("node.row").alias("row"), F.col("start").alias("place"))


def reordered(merges: DataFrame, weights: DataFrame) -> DataFrame:
    """Merges with the side of the lower mean weight of its leaves on the left; weights are row, weight, one a leaf.

    A cluster's leaves are a run of the order, so its sum is the difference of two running
    sums. Leaves without a weight do not count; where a side has none, or means are equal, sides stay.
    """
    starts = _starts(merges)
    leaves_at = starts.where("node.made = 0").select(F.col("node.row").alias("row"), F.col("start").alias("place"))
    own = cut(leaves_at.join(weights.select("row", F.col("weight").cast("double").alias("_w")), "row", "left"))
    sums = {"_s": ("sum", F.coalesce("_w", F.lit(0.0)), True), "_k": ("sum", F.when(F.col("_w").isNull(), 0).otherwise(1), True)}
    run = cut(S.scan(S.by_ranges(own, "place"), [], "place", sums))
    first = run.select(F.col("place").alias("_from"), (F.col("_s") - F.coalesce("_w", F.lit(0.0))).alias("_s0"), (F.col("_k") - F.when(F.col("_w").isNull(), 0).otherwise(1)).alias("_k0"))
    last = run.select(F.col("place").alias("_to"), F.col("_s").alias("_s1"), F.col("_k").alias("_k1"))
    sizes = merges.select(F.struct("made", "row").alias("node"), "size")
    spans = starts.join(sizes, "node", "left").select("node", F.col("start").alias("_from"), (F.col("start") + F.coalesce("size", F.lit(1)) - 1).alias("_to"))
    means = cut(spans.join(first, "_from").join(last, "_to").select("node", ((F.col("_s1") - F.col("_s0")) / F.nullif(F.col("_k1") - F.col("_k0"), F.lit(0))).alias("_mean")))
    rows = merges
    for side in ("left", "right"):
        about = means.select(F.col("node.made").alias(f"{side}_made"), F.col("node.row").alias(f"{side}_row"), F.col("_mean").alias(f"_{side}"))
        rows = rows.join(about, [f"{side}_made", f"{side}_row"], "left")
    turn = F.coalesce(F.col("_left") > F.col("_right"), F.lit(False))
    swapped = [F.when(turn, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{a}_{c}") for a, b in (("left", "right"), ("right", "left")) for c in ("made", "row")]
    return rows.select(*swapped, "height", "size", "made", "row")
