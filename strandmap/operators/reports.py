"""Tables by group of cells or slice of an order, and the data behind the reports: borders, karyotypes, duplicates, densities, spliced reads.

Null cells, places and groups drop out of joins; an empty table gives an empty one unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import distance as D
from strandmap.functions import measures
from strandmap.operators import annotation as A
from strandmap.operators import areas as AR
from strandmap.operators import domains as DO
from strandmap.operators import intervals as I
from strandmap.operators import loops as L
from strandmap.operators import maps as MA
from strandmap.operators import meetings as M
from strandmap.operators.lineage import cut


def slices(order: DataFrame, size: int) -> DataFrame:
    """Cells (cell_id, ord from 1) with grp, their slice of ``size`` cells from 0."""
    return order.select("cell_id", F.floor((F.col("ord") - 1) / size).alias("grp"))


def group_borders(contacts: DataFrame, groups: DataFrame, scale: int, res: int, most: float, low: int, high: int) -> DataFrame:
    """Borders of all groups (cell_id, grp) of cells as one set, with each group's insulation there (null if it has no contacts there).

    A group's borders are the centres of its runs of bins below ``most``; those of different groups that are ``low`` to
    ``high`` apart become one.
    """
    insulated = cut(MA.insulation(contacts.join(groups, "cell_id"), scale, res, by=("grp",)))
    own = I.centers(I.screen(insulated, F.col("insulation") < most, res, ["grp"]))
    common = A.common_borders(cut(own), low, high)
    names = groups.select("grp").distinct().agg(F.collect_set("grp").alias("_all"))  # a name a group
    grid = common.join(F.broadcast(names)).withColumn("grp", F.explode("_all")).drop("_all", "end_")
    values = insulated.select("chrom", "grp", F.col("start").alias("_bin"), "insulation")
    return grid.withColumn("_bin", F.floor(F.col("start") / res) * res).join(values, ["chrom", "grp", "_bin"], "left").select("chrom", "start", "grp", "insulation")


def slice_insulation(counts: DataFrame, groups: DataFrame, delta: float) -> DataFrame:
    """log2((a + delta) / (a + b1 + b2 + delta)) of every locus and group, and the same less the locus's mean over the groups.

    counts: cell_id, chrom, at, a, b1, b2 (see ``maps.triangles``).
    """
    summed = counts.join(groups, "cell_id").groupBy("chrom", "at", "grp").agg(*(F.sum(c).alias(c) for c in ("a", "b1", "b2")))
    rows = summed.withColumn("ins", F.log2((F.col("a") + delta) / (F.col("a") + F.col("b1") + F.col("b2") + delta)))
    return rows.withColumn("centred", F.col("ins") - F.avg("ins").over(Window.partitionBy("chrom", "at")))


def sampled_triangles(contacts: DataFrame, loci: DataFrame, scale: int, discard_below: int, n: int, seed: str) -> DataFrame:
    """a, b1 and b2 of ``n`` contacts drawn without return at every locus; loci with fewer go.

    Contacts are drawn by the digest of their cell, places and ``seed``, so the draw depends on rows alone; equal rows count as often as they occur.
    """
    rows = MA.triangle_rows(contacts, loci, scale, discard_below)
    name = F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in ("cell_id", "start1", "start2")))
    enough = rows.groupBy("chrom", "at").count().where(F.col("count") >= n).select("chrom", "at")
    first = Window.partitionBy("chrom", "at").orderBy(F.md5(name), "cell_id", "start1", "start2")
    drawn = rows.join(enough, ["chrom", "at"]).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= n)
    return drawn.groupBy("chrom", "at").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("a", "b1", "b2")))


def hit_distances(contacts: DataFrame, hits1: DataFrame, hits2: DataFrame, reach: int) -> DataFrame:
    """Contacts with x and y: how far side 1 is from the nearest of ``hits1`` and side 2 from that of ``hits2`` (chrom, start); both within ``reach``.

    Of two hits equally near the one after the place counts (negative distance).
    """
    return M.nearest(M.nearest(contacts, "chrom1", "start1", hits1, reach, "x"), "chrom2", "start2", hits2, reach, "y")


def hotspots(pairs: DataFrame, size: int, omit: int, least: float = 2.0, smooth: bool = True) -> DataFrame:
    """Contacts by their distances x and y from hits in bins of ``size``, against what the margins of far ones expect, as log2.

    The margin of x is taken where y is over ``omit`` bins away, and the other way round; cells that expect fewer than
    ``least`` contacts or have none are null. Both ratios are to their means. With ``smooth`` a cell is the mean of itself
    and the next ones up and right, null if one of them is.
    """
    i, j = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    cells = pairs.groupBy(i.alias("i"), j.alias("j")).agg(
        F.count("*").alias("n"), F.count_if(F.abs("y") > omit * size).alias("_fy"), F.count_if(F.abs("x") > omit * size).alias("_fx")
    )
    of = lambda c, *by: F.sum(c).over(Window.partitionBy(*by or (F.lit(1),)))  # noqa: E731  a row a cell of the grid, whose size the parameters fix
    rows = cells.withColumns({"_mx": of("_fy", "i"), "_my": of("_fx", "j"), "_n": of("n"), "_ny": of("_fy"), "_nx": of("_fx")})
    kinds = lambda c, m: F.size(F.collect_set(F.when(F.col(m) > 0, F.col(c))).over(Window.partitionBy(F.lit(1))))
    rows = rows.withColumns({"_kx": kinds("i", "_mx"), "_ky": kinds("j", "_my")}).where("_mx > 0 and _my > 0")
    rows = rows.withColumn("_e", F.col("_mx") / F.col("_ny") * F.col("_my") / F.col("_nx")).where(F.col("_e") * F.col("_n") >= least)
    mean = F.avg("n").over(Window.partitionBy(F.lit(1)))
    ratio = rows.select("i", "j", "n", (F.log2(F.col("n") / mean) - F.log2(F.col("_e") * F.col("_kx") * F.col("_ky"))).alias("ratio"))
    if not smooth:
        return ratio
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    spread = ratio.withColumn("_s", steps).select((F.col("i") - F.col("_s.a")).alias("i"), (F.col("j") - F.col("_s.b")).alias("j"), "ratio")
    return spread.groupBy("i", "j").agg(F.count("*").alias("_n"), F.avg("ratio").alias("ratio")).where("_n = 4").drop("_n")


def replicated_loops(counted: DataFrame, track: DataFrame, size: int, inner: int, outer: int, quantile: float) -> DataFrame:
    """Loops (see ``loops.counts``) whose focal enrichment is in the upper part from ``quantile`` on, with the replication classes of both sides (0: none known)."""
    enr = L.enrichment(counted, inner, outer)
    floor = enr.groupBy("enr").agg(F.count("*").alias("_n")).agg(F.percentile("enr", F.lit(quantile), F.col("_n")).alias("_least"))
    rows = enr.join(F.broadcast(floor)).where(F.col("enr") >= F.col("_least"))
    for i in (1, 2):
        at = track.select("chrom", (F.floor(F.col("start") / size)).alias(f"_b{i}"), D.tor_class(F.col("v")).alias(f"tor{i}"))
        rows = rows.withColumn(f"_b{i}", F.floor(F.col(f"start{i}") / size)).join(at, ["chrom", f"_b{i}"], "left")
    return rows.na.fill(0, ["tor1", "tor2"]).select("site1", "site2", "n1", "n2", "enr", "tor1", "tor2")


def pool_domains(contacts: DataFrame, scale: int, res: int, quantile: float, track: DataFrame, size: int, low: int, high: int) -> DataFrame:
    """Runs of bins that are not insulated, ``low`` to ``high`` bases long, with the track's mean.

    A bin is insulated if its value is below the ``quantile`` of all; bins without a value are.
    """
    insulated = cut(MA.insulation(contacts, scale, res))
    least = insulated.agg(F.percentile("insulation", F.lit(quantile)).alias("_cut"))
    runs = cut(I.screen(insulated.join(F.broadcast(least)), F.col("insulation") >= F.col("_cut"), res).where((F.col("end_") - F.col("start")).between(low, high)))
    placed = runs.withColumn("key", F.struct("chrom", "start"))
    mean = A.window_values(placed, track, "key", size).select("key", F.col("mean").alias("tor"))
    return placed.join(mean, "key").select("chrom", "start", "end_", "tor")


def karyotype(contacts: DataFrame) -> DataFrame:
    """Sides of contacts by cell and chromosome, their share of the cell's, and log2 of it over the chromosome's mean share."""
    sides = contacts.select("cell_id", F.explode(F.array("chrom1", "chrom2")).alias("chrom")).groupBy("cell_id", "chrom").agg(F.count("*").alias("n"))
    rows = sides.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cell_id")))
    return rows.withColumn("enr", F.log2(F.col("share") / F.avg("share").over(Window.partitionBy("chrom"))))


def quality_series(contacts: DataFrame, near: tuple[int, int], far: int) -> DataFrame:
    """Contacts, reads, shares between chromosomes and below 1 kb, log2 of far over near ones (null without either), and share of repeated reads by cell."""
    d = D.distance()
    n_far, n_near = F.count_if(d >= far), F.count_if((d >= near[0]) & (d < near[1]))
    return contacts.groupBy("cell_id").agg(
        F.count("*").alias("n"),
        F.sum("cnt").alias("reads"),
        (F.count_if(d.isNull()) / F.count("*")).alias("f_trans"),
        (F.count_if(d < 1000) / F.count("*")).alias("f_nodig"),
        F.when((n_far > 0) & (n_near > 0), F.log2(n_far / n_near)).alias("far_close"),
        (1 - F.count("*") / F.sum("cnt")).alias("f_dup"),
    )


def duplicate_report(contacts: DataFrame) -> DataFrame:
    """Reads and contacts of every cell, the share of contacts seen more than once, and what as many equal draws expect."""
    rows = contacts.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("cnt").alias("reads"), (F.count_if(F.col("cnt") > 1) / F.count("*")).alias("observed"))
    return rows.withColumn("expected", measures.expected_duplicates(F.col("n"), F.col("reads")))


def early_coverage(contacts: DataFrame, track: DataFrame, size: int, least: float) -> DataFrame:
    """Share of the sides in bins of ``least`` or more by cell and chromosome, and log2 of it over the chromosome's mean (null for none).

    Sides in bins without a value do not count.
    """
    sides = F.explode(F.array(*(F.struct(F.col(f"chrom{i}").alias("chrom"), F.floor(F.col(f"start{i}") / size).alias("bin")) for i in (1, 2))))
    counts = contacts.select("cell_id", sides.alias("s")).groupBy("cell_id", "s.chrom", "s.bin").agg(F.count("*").alias("_n"))
    at = track.select("chrom", F.floor(F.col("start") / size).alias("bin"), "v").where("v is not null")
    rows = counts.join(at, ["chrom", "bin"]).groupBy("cell_id", "chrom").agg((F.sum(F.when(F.col("v") >= least, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("early"))
    return rows.withColumn("enr", F.when(F.col("early") > 0, F.log2(F.col("early") / F.avg("early").over(Window.partitionBy("chrom")))))


def class_expectation(contacts: DataFrame, domains: DataFrame) -> DataFrame:
    """Contacts between classes of domains (fid, chrom, start, end_, ab), in both orders, against the product of the classes' margins; within and between chromosomes apart."""
    side = lambda i: domains.select(F.col("fid").alias(f"fid{i}"), F.col("ab").alias(f"class{i}"))
    rows = DO.in_domains(contacts, domains).join(side(1), "fid1").join(side(2), "fid2").where("fid1 <> fid2")
    one = rows.groupBy(D.is_cis().alias("cis"), "class1", "class2").agg(F.count("*").alias("n"))
    both = one.unionByName(one.select("cis", F.col("class2").alias("class1"), F.col("class1").alias("class2"), "n")).groupBy("cis", "class1", "class2").agg(F.sum("n").alias("n"))
    margin = lambda *c: F.sum("n").over(Window.partitionBy("cis", *c))  # noqa: E731  a row a pair of classes
    rows = both.withColumn("expected", margin("class1") * margin("class2") / margin())
    return rows.withColumn("enr", F.log2(F.col("n") / F.col("expected")))


def density_2d(points: DataFrame, x: str, y: str, size: float, sd: float, reach: int) -> DataFrame:
    """Gaussian density of two columns on a grid of ``size``: points are counted by cell, and each cell spreads over those up to ``reach`` cells away.

    ``sd`` is in cells; kernels are cut at ``reach`` and not scaled up for it. Points with a null are left out.
    """
    cells = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor(F.col(x) / size).alias("_x"), F.floor(F.col(y) / size).alias("_y")).agg(F.count("*").alias("_n"))
    total = cells.agg(F.sum("_n").alias("_total"))
    step = lambda: F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    spread = cells.withColumn("_a", step()).withColumn("_b", step())
    weight = F.col("_n") * F.exp(-(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")) / (2.0 * sd * sd))
    summed = spread.groupBy((F.col("_x") + F.col("_a")).alias("i"), (F.col("_y") + F.col("_b")).alias("j")).agg(F.sum(weight).alias("_w"))
    scale = 2.0 * 3.141592653589793 * sd * sd * size * size
    return summed.join(F.broadcast(total)).select("i", "j", (F.col("_w") / (F.col("_total") * scale)).alias("density"))  # one row


def mean_profiles(decay: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean share of each distance bin over a group's cells; cells without contacts in a bin count as zero. decay: cell_id, bin, n."""
    shares = decay.withColumn("_share", F.col("n") / F.sum("n").over(Window.partitionBy("cell_id"))).join(groups, "cell_id")
    sizes = shares.groupBy("grp").agg(F.count_distinct("cell_id").alias("cells"))
    return shares.groupBy("grp", "bin").agg(F.sum("_share").alias("_sum")).join(sizes, "grp").select("grp", "bin", "cells", (F.col("_sum") / F.col("cells")).alias("share"))


def band_fractions(contacts: DataFrame, bands: dict[str, tuple[int, int]], mitotic: str, least: float) -> DataFrame:
    """Share of each named band (from, below) among a cell's contacts within chromosomes, log2 of it (null for none), and whether ``mitotic`` reaches ``least``."""
    d = F.col("start2") - F.col("start1")
    share = {k: F.count_if((d >= lo) & (d < hi)) / F.count("*") for k, (lo, hi) in bands.items()}
    rows = contacts.where(D.is_cis()).groupBy("cell_id").agg(*(v.alias(k) for k, v in share.items()))
    logs = [F.when(F.col(k) > 0, F.log2(k)).alias(f"log_{k}") for k in bands]
    return rows.select("*", *logs, (F.col(mitotic) >= least).alias("mitotic_like"))


def mean_distance(decay: DataFrame) -> DataFrame:
    """Mean log2 distance of the bins (size, tor, bin, n) by size and replication class; a bin stands for its upper edge."""
    edge = 10 + F.col("bin") / 8
    return decay.groupBy("size", "tor").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * edge) / F.sum("n")).alias("mean"))


def cut_by_difference(values: DataFrame) -> DataFrame:
    """Rows (ab, v) labelled A or B by the cut where the two classes' distribution functions are furthest apart: columns cut and label.

    Of equal differences the smallest value is the cut; values above it are A. Distribution functions are over distinct values,
    of which there is one a domain at most; without one of the classes no row stays.
    """
    by = Window.partitionBy(F.lit(1)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counts = values.where("v is not null").groupBy("v").agg(F.count_if(F.col("ab") == "A").alias("_a"), F.count_if(F.col("ab") == "B").alias("_b"))
    sums = counts.agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    gap = F.abs(F.try_divide(F.sum("_a").over(by), F.col("_na")) - F.try_divide(F.sum("_b").over(by), F.col("_nb")))
    cut = counts.join(F.broadcast(sums)).select("v", gap.alias("_gap")).where("_gap is not null").agg(F.min_by("v", F.struct(-F.round("_gap", 9), F.col("v"))).alias("cut"))
    return values.where("v is not null").join(F.broadcast(cut)).where("cut is not null").withColumn("label", F.when(F.col("v") > F.col("cut"), "A").otherwise("B"))


def ordered_by(cells: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """Each cell's place (from 1) in the order of every criterion; ties go to the smaller cell_id, nulls come last. A row a cell, so one task orders them."""
    place = lambda c: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(c.asc_nulls_last(), "cell_id"))
    return cells.select("cell_id", *(place(c).alias(k) for k, c in criteria.items()))


def spliced(reads: DataFrame, parts: list[str], keep: list[int], seq: str = "seq", qual: str = "qual") -> DataFrame:
    """Reads that begin with the patterns ``parts``, one after the other, cut down to those numbered in ``keep`` (from 0), in that order; qualities follow their bases.

    Parts must not hold groups of their own. Reads that do not match, or whose qualities are not as long as the read, go.
    """
    pattern = "^" + "".join(f"({p})" for p in parts)
    found = [F.regexp_extract(seq, pattern, i + 1) for i in range(len(parts))]
    starts: list[Column] = [F.lit(1)]
    for f in found[:-1]:
        starts.append(starts[-1] + F.length(f))
    good = F.col(seq).rlike(pattern) & (F.length(seq) == F.length(qual))
    return reads.where(good).withColumns({seq: F.concat(*(found[k] for k in keep)), qual: F.concat(*(F.substring(F.col(qual), starts[k], F.length(found[k])) for k in keep))})


def smoothed_ratio(contacts: DataFrame, size: int, windows: list[int], least: int) -> DataFrame:
    """log2 of observed over expected contacts around every cell of each chromosome's map, in bins of ``size``: chrom, i, j, window, n, ratio.

    A cell takes the smallest of ``windows`` (cells to each side, ascending) that holds ``least`` contacts, else the widest
    if that holds 0.6 of them; others, and cells without contacts in reach, have no row. Maps are symmetric; what is expected
    is the product of the margins, summed over the window. Windows are read from summed-area tables (``areas.window_sums``).
    """
    at = [F.floor(F.col(f"start{i}") / size) for i in (1, 2)]
    cis = contacts.where(D.is_cis()).select(F.col("chrom1").alias("chrom"), at[0].alias("i"), at[1].alias("j"))
    cells = cis.unionByName(cis.select("chrom", F.col("j").alias("i"), F.col("i").alias("j"))).groupBy("chrom", "i", "j").agg(F.count("*").alias("_n"))
    w = windows[-1]
    step = lambda: F.explode(F.sequence(F.lit(-w), F.lit(w)))
    held = lambda off, k: F.sum(F.when(off <= k, F.col("_n")).otherwise(0))
    sums = AR.window_sums(cells.withColumnRenamed("_n", "n"), ["chrom"], windows).withColumnRenamed("sums", "_obs")
    margin = cells.groupBy("chrom", "i").agg(F.sum("_n").alias("_n"))
    total = margin.groupBy("chrom").agg(F.sum("_n").alias("_total"))
    wide = margin.withColumn("_a", step()).select("chrom", (F.col("i") + F.col("_a")).alias("i"), F.abs("_a").alias("_off"), "_n").groupBy("chrom", "i").agg(F.array(*(held(F.col("_off"), k) for k in windows)).alias("_m"))
    rows = sums.join(wide.withColumnRenamed("_m", "_mi"), ["chrom", "i"]).join(wide.select("chrom", F.col("i").alias("j"), F.col("_m").alias("_mj")), ["chrom", "j"]).join(total, "chrom")
    last = len(windows) - 1
    chosen = F.coalesce(*(F.when(F.get("_obs", F.lit(k)) >= least, k) for k in range(last + 1)), F.when(F.get("_obs", F.lit(last)) >= 0.6 * least, last))
    rows = rows.withColumn("_k", chosen).where("_k is not null").withColumns({"n": F.get("_obs", F.col("_k")), "window": F.get(F.array(*map(F.lit, windows)), F.col("_k"))})
    expected = F.get("_mi", F.col("_k")) * F.get("_mj", F.col("_k")) / F.col("_total")
    return rows.where("n > 0").select("chrom", "i", "j", "window", "n", F.log2(F.col("n") / expected).alias("ratio"))


def even_cells(contacts: DataFrame, most: float) -> DataFrame:
    """Contacts of the cells no chromosome of which is over- or underrepresented by more than ``most`` (log2, see ``karyotype``)."""
    kept = karyotype(contacts).groupBy("cell_id").agg(F.max(F.abs("enr")).alias("_most")).where(F.col("_most") <= most).select("cell_id")
    return contacts.join(kept, "cell_id", "left_semi")


def cell_stats(contacts: DataFrame, cells: DataFrame, bands: dict[str, tuple[int, int]], mitotic: str, least: float, near: tuple[int, int] = (1000, 2_000_000), far: int = 4_000_000) -> DataFrame:
    """One wide row a cell with contacts: the quality series, expected duplicates, shares of the bands, largest chromosome enrichment, and the cell's group (null if unknown)."""
    even = karyotype(contacts).groupBy("cell_id").agg(F.max(F.abs("enr")).alias("max_enr"))
    expected = duplicate_report(contacts).select("cell_id", "expected")
    out = quality_series(contacts, near, far)
    for table in (expected, band_fractions(contacts, bands, mitotic, least), even, cells.select("cell_id", F.col("cond").alias("grp"))):
        out = out.join(table, "cell_id", "left")
    return out
