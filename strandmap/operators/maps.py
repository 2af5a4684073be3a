"""Two-dimensional windows over contacts: insulation, direction, asymmetry, loops, binned maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import distance as D


def insulation(contacts: DataFrame, scale: int, res: int, min_diag: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """For every multiple of ``res`` (and value of the columns ``by``): contacts with both ends within +-scale (big), those that cross it (ins), log2(ins / (big + 10)).

    A contact counts at a run of neighbouring edges: it is added at the first and taken off past the last, whatever their
    number, and a running sum over the edges gives the counts. Marks of one edge are summed before, so that window has at
    most as many rows as a chromosome has edges.
    """
    near = D.is_cis() & (F.col("start2") - F.col("start1") >= min_diag) & (F.col("start2") - F.col("start1") < 2 * scale)
    place = lambda c: F.floor(c / res)
    first, last = F.greatest(place(F.col("start2") - scale) + 1, F.lit(0)), place(F.col("start1") + scale)
    cross, over = F.greatest(first, place(F.col("start1")) + 1), F.least(last, place(F.col("start2")))
    mark = lambda at, big, ins: F.struct(at.cast("long").alias("at"), F.lit(big).alias("big"), F.lit(ins).alias("ins"))
    marks = F.array(mark(first, 1, 0), mark(last + 1, -1, 0), mark(cross, 0, 1), mark(F.greatest(over + 1, cross), 0, -1))  # an empty run adds and takes off at one place
    keys = [*by, "chrom"]
    ends = contacts.where(near & (first <= last)).select(*by, F.col("chrom1").alias("chrom"), "cnt", F.explode(marks).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum(F.col("e.big") * F.col("cnt")).alias("_big"), F.sum(F.col("e.ins") * F.col("cnt")).alias("_ins"))
    order = Window.partitionBy(*keys).orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = steps.select(*keys, "at", F.lead("at").over(order).alias("_until"), F.sum("_big").over(run).alias("big"), F.sum("_ins").over(run).alias("ins")).where("big > 0")
    out = out.withColumn("at", F.explode(F.sequence("at", F.col("_until") - 1)))  # up to the next mark nothing changes
    return out.select(*keys, (F.col("at") * res).alias("start"), "big", "ins", F.when(F.col("ins") > 0, F.log2(F.col("ins") / (F.col("big") + 10))).alias("insulation"))


def triangle_rows(contacts: DataFrame, loci: DataFrame, scale: int, discard_below: int) -> DataFrame:
    """Contacts (cell_id, start1, start2) at each locus (chrom, at) with their kind: across it (a), or within ``scale`` before (b1) or after it (b2)."""
    cis = contacts.where(D.is_cis() & (F.col("start2") - F.col("start1") >= discard_below) & (F.col("start2") - F.col("start1") < 2 * scale))
    cut = cis.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("start1") - scale) / scale), F.floor((F.col("start2") + scale) / scale))))
    rows = cut.join(loci.withColumn("_at_cell", F.floor(F.col("at") / scale)), (F.col("chrom1") == F.col("chrom")) & (F.col("_cell") == F.col("_at_cell")))
    lo, hi, at = F.col("start1") >= F.col("at") - scale, F.col("start2") < F.col("at") + scale, F.col("at")
    kind = F.when(lo & hi & (F.col("start1") < at) & (F.col("start2") >= at), "a").when(lo & (F.col("start2") < at), "b1").when(hi & (F.col("start1") >= at), "b2")
    return rows.select("cell_id", "chrom", "at", "start1", "start2", kind.alias("kind")).where("kind is not null")


def triangles(contacts: DataFrame, loci: DataFrame, scale: int, discard_below: int) -> DataFrame:
    """For every cell and locus (chrom, at): contacts that cross it (a), and those within ``scale`` before (b1) and after it (b2)."""
    rows = triangle_rows(contacts, loci, scale, discard_below)
    return rows.groupBy("cell_id", "chrom", "at").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("a", "b1", "b2")))


def direction(contacts: DataFrame, scale: int, res: int, min_diag: int = 1000) -> DataFrame:
    """Contacts of every bin of ``res`` with what lies up to ``scale`` before (up) and after it (down), and the directionality index."""
    cis = contacts.where(D.is_cis() & (F.col("start2") - F.col("start1") >= min_diag) & (F.col("start2") - F.col("start1") < scale))
    sides = cis.select("chrom1", "cnt", F.explode(F.array(F.struct(F.col("start1").alias("at"), F.lit(1).alias("down")), F.struct(F.col("start2").alias("at"), F.lit(0).alias("down")))).alias("s"))
    out = sides.groupBy(F.col("chrom1").alias("chrom"), (F.floor(F.col("s.at") / res) * res).alias("start")).agg(F.sum(F.when(F.col("s.down") == 0, F.col("cnt")).otherwise(0)).alias("up"), F.sum(F.when(F.col("s.down") == 1, F.col("cnt")).otherwise(0)).alias("down"))
    a, b, e = F.col("up"), F.col("down"), (F.col("up") + F.col("down")) / 2
    return out.withColumn("di", F.when(a == b, 0.0).otherwise(F.signum((b - a).cast("double")) * (F.pow(a - e, 2) + F.pow(b - e, 2)) / e))


def asymmetry(contacts: DataFrame, scale: int, res: int, horiz: int) -> DataFrame:
    """Contacts of the neighbourhood (+-horiz) of every multiple of ``res`` with what lies up to ``scale`` to its left and right."""
    cis = contacts.where(D.is_cis() & (F.col("start2") - F.col("start1") < scale))
    sides = cis.select("chrom1", "cnt", F.explode(F.array(F.struct(F.col("start1").alias("at"), F.lit(1).alias("right")), F.struct(F.col("start2").alias("at"), F.lit(0).alias("right")))).alias("s"))
    near = sides.withColumn("_k", F.explode(F.sequence(F.ceil((F.col("s.at") - horiz) / res), F.floor((F.col("s.at") + horiz) / res)))) if horiz >= res else sides.withColumn("_k", F.round(F.col("s.at") / res).cast("long")).where(F.abs(F.col("s.at") - F.col("_k") * res) <= horiz)
    out = near.groupBy(F.col("chrom1").alias("chrom"), (F.col("_k") * res).alias("start")).agg(F.sum(F.when(F.col("s.right") == 0, F.col("cnt")).otherwise(0)).alias("left"), F.sum(F.when(F.col("s.right") == 1, F.col("cnt")).otherwise(0)).alias("right"))
    return out.withColumn("asym", F.log2((F.col("left") + 1) / (F.col("right") + 1)))


def binned_map(contacts: DataFrame, size: int) -> DataFrame:
    """Genome-wide map: contacts of every two bins, and log2 of them plus one."""
    out = contacts.groupBy("chrom1", F.floor(F.col("start1") / size).alias("bin1"), "chrom2", F.floor(F.col("start2") / size).alias("bin2")).agg(F.sum("cnt").alias("n"))
    return out.withColumn("shade", F.log2(F.col("n") + 1.0))


def bait_map(contacts: DataFrame, chrom: int, at: int, five: int, three: int, size: int) -> DataFrame:
    """Square map around a bait, in bins."""
    inside = lambda c: (F.col(c) >= at - five) & (F.col(c) < at + three)
    rows = contacts.where((F.col("chrom1") == chrom) & (F.col("chrom2") == chrom) & inside("start1") & inside("start2"))
    return rows.groupBy(F.floor((F.col("start1") - at) / size).alias("x"), F.floor((F.col("start2") - at) / size).alias("y")).agg(F.sum("cnt").alias("n"))


def loops(sites: DataFrame, low: int, high: int) -> DataFrame:
    """Convergent pairs: a site F before a site R, low to high apart."""
    from strandmap.operators.intervals import band_pairs

    f = sites.where("type = 'F'").select("chrom", F.col("start").alias("start1"), F.col("site_id").alias("site1"))
    r = sites.where("type = 'R'").select(F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("site_id").alias("site2"))
    return band_pairs(f, r, low, high).select("chrom", "site1", "start1", "site2", "start2")
