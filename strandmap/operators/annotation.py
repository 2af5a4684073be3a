"""Values of tracks around intervals and rectangles, and what places, starts, domains and contacts are by them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.operators import intervals as I
from strandmap.operators import meetings as M


def window_values(places: DataFrame, track: DataFrame, key: str, size: int, low: int = 0, high: int = 0) -> DataFrame:
    """What the bins (chrom, start, v; ``size`` long) that [start + low, end_ + high) touches hold.

    ``key`` names rows of ``places`` (key, chrom, start, end_). Gives n bins with a value, mean, least, most, total,
    and weighted (values times shared bases); a place that touches no bin has n = 0 and nulls.
    """
    lo, hi = F.greatest(F.col("start") + low, F.lit(0)), F.col("end_") + high
    wide = places.select(key, "chrom", lo.alias("_lo"), hi.alias("_hi")).where("_lo < _hi")
    cut = wide.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor((F.col("_hi") - 1) / size))))
    bins = track.select(F.col("chrom").alias("_c"), F.floor(F.col("start") / size).alias("_b"), F.col("v").cast("double").alias("_v"))
    hit = cut.join(bins, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")))
    shared = F.least("_hi", (F.col("_bin") + 1) * size) - F.greatest("_lo", F.col("_bin") * size)
    found = hit.groupBy(key).agg(
        F.count("_v").alias("n"),
        F.avg("_v").alias("mean"),
        F.min("_v").alias("least"),
        F.max("_v").alias("most"),
        F.sum("_v").alias("total"),
        F.sum(F.col("_v") * shared).alias("weighted"),
    )
    return places.select(key).join(found, key, "left").na.fill(0, ["n"])


def rectangle_values(rects: DataFrame, contacts: DataFrame, key: str, cell: int, band: tuple[int, int] | None = None) -> DataFrame:
    """Contacts in every rectangle (key, chrom1, lo1, hi1, chrom2, lo2, hi2): area (contacts), weighted (summed counts) and most.

    With ``band`` only contacts with band[0] <= start2 - start1 < band[1] on one chromosome count. Contacts of one place
    are added up before they travel; rectangles go to the squares of ``cell`` bases that they touch. Empty ones have 0, 0 and null.
    """
    rows = contacts
    if band is not None:
        gap = F.col("start2") - F.col("start1")
        rows = rows.where((F.col("chrom1") == F.col("chrom2")) & (gap >= band[0]) & (gap < band[1]))
    spots = rows.groupBy("chrom1", "start1", "chrom2", "start2").agg(F.count("*").alias("_n"), F.sum("cnt").alias("_sum"), F.max("cnt").alias("_max"))
    spots = spots.withColumns({"_i": F.floor(F.col("start1") / cell), "_j": F.floor(F.col("start2") / cell)})
    cells = lambda i: F.explode(F.sequence(F.floor(F.col(f"lo{i}") / cell), F.floor((F.col(f"hi{i}") - 1) / cell)))
    cut = rects.where("lo1 < hi1 and lo2 < hi2").withColumn("_i", cells(1)).withColumn("_j", cells(2))
    hit = cut.join(spots, ["chrom1", "chrom2", "_i", "_j"])
    hit = hit.where((F.col("start1") >= F.col("lo1")) & (F.col("start1") < F.col("hi1")) & (F.col("start2") >= F.col("lo2")) & (F.col("start2") < F.col("hi2")))
    found = hit.groupBy(key).agg(F.sum("_n").alias("area"), F.sum("_sum").alias("weighted"), F.max("_max").alias("most"))
    return rects.select(key).join(found, key, "left").na.fill(0, ["area", "weighted"])


def side_type(kinds: Column) -> Column:
    """What a side is by the set of site types near it: B (both ways), F, R, C (bound, no motif) or N (none)."""
    has = lambda t: F.array_contains(kinds, t)
    both = has("B") | (has("F") & has("R"))
    return F.when(both, "B").when(has("F"), "F").when(has("R"), "R").when(has("C"), "C").otherwise("N")


def contact_type(a: Column, b: Column) -> Column:
    """none, chip, diver, conv, same or one_sided; R before F is conv."""
    pair = F.concat(a, b)
    named = F.when(pair == "NN", "none").when((a == "C") | (b == "C"), "chip")
    named = named.when(pair.isin("FR", "BR", "FB"), "diver").when(pair.isin("RF", "BF", "RB", "BB"), "conv")
    return named.when(pair.isin("RR", "FF"), "same").otherwise("one_sided")


def _side_number(has: dict[str, np.ndarray]) -> np.ndarray:
    """``side_type`` as a number in NCRFB."""
    both = has["B"] | (has["F"] & has["R"])
    return np.where(both, 4, np.where(has["F"], 3, np.where(has["R"], 2, np.where(has["C"], 1, 0))))


def contact_classes(contacts: DataFrame, sites: DataFrame, reach: int) -> DataFrame:
    """Contacts with type1, type2 and type, by the sites (chrom, start, end_, type) at most ``reach`` from each side."""
    near = sites.select("chrom", (F.col("start") - reach).alias("start"), (F.col("end_") + reach).alias("end_"), "type")
    out = contacts
    for i in (1, 2):
        out = M.covering(out, f"chrom{i}", f"start{i}", near, list("FRCB"), _side_number, list("NCRFB"), f"type{i}")
    return out.withColumn("type", contact_type(F.col("type1"), F.col("type2")))


def start_classes(starts: DataFrame, key: str, least: float, reach: int, chrom_len: int) -> DataFrame:
    """Gene starts (key, chrom, start, end_, rna, mark) with type T (rna of ``least`` or more) or F, and the one of each merged group with the highest mark.

    Starts within 2 * ``reach`` of each other are one group; ties go to the smaller key; without any mark a group has none selected.
    """
    groups = I.canonic(I.expand(starts.select("chrom", "start", "end_"), reach, chrom_len)).withColumnRenamed("n", "members").withColumn("_group", F.col("start"))
    rows = I.containing(starts, groups, "chrom", "start", "_group", "_of")
    best = Window.partitionBy("chrom", "_of").orderBy(F.desc_nulls_last("mark"), key)
    rows = rows.withColumn("selected", (F.row_number().over(best) == 1) & F.col("mark").isNotNull())
    return rows.withColumn("type", F.when(F.col("rna") >= least, "T").otherwise("F")).drop("_of")


def domain_means(domains: DataFrame, starts: DataFrame, track: DataFrame, key: str, size: int) -> DataFrame:
    """Mean of log2(1 + v) of the track's bins at the starts (chrom, start) in each domain; null without any."""
    bins = track.select(F.col("chrom").alias("_tc"), F.floor(F.col("start") / size).alias("_tb"), F.log2(1 + F.col("v")).alias("_v"))
    at = starts.select("chrom", "start").join(bins, (F.col("chrom") == F.col("_tc")) & (F.floor(F.col("start") / size) == F.col("_tb"))).select("chrom", "start", "_v")
    inside = I.containing(at, domains, "chrom", "start", key, "_domain")
    return domains.select(key).join(inside.groupBy(F.col("_domain").alias(key)).agg(F.avg("_v").alias("mean")), key, "left")


def middle_fragments(points: DataFrame, frags: DataFrame, key: str, width: int, used: DataFrame | None = None) -> DataFrame:
    """The middle one of the fragments that lie whole in the ``width`` bases before each point (key, chrom, at); those of ``used`` (fid) do not count.

    Of n it is number n / 2, rounded half to even, and the first at least; points without one go.
    """
    free = frags if used is None else frags.join(used.select("fid").distinct(), "fid", "left_anti")
    return middle_of(fragments_within(points.select(key, "chrom", "at"), free, key, width), key)


def fragments_within(points: DataFrame, frags: DataFrame, key: str, width: int) -> DataFrame:
    """The fragments that lie whole in the ``width`` bases before each point (key, chrom, at, further columns), with the point's columns but the place."""
    near = points.withColumnsRenamed({"chrom": "_c", "at": "_hi"}).withColumn("_lo", F.col("_hi") - width)
    hit = I.overlap_join(near, frags.select("fid", "chrom", "start", "end_"), ("_c", "_lo", "_hi"), ("chrom", "start", "end_"), max(width, 1))
    return hit.where((F.col("start") >= F.col("_lo")) & (F.col("end_") <= F.col("_hi"))).drop("_c", "_hi", "_lo")


def middle_of(hit: DataFrame, key: str) -> DataFrame:
    """The middle one of the fragments (key, fid, start) of each key: of n number n / 2, rounded half to even, and the first at least."""
    by = Window.partitionBy(key)
    rows = hit.withColumns({"_k": F.row_number().over(by.orderBy("start", "fid")), "_n": F.count("*").over(by)})
    return rows.where(F.col("_k") == F.greatest(F.bround(F.col("_n") / 2), F.lit(1))).select(key, "fid")


def common_borders(borders: DataFrame, low: int, high: int) -> DataFrame:
    """Borders (chrom, start, end_) of several groups as one set: those ``low`` to ``high`` apart span an interval, overlapping ones merge, spans over ``high`` go, the rest are their centres."""
    points = borders.select("chrom", "start", "end_").distinct()
    right = points.select(F.col("chrom").alias("chrom2"), F.col("start").alias("start2"))
    pairs = I.band_pairs(points.select("chrom", F.col("start").alias("start1")), right, low, high)
    spans = pairs.select("chrom", F.col("start1").alias("start"), F.col("start2").alias("end_"))
    alone = points.join(spans.select("chrom", "start").distinct(), ["chrom", "start"], "left_anti").select("chrom", "start", "end_")
    return I.centers(I.canonic(spans.unionByName(alone)).where(F.col("end_") - F.col("start") <= high)).select("chrom", "start", "end_")


def fragment_offsets(points: DataFrame, frags: DataFrame, key: str) -> DataFrame:
    """Each point (key, chrom, start) with its fragment and the distances from that one's ends: fid, off5, off3; points outside all go."""
    at = points.select(key, F.col("chrom").alias("_c"), F.col("start").alias("_at"), (F.col("start") + 1).alias("_to"))
    hit = I.overlap_join(at, frags.select("fid", "chrom", "start", "end_"), ("_c", "_at", "_to"), ("chrom", "start", "end_"))
    return hit.select(key, "fid", (F.col("_at") - F.col("start")).alias("off5"), (F.col("end_") - F.col("_at")).alias("off3"))


def mappable(sam: DataFrame, size: int) -> DataFrame:
    """Reads named chrom_start that came back to where they are from, by bin of ``size``. sam: read_id, chrom (text), pos."""
    origin = F.split("read_id", "_")
    back = sam.where((F.get(origin, F.lit(0)) == F.col("chrom")) & (F.get(origin, F.lit(1)) == F.col("pos").cast("string")))
    return back.groupBy("chrom", (F.floor(F.col("pos") / size) * size).alias("start")).agg(F.count("*").alias("n"))


def pattern_counts(reads: DataFrame, first: str, second: str | None = None) -> DataFrame:
    """Reads by what the first group of each pattern takes from seq (and from the mate's seq2); both must be found."""
    found = F.col("seq").rlike(first)
    code = F.regexp_extract("seq", first, 1)
    if second is not None:
        found, code = found & F.col("seq2").rlike(second), F.concat(code, F.regexp_extract("seq2", second, 1))
    return reads.where(found).groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def natural_key(text: Column) -> Column:
    """A key that sorts text with its runs of digits as numbers (of up to 30 digits)."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.ltrim(x, F.lit("0")), 30, "0")).otherwise(x)), "")


def shuffled(contacts: DataFrame, seed: str, digits: int = 3) -> DataFrame:
    """Contacts with their second sides permuted over all rows: the n-th first side in one order of digests meets the n-th second side in another.

    A row's number is its place in the bucket that its digest's first ``digits`` name, after the sizes of the buckets
    before; there are 16^digits buckets, so three digits suit some 10^10 rows. Equal rows are interchangeable. Both sides must be known.
    """
    rows = contacts.where("chrom1 is not null and start1 is not null and chrom2 is not null and start2 is not null")
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in ("chrom1", "start1", "chrom2", "start2")))

    def numbered(letter: str, side: int) -> DataFrame:
        placed = rows.select(f"chrom{side}", f"start{side}", F.md5(F.concat(F.lit(f"{seed}{letter}:"), name)).alias("_h")).withColumn("_bucket", F.substring("_h", 1, digits))
        before = Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 16^digits rows at most
        sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", f"chrom{side}", f"start{side}"))
        return placed.withColumn("_k", within).join(F.broadcast(sizes), "_bucket").select(f"chrom{side}", f"start{side}", (F.col("_before") + F.col("_k")).alias("_at"))

    return numbered("a", 1).join(numbered("b", 2), "_at").select("chrom1", "start1", "chrom2", "start2")


def pair_enrichments(pairs: DataFrame, chrom_len: int) -> DataFrame:
    """Contacts n of two chromosomes (cell_id, a, b, n) as share of the cell's, log2 of it over the pair's mean share (null for none), and density a square megabase."""
    rows = pairs.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("cell_id"))))
    usual = rows.groupBy("a", "b").agg(F.avg("share").alias("_mean"))
    enrichment = F.when(F.col("n") > 0, F.log2(F.col("share") / F.col("_mean")))
    side = chrom_len / 1_000_000
    return rows.join(F.broadcast(usual), ["a", "b"]).select("cell_id", "a", "b", "n", "share", enrichment.alias("enrichment"), (F.col("n") / (side * side)).alias("density"))  # a row a pair of chromosomes


def piled_up(reads: DataFrame, size: int) -> DataFrame:
    """Reads (chrom, start, end_) over every bin of ``size`` that they touch; empty ones touch none."""
    cells = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end_") - 1) / size))
    touched = reads.where("start < end_").select("chrom", F.explode(cells).alias("cell"))
    return touched.groupBy("chrom", (F.col("cell") * size).alias("start")).agg(F.count("*").alias("n"))


def chromosome_phasing(contacts: DataFrame, near: tuple[int, int] = (25_000, 2_000_000), far: int = 4_500_000) -> DataFrame:
    """For every cell and chromosome its contacts, the share of near ones and the mean distance of far ones (null without any)."""
    rows = contacts.where("chrom1 = chrom2 and start2 > start1").select("cell_id", F.col("chrom1").alias("chrom"), (F.col("start2") - F.col("start1")).alias("d"))
    d = F.col("d")
    distant = F.when(d >= far, d)
    return rows.groupBy("cell_id", "chrom").agg(
        F.count("*").alias("n"),
        (F.count_if((d >= near[0]) & (d < near[1])) / F.count("*")).alias("near"),
        F.try_divide(F.sum(distant).cast("double"), F.count(distant)).alias("far_mean"),
    )
