"""Queries over intervals, domains, windows and maps, with fragments standing for domains (A for even, B for odd numbers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap.operators import contacts as C
from strandmap.operators import domains as DO
from strandmap.operators import intervals as I
from strandmap.operators import loops as L
from strandmap.operators import maps as MA
from strandmap.operators import windows as W
from strandmap.plans.fixtures import CHROM_LEN, duckdb_sql, view


def _over(f, *views):
    return lambda spark, sf: f(*(view(spark, sf, v) for v in views))


def _domains(frags):
    return frags.select("fid", "chrom", "start", "end_", F.when(F.col("fid") % 2 == 0, "A").otherwise("B").alias("ab"))


def _wide(sites, by=50_000):
    return I.expand(sites.select("chrom", "start", "end_"), by, CHROM_LEN)


def _named(sites, kind):
    return sites.where(F.col("type") == kind).select("site_id", "chrom", "start", "end_")


def _second(sites, kind):
    return sites.where(F.col("type") == kind).select(F.col("site_id").alias("site2"), F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("end_").alias("end2"))


def _ordered(contacts):
    """Cells in order of coverage, with their share between chromosomes."""
    from pyspark.sql import Window

    rows = contacts.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum((F.col("chrom1") != F.col("chrom2")).cast("long")).alias("trans"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("n", "cell_id")))  # a row a cell


def _coverage_bins(contacts, size=1_000_000):
    return C.marginal(contacts, size).select("chrom", "start", "area")


def _tor_of(frags, tor):
    mid = F.floor((F.col("start") + F.col("end_")) / 2)
    return frags.withColumn("_bin", F.floor(mid / 100_000) * 100_000).join(tor.select("chrom", F.col("start").alias("_bin"), "v"), ["chrom", "_bin"]).select("fid", "v")


#: How far apart the sites of a loop are, and how near its contacts.
BAND, REACH = (200_000, 1_000_000), 200_000


QUERIES = {
    "a30_named_set": _over(lambda s: s.where("type = 'F'").select("site_id", "chrom", "start", "end_"), "sites"),
    "c30_centers": _over(lambda f: I.centers(f), "frags"),
    "c32_expanded": _over(lambda s: I.expand(s.select("site_id", "chrom", "start", "end_"), 100, CHROM_LEN), "sites"),
    "c33_expanded_2d": _over(lambda c: c.select("chrom1", F.greatest(F.col("start1") - 5000, F.lit(0)).alias("start1"), F.least(F.col("start1") + 5001, F.lit(CHROM_LEN)).alias("end1"), "chrom2", F.greatest(F.col("start2") - 9000, F.lit(0)).alias("start2"), F.least(F.col("start2") + 9001, F.lit(CHROM_LEN)).alias("end2")), "contacts"),
    "d09_screened_runs": _over(lambda c: I.screen(_coverage_bins(c), F.col("area") >= 60, 1_000_000), "contacts"),
    "d10_percentile_peaks": _over(lambda t: I.screen(t.crossJoin(F.broadcast(t.agg(F.percentile("v", F.lit(0.9)).alias("cut")))), F.col("v") > F.col("cut"), 100_000), "tor"),
    "d11_well_covered": _over(lambda c: I.canonic(I.screen(_coverage_bins(c), F.col("area") >= 50, 1_000_000)).select("chrom", "start", "end_"), "contacts"),
    "d12_domain_lengths": _over(lambda f: f.where("end_ - start between 985000 and 1015000"), "frags"),
    "d13_without_gaps": _over(lambda f, s: I.overlap_join(f, s.select(F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("end_").alias("end2")), ("chrom", "start", "end_"), ("chrom2", "start2", "end2"), how="left_anti"), "frags", "sites"),
    "d14_quadrants": _over(lambda c, s: L.quadrants(c.withColumn("chrom", F.col("chrom1")), s, BAND, REACH, ["chrom"]), "contacts", "sites"),
    "d16_per_kb": _over(lambda c, f: DO.per_kb(c, f, 64, 0.0001, 0.01), "contacts", "frags"),
    "e01_nearest_fragment": _over(lambda c, f: I.nearest_end(c.select("chrom1", "start1").distinct(), f, "chrom1", "start1", 50_000), "contacts", "frags"),
    "e04_fends_joined": _over(lambda c, f: c.withColumns({"fend1": F.col("start1") % 1000 * 2, "fend2": F.col("start2") % 1000 * 2 + 1}).join(f.select((F.col("fid") * 2).alias("fend1"), F.col("chrom").alias("chr1"), F.col("start").alias("coord1")), "fend1", "left").join(f.select((F.col("fid") * 2 + 1).alias("fend2"), F.col("chrom").alias("chr2"), F.col("end_").alias("coord2")), "fend2", "left").groupBy("chr1", "chr2").agg(F.count("*").alias("n"), F.sum("coord1").alias("c1"), F.sum("coord2").alias("c2")), "contacts", "frags"),
    "e07_offsets_merged": _over(lambda c: (lambda o: c.join(F.broadcast(o.select(F.col("chrom").alias("chrom1"), F.col("offset").alias("off1"))), "chrom1").join(F.broadcast(o.select(F.col("chrom").alias("chrom2"), F.col("offset").alias("off2"))), "chrom2").select((F.col("start1") + F.col("off1")).alias("x"), (F.col("start2") + F.col("off2")).alias("y"), "cnt"))(W.offsets(c.sparkSession.range(1, 20).select(F.col("id").alias("chrom"), F.lit(CHROM_LEN).cast("long").alias("len")), "chrom", "len").select("chrom", "offset")), "contacts"),
    "e13_two_nearest": _over(lambda s: I.neighbours(_named(s, "F"), _second(s, "R"), 2, 0, 3_000_000, "site_id", "site2").select("site_id", "site2", "dist", "rank"), "sites"),
    "e14_containing_domain": _over(lambda c, f: I.containing(c, f, "chrom1", "start1", "fid", "fid1").groupBy("fid1").agg(F.count("*").alias("n"), F.sum("cnt").alias("cnt")), "contacts", "frags"),
    "e16_site_classes": _over(lambda f, s: I.overlap_join(f, s.select(F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("end_").alias("end2"), "type"), ("chrom", "start", "end_"), ("chrom2", "start2", "end2")).groupBy("fid").agg(F.collect_set("type").alias("kinds")).select("fid", F.when(F.size("kinds") == 2, "B").otherwise(F.get("kinds", F.lit(0))).alias("kind")), "frags", "sites"),
    "e17_band_join": _over(lambda s: MA.loops(s, 200_000, 1_000_000), "sites"),
    "e18_lonely_loops": _over(lambda s: L.lonely(s, BAND, REACH), "sites"),
    "e19_close_borders": _over(lambda s: I.canonic(s.select("chrom", "start", "end_"), gap=20_000), "sites"),
    "e20_overlap_score": _over(lambda f, t: DO.overlap_score(f, t.select("chrom", "start", (F.col("start") + 100_000).alias("end_"), F.col("v").alias("score"))), "frags", "tor"),
    "e21_contingency": _over(lambda f, t: f.select("fid", F.when(F.col("fid") % 3 == 0, "x").otherwise("y").alias("g1")).join(_tor_of(f, t).select("fid", (F.col("v") > 0).alias("g2")), "fid").groupBy("g1").agg(F.count_if("g2").alias("early"), F.count_if(~F.col("g2")).alias("late")), "frags", "tor"),
    "e22_same_domain": _over(lambda c, f: DO.in_domains(c.where("chrom1 = chrom2"), f).where("fid1 = fid2").groupBy("fid1").agg(F.count("*").alias("n")), "contacts", "frags"),
    "e25_good_cells": _over(lambda c, m: c.join(m.where("valid = 1"), "cell_id", "left_semi").groupBy("cell_id").agg(F.count("*").alias("n")).unionByName(c.join(m, "cell_id", "left_anti").groupBy("cell_id").agg((-F.count("*")).alias("n"))), "contacts", "cells"),
    "f38_compartment_contacts": _over(lambda c, f: DO.compartment_contacts(c, _domains(f)), "contacts", "frags"),
    "c40_compartment_enrichments": _over(lambda c, f: DO.compartment_enrichments(DO.compartment_contacts(c.withColumn("cell_id", F.col("cell_id") % 4), _domains(f)), "cis"), "contacts", "frags"),
    "f53_domain_coverage": _over(lambda c, f: DO.coverage(c, f, 23_170), "contacts", "frags"),
    "f54_domain_count_sums": _over(lambda c, f: DO.coverage(c, f, 0, sums=True).groupBy("fid").agg(F.sum("n").alias("n")), "contacts", "frags"),
    "f55_decay_within": _over(lambda c, f, t: DO.decay_within(c, f, t, [980_000, 1_000_000, 1_020_000]), "contacts", "frags", "tor"),
    "f59_a_share": _over(lambda c, f: DO.a_share(DO.pair_totals(c, f), _domains(f)), "contacts", "frags"),
    "f61_a_score": _over(lambda c, f: DO.a_score(DO.pair_totals(c, f), _domains(f)), "contacts", "frags"),
    "f62_cell_scores": _over(lambda c, f: DO.cell_scores(c.withColumn("cell_id", F.col("cell_id") % 4), DO.a_score(DO.pair_totals(c, f), _domains(f)), f, 2, 2), "contacts", "frags"),
    "f64_grid_totals": _over(lambda c, f: DO.grid_totals(DO.pair_totals(c, f), f.select("fid", (F.col("fid") % 10).alias("pc"))), "contacts", "frags"),
    "f74_quantiles": _over(lambda t: t.agg(*(F.percentile("v", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9))), "tor"),
    "f75_percentile_max": _over(lambda f, t: I.containing(t.crossJoin(F.broadcast(t.agg(F.percentile("v", F.lit(0.95)).alias("cut")))), f, "chrom", "start", "fid", "fid").groupBy("fid").agg(F.max("v").alias("most"), F.avg((F.col("v") >= F.col("cut")).cast("int")).alias("share")), "frags", "tor"),
    "f81_window_average": _over(lambda s, t: I.window_average(s.select("site_id", "chrom", "start"), t, "chrom", "start", 10_000, 100_000, "tor", "site_id"), "sites", "tor"),
    "g01_bait_map": _over(lambda c: MA.bait_map(c, 4, 20_000_000, 5_000_000, 5_000_000, 500_000), "contacts"),
    "g02_insulation": _over(lambda c: MA.insulation(c, 2_000_000, 500_000), "contacts"),
    "g04_insulated_runs": _over(lambda c: I.screen(MA.insulation(c, 2_000_000, 500_000), F.col("insulation").isNull() | (F.col("insulation") > -2.5), 500_000), "contacts"),
    "g05_borders": _over(lambda c: I.screen(MA.insulation(c, 2_000_000, 500_000), F.col("insulation") < -2.5, 500_000), "contacts"),
    "g06_asymmetry": _over(lambda c: MA.asymmetry(c, 1_000_000, 500_000, 50_000), "contacts"),
    "g07_direction": _over(lambda c: MA.direction(c, 2_000_000, 500_000), "contacts"),
    "g09_triangles": _over(lambda c, f: MA.triangles(c, f.select("chrom", F.col("start").alias("at")), 300_000, 1000), "contacts", "frags"),
    "g13_border_points": _over(lambda c: MA.insulation(c, 2_000_000, 500_000).where("insulation is not null").groupBy("chrom").agg(F.min(F.struct("insulation", "start")).alias("m")).select("chrom", F.col("m.start").alias("start"), F.col("m.insulation").alias("insulation")), "contacts"),
    "g22_pile_up": _over(lambda c, s: L.pile_up(c, s, BAND, REACH, 21), "contacts", "sites"),
    "g25_loop_enrichment": _over(lambda c, s: L.enrichment(L.counts(c, s, BAND, 50_000, REACH), 50_000, REACH).select("site1", "site2", "n1", "n2", "enr"), "contacts", "sites"),
    "f56_loop_counts": _over(lambda c, s: L.quadrants(c, s, BAND, REACH, ["cell_id"]), "contacts", "sites"),
    "l06_genome_map": _over(lambda c: MA.binned_map(c, 8_000_000), "contacts"),
    "h01_cyclic_mean": _over(lambda c: W.cyclic_roll(_ordered(c), "ord", "trans", 11).select("ord", "rolled"), "contacts"),
    "h01_cyclic_sd": _over(lambda c: W.cyclic_roll(_ordered(c), "ord", "trans", 11, "sd").select("ord", "rolled"), "contacts"),
    "h03_cyclic_sum": _over(lambda c: W.cyclic_roll(_ordered(c), "ord", "trans", 11, "sum").select("ord", "rolled"), "contacts"),
    "h04_block_sums": _over(lambda c: W.block_sums(_ordered(c), "ord", "trans", 10), "contacts"),
    "h05_rolling_mean": _over(lambda c: W.rolling_mean(_ordered(c), "ord", "trans", 11).select("ord", "rolled"), "contacts"),
    "h06_chrom_offsets": _over(lambda f: W.offsets(f.groupBy("chrom").agg(F.max("end_").alias("len")), "chrom", "len"), "frags"),
    "h07_run_lengths": _over(lambda m: W.runs(m.withColumn("b", F.col("batch_id") % 2), "cell_id", "b"), "cells"),
    "h08_ranks": _over(lambda c: _ordered(c).select("cell_id", "ord"), "contacts"),
    "h10_widest_gap": _over(lambda c: W.widest_gap(_ordered(c).withColumn("cis", F.col("n") - 4 * F.col("trans")).withColumn("zero", F.lit(0)), "ord", "zero", "cis"), "contacts"),
    "h14_equal_ranges": _over(lambda c: _ordered(c).select("ord", W.equal_ranges(F.col("ord"), F.lit(64), 7).alias("part")), "contacts"),
    "h15_fixed_groups": _over(lambda c: _ordered(c).select("ord", W.fixed_groups(F.col("ord"), F.lit(64), 10).alias("pc")), "contacts"),
    "i05_top_cells": _over(lambda c: _ordered(c).orderBy(F.desc("trans"), "cell_id").limit(8).select("cell_id", "trans"), "contacts"),
    "i09_first_minimum": _over(lambda c, f: I.containing(c, f, "chrom1", "start1", "fid", "fid").groupBy("fid").agg(F.min(F.struct("cnt", "start1", "cell_id")).alias("m")).select("fid", F.col("m.cnt").alias("cnt"), F.col("m.start1").alias("start1")), "contacts", "frags"),
    "i10_middle_slice": _over(lambda c: _ordered(c).where(F.col("ord").between(17, 48)).select("cell_id", "n"), "contacts"),
    "j04_distinct": _over(lambda c: c.select("cell_id", "chrom1", "chrom2").distinct(), "contacts"),
    "j05_canonic": _over(lambda s: I.canonic(_wide(s)), "sites"),
    "j06_union": _over(lambda s, f: I.union(_wide(s), f), "sites", "frags"),
    "j07_intersection": _over(lambda s, f: I.intersect(_wide(s), f), "sites", "frags"),
    "j08_force_range": _over(lambda f: I.force_range(f.withColumns({"start": F.col("start") - 500_000, "end_": F.col("end_") + 500_000}), 50_000_000), "frags"),
    "o_bins": _over(lambda f: I.bins(f.select("chrom").distinct(), 25_000_000, CHROM_LEN), "frags"),
    "o_cis_decay": _over(lambda c, f: DO.in_domains(c.where("chrom1 = chrom2"), f).groupBy((F.col("fid1") == F.col("fid2")).alias("intra"), F.floor(F.log2((F.col("start2") - F.col("start1")).cast("double"))).cast("int").alias("octave")).agg(F.count("*").alias("n")), "contacts", "frags"),
}

_ORD = ", t AS (SELECT cell_id, count(*) AS n, count(*) FILTER (chrom1 <> chrom2) AS trans FROM contacts GROUP BY ALL), o AS (SELECT *, CAST(row_number() OVER (ORDER BY n, cell_id) AS INTEGER) AS ord FROM t)"
_CYC = _ORD + ", m AS (SELECT count(*) AS k FROM o), y AS (SELECT a.ord, b.trans FROM o a, o b, m WHERE least((a.ord - b.ord + 2 * k) % k, (b.ord - a.ord + 2 * k) % k) <= 5)"
_MARG = ", s AS (SELECT * FROM contacts UNION ALL SELECT cell_id, chrom2, start2, chrom1, start1, cnt FROM contacts), w AS (SELECT chrom1 AS chrom, start1 // 1000000 * 1000000 AS start, count(*) AS area FROM s GROUP BY ALL)"
_LOOPS = ", l AS (SELECT f.chrom, f.site_id AS site1, f.start AS start1, r.site_id AS site2, r.start AS start2 FROM sites f JOIN sites r ON f.chrom = r.chrom AND f.type = 'F' AND r.type = 'R' AND r.start - f.start BETWEEN 200000 AND 1000000)"
_NEAR = _LOOPS + ", nr AS (SELECT c.cell_id, l.*, c.start1 - l.start1 AS dx, c.start2 - l.start2 AS dy FROM contacts c JOIN l ON c.chrom1 = l.chrom AND c.chrom2 = l.chrom AND abs(c.start1 - l.start1) <= 200000 AND abs(c.start2 - l.start2) <= 200000)"
_QUAD = "count(*) FILTER (dx <= 0 AND dy >= 0) AS oo, count(*) FILTER (dx <= 0 AND dy <= 0) AS oi, count(*) FILTER (dx >= 0 AND dy >= 0) AS io, count(*) FILTER (dx >= 0 AND dy <= 0) AS ii, count(*) AS n"
_DOM = ", dm AS (SELECT *, CASE WHEN fid % 2 = 0 THEN 'A' ELSE 'B' END AS ab FROM frags)"
_IN = _DOM + ", ind AS (SELECT c.*, a.fid AS fid1, b.fid AS fid2, a.ab AS ab1, b.ab AS ab2, a.start AS f1, a.end_ AS t1, b.start AS f2, b.end_ AS t2 FROM contacts c JOIN dm a ON c.chrom1 = a.chrom AND c.start1 >= a.start AND c.start1 < a.end_ JOIN dm b ON c.chrom2 = b.chrom AND c.start2 >= b.start AND c.start2 < b.end_)"
_PT = _IN + ", pt AS (SELECT fid1, fid2, sum(cnt)::BIGINT AS n FROM (SELECT fid1, fid2, cnt FROM ind WHERE chrom1 <> chrom2 UNION ALL SELECT fid2, fid1, cnt FROM ind WHERE chrom1 <> chrom2) GROUP BY ALL)"
_SHARE = _PT + ", sh AS (SELECT fid1 AS fid, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (ab = 'A'), 0) / sum(n) AS p_a FROM pt JOIN dm ON dm.fid = fid2 GROUP BY ALL)"
_SCORE = _SHARE + ", sc AS (SELECT fid1 AS fid, sum(pt.n * p_a) / sum(pt.n) AS a_score FROM pt JOIN sh ON sh.fid = fid2 GROUP BY ALL)"
_CIS = ", kinds AS (SELECT *, least(ab1, ab2) || greatest(ab1, ab2) AS kind, chrom1 = chrom2 AS cis FROM ind WHERE chrom1 <> chrom2 OR greatest(f1, f2) - least(t1, t2) >= 2000000)"
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}' AND {'cis' if w == 'cis' else 'NOT cis'}) AS {w}_{k.lower()}" for w in ("cis", "trans") for k in ("AA", "AB", "BB"))
_INS = """, q AS (SELECT chrom1 AS chrom, start1, start2, cnt, unnest(range(greatest(CAST(ceil((start2 - 2000000) / 500000) AS BIGINT), 0), CAST(floor((start1 + 2000000) / 500000) AS BIGINT) + 1)) * 500000 AS start FROM contacts WHERE chrom1 = chrom2 AND start2 - start1 >= 1000 AND start2 - start1 < 4000000),
i0 AS (SELECT chrom, start, coalesce(sum(cnt) FILTER (start1 >= start - 2000000 AND start2 < start + 2000000), 0)::BIGINT AS big, coalesce(sum(cnt) FILTER (start1 >= start - 2000000 AND start2 < start + 2000000 AND start1 < start AND start2 >= start), 0)::BIGINT AS ins FROM q GROUP BY ALL),
ins AS (SELECT *, CASE WHEN ins > 0 THEN log2(ins / (big + 10)) END AS insulation FROM i0 WHERE big > 0)"""
_WIDE = f", wd AS (SELECT chrom, greatest(start - 50000, 0) AS start, least(end_ + 50000, {CHROM_LEN}) AS end_ FROM sites)"


def _merge(src, gap=0, name="cn"):
    return f", {name}0 AS (SELECT *, CASE WHEN start <= max(end_) OVER (PARTITION BY chrom ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM {src}), {name}1 AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS g FROM {name}0), {name} AS (SELECT chrom, min(start) AS start, max(end_) AS end_, count(*) AS n FROM {name}1 GROUP BY chrom, g)"


def _runs(src, predicate, size):
    return f", rn0 AS (SELECT *, start - {size} * row_number() OVER (PARTITION BY chrom ORDER BY start) AS g FROM {src} WHERE {predicate}), rn AS (SELECT chrom, min(start) AS start, max(start) + {size} AS end_, count(*) AS n FROM rn0 GROUP BY chrom, g)"


_S = duckdb_sql
SQL = {
    "a30_named_set": _S(" SELECT site_id, chrom, start, end_ FROM sites WHERE type = 'F'", "sites"),
    "c30_centers": _S(" SELECT fid, chrom, (start + end_) // 2 AS start, (start + end_) // 2 + 1 AS end_ FROM frags", "frags"),
    "c32_expanded": _S(f" SELECT site_id, chrom, greatest(start - 100, 0) AS start, least(end_ + 100, {CHROM_LEN}) AS end_ FROM sites", "sites"),
    "c33_expanded_2d": _S(f" SELECT chrom1, greatest(start1 - 5000, 0) AS start1, least(start1 + 5001, {CHROM_LEN}) AS end1, chrom2, greatest(start2 - 9000, 0) AS start2, least(start2 + 9001, {CHROM_LEN}) AS end2 FROM contacts", "contacts"),
    "d09_screened_runs": _S(_MARG + _runs("w", "area >= 60", 1000000) + " SELECT * FROM rn", "contacts"),
    "d10_percentile_peaks": _S(_runs("tor", "v > (SELECT quantile_cont(v, 0.9) FROM tor)", 100000) + " SELECT * FROM rn", "tor"),
    "d11_well_covered": _S(_MARG + _runs("w", "area >= 50", 1000000) + " SELECT chrom, start, end_ FROM rn", "contacts"),
    "d12_domain_lengths": _S(" SELECT * FROM frags WHERE end_ - start BETWEEN 985000 AND 1015000", "frags"),
    "d13_without_gaps": _S(" SELECT * FROM frags f WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.chrom = f.chrom AND s.start < f.end_ AND f.start < s.end_)", "frags", "sites"),
    "d14_quadrants": _S(_NEAR + f" SELECT chrom, {_QUAD} FROM nr GROUP BY ALL", "contacts", "sites"),
    "d16_per_kb": _S(", s AS (SELECT chrom1 AS c, start1 AS p FROM contacts UNION ALL SELECT chrom2, start2 FROM contacts), k AS (SELECT fid, count(*) AS n, count(*) / ((any_value(end_) - any_value(start)) / 1000) / 64 AS cov FROM s JOIN frags ON c = chrom AND p >= start AND p < end_ GROUP BY fid) SELECT * FROM k WHERE cov BETWEEN 0.0001 AND 0.01", "contacts", "frags"),
    "e01_nearest_fragment": _S(", p AS (SELECT DISTINCT chrom1, start1 FROM contacts), e AS (SELECT chrom, bin, max(struct_pack(fid := fid, side := side)) AS f FROM (SELECT fid, chrom, start // 10 AS bin, 5 AS side FROM frags WHERE end_ - start >= 15 UNION ALL SELECT fid, chrom, end_ // 10, 3 FROM frags WHERE end_ - start >= 15) GROUP BY ALL), r AS (SELECT chrom1, start1, f.fid AS fid, f.side AS side, bin - start1 // 10 AS off, row_number() OVER (PARTITION BY chrom1, start1 ORDER BY abs(bin - start1 // 10), bin DESC) AS k FROM p JOIN e ON chrom = chrom1 AND abs(bin - start1 // 10) < 5000) SELECT chrom1, start1, fid, side, off FROM r WHERE k = 1", "contacts", "frags"),
    "e04_fends_joined": _S(" SELECT a.chrom AS chr1, b.chrom AS chr2, count(*) AS n, sum(a.start)::BIGINT AS c1, sum(b.end_)::BIGINT AS c2 FROM contacts LEFT JOIN frags a ON a.fid = start1 % 1000 LEFT JOIN frags b ON b.fid = start2 % 1000 GROUP BY ALL", "contacts", "frags"),
    "e07_offsets_merged": _S(f" SELECT start1 + (chrom1 - 1) * {CHROM_LEN} AS x, start2 + (chrom2 - 1) * {CHROM_LEN} AS y, cnt FROM contacts", "contacts"),
    "e13_two_nearest": _S(", p AS (SELECT a.site_id, b.site_id AS site2, b.start AS s2, CASE WHEN b.start >= a.end_ THEN b.start - a.end_ + 1 WHEN b.end_ <= a.start THEN b.end_ - a.start - 1 ELSE 0 END AS dist FROM sites a JOIN sites b ON a.type = 'F' AND b.type = 'R' AND a.chrom = b.chrom), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY abs(dist), s2, site2) AS INT) AS rank FROM p WHERE abs(dist) <= 3000000) SELECT site_id, site2, dist, rank FROM r WHERE rank <= 2", "sites"),
    "e14_containing_domain": _S(" SELECT fid AS fid1, count(*) AS n, sum(cnt)::BIGINT AS cnt FROM contacts JOIN frags ON chrom = chrom1 AND start1 >= start AND start1 < end_ GROUP BY ALL", "contacts", "frags"),
    "e16_site_classes": _S(" SELECT fid, CASE WHEN count(DISTINCT type) = 2 THEN 'B' ELSE min(type) END AS kind FROM frags f JOIN sites s ON s.chrom = f.chrom AND s.start < f.end_ AND f.start < s.end_ GROUP BY fid", "frags", "sites"),
    "e17_band_join": _S(_LOOPS + " SELECT * FROM l", "sites"),
    "e18_lonely_loops": _S(_LOOPS + " SELECT * FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.chrom = a.chrom AND (b.site1, b.site2) <> (a.site1, a.site2) AND abs(a.start1 - b.start1) <= 200000 AND abs(a.start2 - b.start2) <= 200000)", "sites"),
    "e19_close_borders": _S(_merge("sites", 20000) + " SELECT * FROM cn", "sites"),
    "e20_overlap_score": _S(" SELECT fid, sum(v * (least(end_, t.start + 100000) - greatest(f.start, t.start))) / sum(least(end_, t.start + 100000) - greatest(f.start, t.start)) AS score FROM frags f JOIN tor t ON t.chrom = f.chrom AND t.start < end_ AND f.start < t.start + 100000 GROUP BY fid", "frags", "tor"),
    "e21_contingency": _S(" SELECT CASE WHEN fid % 3 = 0 THEN 'x' ELSE 'y' END AS g1, count(*) FILTER (v > 0) AS early, count(*) FILTER (NOT v > 0) AS late FROM frags f JOIN tor t ON t.chrom = f.chrom AND t.start = (f.start + end_) // 2 // 100000 * 100000 GROUP BY ALL", "frags", "tor"),
    "e22_same_domain": _S(_IN + " SELECT fid1, count(*) AS n FROM ind WHERE chrom1 = chrom2 AND fid1 = fid2 GROUP BY ALL", "contacts", "frags"),
    "e25_good_cells": _S(" SELECT cell_id, count(*) AS n FROM contacts WHERE cell_id IN (SELECT cell_id FROM cells WHERE valid = 1) GROUP BY ALL UNION ALL SELECT cell_id, -count(*) FROM contacts WHERE cell_id NOT IN (SELECT cell_id FROM cells) GROUP BY ALL", "contacts", "cells"),
    "f38_compartment_contacts": _S(_IN + _CIS + f" SELECT cell_id, {_COUNTS}, count(*) AS total FROM kinds GROUP BY ALL", "contacts", "frags"),
    "c40_compartment_enrichments": _S(_IN + _CIS + f", k AS (SELECT cell_id % 4 AS cell_id, {_COUNTS} FROM kinds GROUP BY ALL), x AS (SELECT *, cis_aa + cis_ab + cis_bb AS n, (2.0 * cis_aa + cis_ab) / (2.0 * (cis_aa + cis_ab + cis_bb)) AS a FROM k) SELECT cell_id, log2(cis_aa / (a * a * n)) AS en_aa, -log2(cis_ab / (2 * a * (1 - a) * n)) AS depl_ab, log2(cis_bb / ((1 - a) * (1 - a) * n)) AS en_bb FROM x", "contacts", "frags"),
    "f53_domain_coverage": _S(", s AS (SELECT cell_id, chrom1 AS c, start1 AS p FROM contacts WHERE chrom1 <> chrom2 OR start2 - start1 >= 23170 UNION ALL SELECT cell_id, chrom2, start2 FROM contacts WHERE chrom1 <> chrom2 OR start2 - start1 >= 23170) SELECT cell_id, fid, count(*) AS n FROM s JOIN frags ON c = chrom AND p >= start AND p < end_ GROUP BY ALL", "contacts", "frags"),
    "f54_domain_count_sums": _S(", s AS (SELECT chrom1 AS c, start1 AS p, cnt FROM contacts WHERE chrom1 <> chrom2 OR start2 >= start1 UNION ALL SELECT chrom2, start2, cnt FROM contacts WHERE chrom1 <> chrom2 OR start2 >= start1) SELECT fid, sum(cnt)::BIGINT AS n FROM s JOIN frags ON c = chrom AND p >= start AND p < end_ GROUP BY ALL", "contacts", "frags"),
    "f59_a_share": _S(_SHARE + " SELECT * FROM sh", "contacts", "frags"),
    "f61_a_score": _S(_SCORE + " SELECT * FROM sc", "contacts", "frags"),
    "f62_cell_scores": _S(_SCORE + ", b AS (SELECT cell_id % 4 AS cell_id, fid1, fid2 FROM ind WHERE chrom1 <> chrom2 OR abs(start2 - start1) >= 2000000 UNION ALL SELECT cell_id % 4, fid2, fid1 FROM ind WHERE chrom1 <> chrom2 OR abs(start2 - start1) >= 2000000), g AS (SELECT cell_id, fid1 AS fid, count(*) AS n, count(DISTINCT fid2) AS partners, avg(a_score) AS mean, var_samp(a_score) AS var FROM b JOIN sc ON sc.fid = fid2 GROUP BY ALL) SELECT * FROM g WHERE n >= 2 AND partners >= 2", "contacts", "frags"),
    "f64_grid_totals": _S(_PT + ", g AS (SELECT fid1 % 10 AS pc1, fid2 % 10 AS pc2, sum(n)::BIGINT AS n FROM pt GROUP BY ALL) SELECT *, log2(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY pc1) * sum(n) OVER (PARTITION BY pc2))) AS enrichment FROM g", "contacts", "frags"),
    "f74_quantiles": _S(" SELECT quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.9) AS q90 FROM tor", "tor"),
    "f75_percentile_max": _S(" SELECT fid, max(v) AS most, avg((v >= (SELECT quantile_cont(v, 0.95) FROM tor))::INT) AS share FROM tor t JOIN frags f ON t.chrom = f.chrom AND t.start >= f.start AND t.start < end_ GROUP BY fid", "frags", "tor"),
    "f81_window_average": _S(" SELECT site_id, avg(v) AS tor FROM sites s JOIN tor t ON t.chrom = s.chrom AND t.start // 100000 BETWEEN greatest(s.start - 10000, 0) // 100000 AND (s.start + 10000) // 100000 GROUP BY site_id", "sites", "tor"),
    "g01_bait_map": _S(" SELECT CAST(floor((start1 - 20000000) / 500000) AS BIGINT) AS x, CAST(floor((start2 - 20000000) / 500000) AS BIGINT) AS y, sum(cnt)::BIGINT AS n FROM contacts WHERE chrom1 = 4 AND chrom2 = 4 AND start1 >= 15000000 AND start1 < 25000000 AND start2 >= 15000000 AND start2 < 25000000 GROUP BY ALL", "contacts"),
    "g02_insulation": _S(_INS + " SELECT * FROM ins", "contacts"),
    "g04_insulated_runs": _S(_INS + _runs("ins", "insulation IS NULL OR insulation > -2.5", 500000) + " SELECT * FROM rn", "contacts"),
    "g05_borders": _S(_INS + _runs("ins", "insulation < -2.5", 500000) + " SELECT * FROM rn", "contacts"),
    "g06_asymmetry": _S(", e AS (SELECT chrom1 AS chrom, start1 AS p, 1 AS r, cnt FROM contacts WHERE chrom1 = chrom2 AND start2 - start1 < 1000000 UNION ALL SELECT chrom1, start2, 0, cnt FROM contacts WHERE chrom1 = chrom2 AND start2 - start1 < 1000000), k AS (SELECT *, CAST(round(p / 500000) AS BIGINT) * 500000 AS start FROM e), g AS (SELECT chrom, start, coalesce(sum(cnt) FILTER (r = 0), 0)::BIGINT AS \"left\", coalesce(sum(cnt) FILTER (r = 1), 0)::BIGINT AS \"right\" FROM k WHERE abs(p - start) <= 50000 GROUP BY ALL) SELECT *, log2((\"left\" + 1) / (\"right\" + 1)) AS asym FROM g", "contacts"),
    "g07_direction": _S(", e AS (SELECT chrom1 AS chrom, start1 AS p, 1 AS r, cnt FROM contacts WHERE chrom1 = chrom2 AND start2 - start1 >= 1000 AND start2 - start1 < 2000000 UNION ALL SELECT chrom1, start2, 0, cnt FROM contacts WHERE chrom1 = chrom2 AND start2 - start1 >= 1000 AND start2 - start1 < 2000000), g AS (SELECT chrom, p // 500000 * 500000 AS start, coalesce(sum(cnt) FILTER (r = 0), 0)::BIGINT AS up, coalesce(sum(cnt) FILTER (r = 1), 0)::BIGINT AS down FROM e GROUP BY ALL) SELECT *, CASE WHEN up = down THEN 0.0 ELSE sign(down - up) * (pow(up - (up + down) / 2, 2) + pow(down - (up + down) / 2, 2)) / ((up + down) / 2) END AS di FROM g", "contacts"),
    "g09_triangles": _S(", t AS (SELECT cell_id, f.chrom, f.start AS at, count(*) FILTER (start1 >= f.start - 300000 AND start2 < f.start + 300000 AND start1 < f.start AND start2 >= f.start) AS a, count(*) FILTER (start1 >= f.start - 300000 AND start2 < f.start) AS b1, count(*) FILTER (start2 < f.start + 300000 AND start1 >= f.start) AS b2 FROM contacts c JOIN frags f ON chrom1 = f.chrom AND chrom2 = f.chrom AND start2 - start1 >= 1000 AND start2 - start1 < 600000 AND start1 < f.start + 300000 AND start2 >= f.start - 300000 GROUP BY ALL) SELECT * FROM t WHERE a + b1 + b2 > 0", "contacts", "frags"),
    "g13_border_points": _S(_INS + ", r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY insulation, start) AS k FROM ins WHERE insulation IS NOT NULL) SELECT chrom, start, insulation FROM r WHERE k = 1", "contacts"),
    "g22_pile_up": _S(_NEAR + ", g AS (SELECT CAST(least((dx + 200000) * 21 // 400001, 20) AS INT) AS x, CAST(least((dy + 200000) * 21 // 400001, 20) AS INT) AS y, count(*) AS n FROM nr GROUP BY ALL) SELECT x, y, n, log2(n / ((SELECT sum(n) FROM g) / 441)) AS enr FROM g", "contacts", "sites"),
    "g25_loop_enrichment": _S(_NEAR + ", g AS (SELECT site1, site2, count(*) FILTER (abs(dx) <= 50000 AND abs(dy) <= 50000) AS n1, count(*) AS n2 FROM nr GROUP BY ALL) SELECT *, CASE WHEN n1 > 0 THEN greatest(log2(n1 / n2 / 0.0625), -1.0) ELSE -1.0 END AS enr FROM g", "contacts", "sites"),
    "f56_loop_counts": _S(_NEAR + f" SELECT cell_id, {_QUAD} FROM nr GROUP BY ALL", "contacts", "sites"),
    "l06_genome_map": _S(" SELECT chrom1, start1 // 8000000 AS bin1, chrom2, start2 // 8000000 AS bin2, sum(cnt)::BIGINT AS n, log2(sum(cnt) + 1) AS shade FROM contacts GROUP BY ALL", "contacts"),
    "h01_cyclic_mean": _S(_CYC + " SELECT ord, avg(trans) AS rolled FROM y GROUP BY ALL", "contacts"),
    "h01_cyclic_sd": _S(_CYC + " SELECT ord, stddev_samp(trans) AS rolled FROM y GROUP BY ALL", "contacts"),
    "h03_cyclic_sum": _S(_CYC + " SELECT ord, sum(trans)::BIGINT AS rolled FROM y GROUP BY ALL", "contacts"),
    "h04_block_sums": _S(_ORD + " SELECT CAST((ord - 1) // 10 AS BIGINT) AS block, sum(trans)::BIGINT AS total FROM o GROUP BY ALL HAVING count(*) = 10", "contacts"),
    "h05_rolling_mean": _S(_ORD + " SELECT ord, avg(trans) OVER (ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS rolled FROM o", "contacts"),
    "h06_chrom_offsets": _S(", m AS (SELECT chrom, max(end_) AS len FROM frags GROUP BY ALL) SELECT chrom, len, (sum(len) OVER (ORDER BY chrom) - len)::BIGINT AS \"offset\" FROM m", "frags"),
    "h07_run_lengths": _S(", x AS (SELECT cell_id, batch_id % 2 AS b, CASE WHEN lag(batch_id % 2) OVER (ORDER BY cell_id) = batch_id % 2 THEN 0 ELSE 1 END AS f FROM cells), y AS (SELECT *, (sum(f) OVER (ORDER BY cell_id))::BIGINT AS run FROM x) SELECT run, b, min(cell_id) AS \"first\", count(*) AS length, max(cell_id) AS \"last\" FROM y GROUP BY run, b", "cells"),
    "h08_ranks": _S(_ORD + " SELECT cell_id, ord FROM o", "contacts"),
    "h10_widest_gap": _S(_ORD + ", g AS (SELECT ord, (sum(n - 4 * trans) OVER (ORDER BY ord))::BIGINT AS gap FROM o) SELECT ord, gap FROM g ORDER BY gap DESC, ord LIMIT 1", "contacts"),
    "h14_equal_ranges": _S(_ORD + " SELECT ord, least(greatest(CAST(ceil((ord - 1) * 7 / 63) AS INT), 1), 7) AS part FROM o", "contacts"),
    "h15_fixed_groups": _S(_ORD + " SELECT ord, CAST(10 - (ord - 1) // 7 AS INT) AS pc FROM o", "contacts"),
    "i05_top_cells": _S(_ORD + " SELECT cell_id, trans FROM o ORDER BY trans DESC, cell_id LIMIT 8", "contacts"),
    "i09_first_minimum": _S(", r AS (SELECT fid, cnt, start1, row_number() OVER (PARTITION BY fid ORDER BY cnt, start1, cell_id) AS k FROM contacts JOIN frags ON chrom = chrom1 AND start1 >= start AND start1 < end_) SELECT fid, cnt, start1 FROM r WHERE k = 1", "contacts", "frags"),
    "i10_middle_slice": _S(_ORD + " SELECT cell_id, n FROM o WHERE ord BETWEEN 17 AND 48", "contacts"),
    "j04_distinct": _S(" SELECT DISTINCT cell_id, chrom1, chrom2 FROM contacts", "contacts"),
    "j05_canonic": _S(_WIDE + _merge("wd") + " SELECT * FROM cn", "sites"),
    "j06_union": _S(_WIDE + ", u AS (SELECT * FROM wd UNION ALL SELECT chrom, start, end_ FROM frags)" + _merge("u") + " SELECT * FROM cn", "sites", "frags"),
    "j07_intersection": _S(_WIDE + " SELECT a.chrom, greatest(a.start, b.start) AS start, least(a.end_, b.end_) AS end_ FROM wd a JOIN frags b ON a.chrom = b.chrom AND a.start < b.end_ AND b.start < a.end_", "sites", "frags"),
    "j08_force_range": _S(" SELECT * FROM (SELECT fid, chrom, greatest(start - 500000, 0) AS start, least(end_ + 500000, 50000000) AS end_ FROM frags) WHERE start < end_", "frags"),
    "o_bins": _S(f" SELECT chrom, s AS start, least(s + 25000000, {CHROM_LEN}) AS end_ FROM (SELECT DISTINCT chrom FROM frags), (SELECT unnest(range(0, {CHROM_LEN}, 25000000)) AS s)", "frags"),
    "o_cis_decay": _S(_IN + " SELECT fid1 = fid2 AS intra, CAST(floor(log2(start2 - start1)) AS INT) AS octave, count(*) AS n FROM ind WHERE chrom1 = chrom2 GROUP BY ALL", "contacts", "frags"),
}
from strandmap.plans.contact_queries import _BIN as _B  # noqa: E402

SQL["f55_decay_within"] = _S(_IN + ", ds AS (SELECT f.fid, CASE WHEN end_ - f.start >= 1020000 THEN 3 WHEN end_ - f.start >= 1000000 THEN 2 WHEN end_ - f.start >= 980000 THEN 1 ELSE 0 END AS size, CAST(floor(greatest(least(v, 2 - 1e-4), -2.0)) AS INT) + 3 AS tor FROM frags f JOIN tor t ON t.chrom = f.chrom AND t.start = (f.start + end_) // 2 // 100000 * 100000), x AS (SELECT size, tor, start2 - start1 AS d FROM ind JOIN ds ON ds.fid = fid1 WHERE chrom1 = chrom2 AND fid1 = fid2) SELECT size, tor, " + _B + " AS bin, count(*) AS n FROM x GROUP BY ALL", "contacts", "frags", "tor")
