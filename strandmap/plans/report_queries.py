"""Queries by group of cells and slice of an order, and the data behind the reports; groups of cells are their conditions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandmap.functions import distance as D
from strandmap.functions import sequence as S
from strandmap.operators import annotation as A
from strandmap.operators import contacts as C
from strandmap.operators import domains as DO
from strandmap.operators import loops as L
from strandmap.operators import maps as MA
from strandmap.operators import reports as R
from strandmap.plans.fixtures import duckdb_sql, view

BANDS = {"very_near": (1000, 25_000), "near": (25_000, 2_000_000), "mid": (2_000_000, 4_000_000), "far": (4_000_000, 12_000_000), "rest": (12_000_000, 200_000_000)}


def _over(f, *views):
    return lambda spark, sf: f(*(view(spark, sf, v) for v in views))


def _groups(cells):
    return cells.select("cell_id", F.col("cond").alias("grp"))


def _by_coverage(contacts):
    """Cells in order of coverage."""
    rows = contacts.groupBy("cell_id").agg(F.count("*").alias("n"), F.count_if(~D.is_cis()).alias("trans"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("n", "cell_id")))  # a row a cell


def _slices(contacts, size=10):
    return R.slices(_by_coverage(contacts), size)


def _loci(frags):
    return frags.select("chrom", F.col("start").alias("at"))


def _hits(sites, kind):
    return sites.where(F.col("type") == kind).select("chrom", "start")


#: How far apart the sites of a loop are, and how near its contacts.
BAND, REACH = (200_000, 1_000_000), 200_000


def _hit_places(contacts, sites):
    return R.hit_distances(contacts.select("chrom1", "start1", "chrom2", "start2"), _hits(sites, "F"), _hits(sites, "F"), 1_000_000)


def _domains(frags):
    return frags.select("fid", "chrom", "start", "end_", F.when(F.col("fid") % 2 == 0, "A").otherwise("B").alias("ab"))


def _tagged_loops(contacts, sites):
    """Counts around the nearest loop by the residues of its sites, standing for their classes."""
    one = L.nearest(contacts, sites, BAND, REACH, []).withColumns({"type1": F.col("site1") % 4, "type2": F.col("site2") % 4})
    return L.shares(one, ["type1", "type2"])


def _scored(contacts, frags):
    scores = DO.a_score(DO.pair_totals(contacts, frags), _domains(frags))
    return R.cut_by_difference(scores.join(_domains(frags).select("fid", "ab"), "fid").select("fid", "ab", F.round("a_score", 6).alias("v")))


def _typed_sides(contacts, sites):
    at = contacts.withColumns({f"mb{i}": F.floor(F.col(f"start{i}") / 1_000_000) for i in (1, 2)})
    kinds = sites.groupBy("chrom", F.floor(F.col("start") / 1_000_000).alias("mb")).agg(F.min("type").alias("type"))
    for i in (1, 2):
        at = at.join(kinds.select(F.col("chrom").alias(f"chrom{i}"), F.col("mb").alias(f"mb{i}"), F.col("type").alias(f"type{i}")), [f"chrom{i}", f"mb{i}"])
    return at.groupBy("type1", "type2").agg(F.count("*").alias("n"))


def _loops_with_tor(sites, tor):
    pairs = MA.loops(sites, 200_000, 1_000_000)
    for i in (1, 2):
        at = tor.select("chrom", F.floor(F.col("start") / 100_000).alias(f"_b{i}"), F.col("v").alias(f"tor{i}"))
        pairs = pairs.withColumn(f"_b{i}", F.floor(F.col(f"start{i}") / 100_000)).join(at, ["chrom", f"_b{i}"])
    return pairs.select("site1", "site2", "tor1", "tor2")


def _permitted(contacts, sites):
    """Megabase squares with contacts that hold the sides of a loop."""
    loops = MA.loops(sites, 200_000, 1_000_000).select("chrom", *(F.floor(F.col(f"start{i}") / 1_000_000).alias(f"bin{i}") for i in (1, 2)))
    found = contacts.where(D.is_cis()).groupBy(F.col("chrom1").alias("chrom"), *(F.floor(F.col(f"start{i}") / 1_000_000).alias(f"bin{i}") for i in (1, 2))).agg(F.count("*").alias("n"))
    return found.join(loops, ["chrom", "bin1", "bin2"], "left_semi")


def _cis_trans(contacts, frags):
    """a_score of every domain from its contacts within and between chromosomes, joined on what both tables share."""
    within = DO.a_score(DO.pair_totals(contacts, frags, trans=False), _domains(frags)).withColumnRenamed("a_score", "cis_score")
    return within.join(DO.a_score(DO.pair_totals(contacts, frags), _domains(frags)), "fid")


def _barcodes(seqs):
    code = seqs.select(F.explode(S.reads(F.col("q"), 40)).alias("r")).select(F.substring("r", 1, 4).alias("code"))
    counts = code.where("length(code) = 4").groupBy("code").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "code")))  # 256 rows at most


def _ends_of_order(contacts, k=5):
    rows = _by_coverage(contacts)
    last = F.max("ord").over(Window.partitionBy(F.lit(1)))  # a row a cell
    return rows.withColumn("from_end", last - F.col("ord") + 1).where((F.col("ord") <= k) | (F.col("from_end") <= k)).select("cell_id", "n", (F.col("ord") <= k).alias("head"))


def _spread(contacts):
    rows = R.karyotype(contacts).groupBy("chrom").agg(F.round(F.stddev_samp("share"), 12).alias("sd"))
    return rows.orderBy(F.desc("sd"), "chrom").limit(10)


def _spliced(seqs):
    rows = seqs.select(F.explode(S.reads(F.col("q"), 40)).alias("seq")).withColumn("qual", F.translate("seq", "ACGT", "IJKL"))
    return R.spliced(rows, ["..", "[AC]+", "G", ".*"], [3, 0]).groupBy("seq", "qual").agg(F.count("*").alias("n"))


def _orders(contacts):
    d = C.with_distance(contacts).groupBy("cell_id").agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("trans"), F.max("d").alias("most"))
    return R.ordered_by(d, {"by_n": F.col("n"), "by_trans": -F.col("trans"), "by_share": F.round(F.col("trans") / F.col("n"), 9), "by_most": F.col("most")})


def _in_all(contacts):
    """Megabases that cells 1, 2 and 3 all touch within chromosomes."""
    of = lambda k: contacts.where((F.col("cell_id") == k) & D.is_cis()).select(F.col("chrom1").alias("chrom"), F.floor(F.col("start1") / 1_000_000).alias("mb"))
    return of(1).intersect(of(2)).intersect(of(3))


QUERIES = {
    "g11_group_borders": _over(lambda c, m: R.group_borders(c, _groups(m), 2_000_000, 500_000, -2.5, 1, 1_000_000), "contacts", "cells"),
    "l41_group_insulation": _over(lambda c, m: MA.insulation(c.join(_groups(m), "cell_id"), 2_000_000, 500_000, by=("grp",)), "contacts", "cells"),
    "g20_slice_insulation": _over(lambda c, f: R.slice_insulation(MA.triangles(c, _loci(f), 300_000, 1000), _slices(c), 0.001), "contacts", "frags"),
    "g10_sampled_triangles": _over(lambda c, f: R.sampled_triangles(c, _loci(f), 1_000_000, 1000, 3, "s"), "contacts", "frags"),
    "g12_pool_domains": _over(lambda c, t: R.pool_domains(c, 2_000_000, 500_000, 0.25, t, 100_000, 1_000_000, 20_000_000), "contacts", "tor"),
    "e24_hit_distances": _over(lambda c, s: R.hit_distances(c.drop("cnt"), _hits(s, "F"), _hits(s, "R"), 500_000).select("cell_id", "chrom1", "start1", "chrom2", "start2", "x", "y"), "contacts", "sites"),
    "f49_hotspots": _over(lambda c, s: R.hotspots(_hit_places(c, s), 250_000, 1, 0.5), "contacts", "sites"),
    "f49_hotspots_plain": _over(lambda c, s: R.hotspots(_hit_places(c, s), 250_000, 1, 0.5, smooth=False), "contacts", "sites"),
    "g23_group_pile_up": _over(lambda c, s, m: L.pile_up(c.join(_groups(m), "cell_id"), s, BAND, REACH, 5, ("grp",)), "contacts", "sites", "cells"),
    "g24_replicated_loops": _over(lambda c, s, t: R.replicated_loops(L.counts(c, s, BAND, 50_000, REACH), t, 100_000, 50_000, REACH, 0.8), "contacts", "sites", "tor"),
    "f57_inner_contacts": _over(_tagged_loops, "contacts", "sites"),
    "g27_cut_domains": _over(_scored, "contacts", "frags"),
    "k21_class_expectation": _over(lambda c, f: R.class_expectation(c, _domains(f)), "contacts", "frags"),
    "k08_density": _over(lambda c: R.density_2d(c.where("chrom1 = chrom2"), "start1", "start2", 5_000_000.0, 1.5, 3), "contacts"),
    "l01_karyotype": _over(R.karyotype, "contacts"),
    "l01_quality_series": _over(lambda c: R.quality_series(c, (1000, 2_000_000), 4_000_000), "contacts"),
    "l02_early_coverage": _over(lambda c, t: R.early_coverage(c, t, 100_000, 0.0), "contacts", "tor"),
    "l03_duplicates": _over(R.duplicate_report, "contacts"),
    "l08_mean_profiles": _over(lambda c, m: R.mean_profiles(C.fine_decay(c).select("cell_id", "bin", "n"), _groups(m)), "contacts", "cells"),
    "l26_slice_maps": _over(lambda c: c.where(D.is_cis()).join(_slices(c), "cell_id").groupBy("grp", "chrom1", *(F.floor(F.col(f"start{i}") / 10_000_000).alias(f"bin{i}") for i in (1, 2))).agg(F.sum("cnt").alias("n")), "contacts"),
    "l39_mean_distance": _over(lambda c, f, t: R.mean_distance(DO.decay_within(c, f, t, [990_000, 1_000_000, 1_010_000])), "contacts", "frags", "tor"),
    "l58_band_fractions": _over(lambda c: R.band_fractions(c, BANDS, "mid", 0.19), "contacts"),
    "l63_cis_trans_scores": _over(_cis_trans, "contacts", "frags"),
    "i01_ranked_barcodes": _over(_barcodes, "seqs"),
    "i04_orders": _over(_orders, "contacts"),
    "i06_ends_of_order": _over(_ends_of_order, "contacts"),
    "i07_most_spread": _over(_spread, "contacts"),
    "n01_spliced": _over(_spliced, "seqs"),
    "e08_typed_sides": _over(_typed_sides, "contacts", "sites"),
    "e09_loops_with_tor": _over(_loops_with_tor, "sites", "tor"),
    "e10_permitted_squares": _over(_permitted, "contacts", "sites"),
    "j02_unmapped_reads": _over(lambda h: h.select("read_id").distinct().join(h.where("qual >= 30").select("read_id"), "read_id", "left_anti"), "hits"),
    "j03_shared_bins": _over(_in_all, "contacts"),
    "f47_smoothed_map": _over(lambda c: R.smoothed_ratio(c, 5_000_000, [0, 1, 2], 10), "contacts"),
    "d15_even_cells": _over(lambda c: R.even_cells(c, 0.3).groupBy("cell_id").agg(F.count("*").alias("n")), "contacts"),
    "p40_cell_stats": _over(lambda c, m: R.cell_stats(c, m, BANDS, "mid", 0.19), "contacts", "cells"),
    "n10_expressions": _over(lambda s, t: A.window_values(s, t, "site_id", 100_000, -150_000, 150_000).select("site_id", F.expr("if(mean is not null and mean > 0, most, 0.0)").alias("value"), F.expr("n > 2 and least < 0").alias("mixed")), "sites", "tor"),
}

_S = duckdb_sql
_GR = ", gr AS (SELECT cell_id, cond AS grp FROM cells)"
_INS = (
    ", q AS (SELECT {k} chrom1 AS chrom, start1, start2, cnt, unnest(range(greatest(CAST(ceil((start2 - 2000000) / 500000) AS BIGINT), 0), CAST(floor((start1 + 2000000) / 500000) AS BIGINT) + 1)) * 500000 AS start"
    " FROM {src} WHERE chrom1 = chrom2 AND start2 - start1 >= 1000 AND start2 - start1 < 4000000)"
    ", i0 AS (SELECT {k} chrom, start, coalesce(sum(cnt) FILTER (start1 >= start - 2000000 AND start2 < start + 2000000), 0)::BIGINT AS big,"
    " coalesce(sum(cnt) FILTER (start1 >= start - 2000000 AND start2 < start + 2000000 AND start1 < start AND start2 >= start), 0)::BIGINT AS ins FROM q GROUP BY ALL)"
    ", ins AS (SELECT *, CASE WHEN ins > 0 THEN log2(ins / (big + 10)) END AS insulation FROM i0 WHERE big > 0)"
)
_BY_GROUP = _GR + _INS.format(k="grp,", src="(SELECT * FROM contacts JOIN gr USING (cell_id))")
_ISLANDS = (
    ", w AS (SELECT *, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {rows})"
    ", g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM w)"
)
_ORD = ", t AS (SELECT cell_id, count(*) AS n, count(*) FILTER (chrom1 <> chrom2) AS trans FROM contacts GROUP BY ALL), o AS (SELECT *, CAST(row_number() OVER (ORDER BY n, cell_id) AS INTEGER) AS ord FROM t), sl AS (SELECT cell_id, CAST((ord - 1) // 10 AS BIGINT) AS grp FROM o)"
_KIND = (
    ", tr AS (SELECT cell_id, f.chrom, f.start AS loc, start1, start2, CASE WHEN start1 >= f.start - {s} AND start2 < f.start + {s} AND start1 < f.start AND start2 >= f.start THEN 'a'"
    " WHEN start1 >= f.start - {s} AND start2 < f.start THEN 'b1' WHEN start2 < f.start + {s} AND start1 >= f.start THEN 'b2' END AS kind FROM contacts JOIN frags f ON chrom1 = f.chrom AND chrom2 = f.chrom"
    " AND start2 - start1 >= 1000 AND start1 >= f.start - {s} * 3 AND start1 < f.start + {s} * 3 WHERE kind IS NOT NULL)"
)
_ABB = "count(*) FILTER (kind = 'a') AS a, count(*) FILTER (kind = 'b1') AS b1, count(*) FILTER (kind = 'b2') AS b2"
_LOOPS = ", l AS (SELECT f.chrom, f.site_id AS site1, f.start AS start1, r.site_id AS site2, r.start AS start2 FROM sites f JOIN sites r ON f.chrom = r.chrom AND f.type = 'F' AND r.type = 'R' AND r.start - f.start BETWEEN 200000 AND 1000000)"
_NEAR = _LOOPS + ", nr AS (SELECT c.cell_id, l.*, c.start1 - l.start1 AS dx, c.start2 - l.start2 AS dy FROM contacts c JOIN l ON c.chrom1 = l.chrom AND c.chrom2 = l.chrom AND abs(c.start1 - l.start1) <= 200000 AND abs(c.start2 - l.start2) <= 200000)"
_QUAD = "count(*) FILTER (dx <= 0 AND dy >= 0) AS oo, count(*) FILTER (dx <= 0 AND dy <= 0) AS oi, count(*) FILTER (dx >= 0 AND dy >= 0) AS io, count(*) FILTER (dx >= 0 AND dy <= 0) AS ii, count(*) AS n"
_IN = (
    ", dm AS (SELECT *, CASE WHEN fid % 2 = 0 THEN 'A' ELSE 'B' END AS ab FROM frags)"
    ", ind AS (SELECT c.*, a.fid AS fid1, b.fid AS fid2, a.ab AS ab1, b.ab AS ab2, a.start AS f1, a.end_ AS t1, b.start AS f2, b.end_ AS t2 FROM contacts c"
    " JOIN dm a ON c.chrom1 = a.chrom AND c.start1 >= a.start AND c.start1 < a.end_ JOIN dm b ON c.chrom2 = b.chrom AND c.start2 >= b.start AND c.start2 < b.end_)"
)
_SCORE = (
    ", pt{n} AS (SELECT fid1, fid2, sum(cnt)::BIGINT AS n FROM (SELECT fid1, fid2, cnt FROM ind WHERE {w} UNION ALL SELECT fid2, fid1, cnt FROM ind WHERE {w}) GROUP BY ALL)"
    ", sh{n} AS (SELECT fid1 AS fid, coalesce(sum(n) FILTER (ab = 'A'), 0) / sum(n) AS p_a FROM pt{n} JOIN dm ON dm.fid = fid2 GROUP BY ALL)"
    ", sc{n} AS (SELECT fid1 AS fid, sum(pt{n}.n * p_a) / sum(pt{n}.n) AS a_score FROM pt{n} JOIN sh{n} ON sh{n}.fid = fid2 GROUP BY ALL)"
)
_TRANS = _SCORE.format(n="", w="chrom1 <> chrom2")
_HIT = (
    ", p{i} AS (SELECT DISTINCT chrom{i} AS chrom, start{i} AS loc FROM contacts)"
    ", h{i} AS (SELECT p.chrom, loc, arg_min(loc - start, (abs(loc - start), loc - start)) AS d FROM p{i} p JOIN sites s ON s.chrom = p.chrom AND s.type = '{t}' AND abs(loc - start) <= {r} GROUP BY ALL)"
)
_DIST = ", hd AS (SELECT contacts.*, h1.d AS x, h2.d AS y FROM contacts JOIN h1 ON h1.chrom = chrom1 AND h1.loc = start1 JOIN h2 ON h2.chrom = chrom2 AND h2.loc = start2)"
_HOT = (
    _HIT.format(i=1, t="F", r=1000000) + _HIT.format(i=2, t="F", r=1000000) + _DIST
    + ", ce AS (SELECT CAST(floor(x / 250000) AS BIGINT) AS i, CAST(floor(y / 250000) AS BIGINT) AS j, count(*) AS n, count(*) FILTER (abs(y) > 250000) AS fy, count(*) FILTER (abs(x) > 250000) AS fx FROM hd GROUP BY ALL)"
    ", mx AS (SELECT i, sum(fy) AS m FROM ce GROUP BY i HAVING sum(fy) > 0), my AS (SELECT j, sum(fx) AS m FROM ce GROUP BY j HAVING sum(fx) > 0)"
    ", ke AS (SELECT i, j, n, mx.m / (SELECT sum(fy) FROM ce) * my.m / (SELECT sum(fx) FROM ce) AS e FROM ce JOIN mx USING (i) JOIN my USING (j))"
    ", kp AS (SELECT * FROM ke WHERE e * (SELECT sum(n) FROM ce) >= 0.5)"
    ", ra AS (SELECT i, j, n, log2(n / (SELECT avg(n) FROM kp)) - log2(e * (SELECT count(*) FROM mx) * (SELECT count(*) FROM my)) AS ratio FROM kp)"
)
_KARYO = (
    ", s AS (SELECT cell_id, unnest([chrom1, chrom2]) AS chrom FROM contacts), k AS (SELECT cell_id, chrom, count(*) AS n FROM s GROUP BY ALL)"
    ", ks AS (SELECT *, n / sum(n) OVER (PARTITION BY cell_id) AS share FROM k)"
)
_EDGES = "[" + ", ".join(map(str, D.DECAY_EDGES)) + "]"
_BIN = f"CASE WHEN d > {D.DECAY_EDGES[-1]} THEN NULL ELSE len(list_filter({_EDGES}, lambda e: e < d)) END"
_TOR = "CAST(floor(greatest(least({v}, 2 - 0.0001), -2.0)) AS INT) + 3"
_MB = ", mb AS (SELECT chrom, start // 1000000 AS mb, min(type) AS type FROM sites GROUP BY ALL)"
_D = ", dd AS (SELECT *, CASE WHEN chrom1 = chrom2 THEN start2 - start1 END AS d FROM contacts)"
_BANDS = ", ".join(f"count(*) FILTER (d >= {lo} AND d < {hi}) / count(*) AS {k}" for k, (lo, hi) in BANDS.items())
_LOGS = ", ".join(f"CASE WHEN {k} > 0 THEN log2({k}) END AS log_{k}" for k in BANDS)
_QC = (
    ", a AS (SELECT cell_id, count(*) AS n, sum(cnt)::BIGINT AS reads, count(*) FILTER (d IS NULL) / count(*) AS f_trans, count(*) FILTER (d < 1000) / count(*) AS f_nodig, count(*) FILTER (d >= 4000000) AS x,"
    " count(*) FILTER (d >= 1000 AND d < 2000000) AS y, 1 - count(*) / sum(cnt) AS f_dup FROM dd GROUP BY ALL), qc AS (SELECT cell_id, n, reads, f_trans, f_nodig, CASE WHEN x > 0 AND y > 0 THEN log2(x / y) END AS far_close, f_dup FROM a)"
)
_EVEN = _KARYO + ", kn AS (SELECT *, log2(share / avg(share) OVER (PARTITION BY chrom)) AS enr FROM ks), ev AS (SELECT cell_id, max(abs(enr)) AS max_enr FROM kn GROUP BY cell_id)"

SQL = {
    "f47_smoothed_map": _S(
        ", s AS (SELECT chrom1 AS chrom, start1 // 5000000 AS i, start2 // 5000000 AS j FROM contacts WHERE chrom1 = chrom2), c AS (SELECT chrom, i, j, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT chrom, j, i FROM s) GROUP BY ALL)"
        ", m AS (SELECT chrom, i, sum(n) AS n FROM c GROUP BY ALL), o AS (SELECT unnest(range(-2, 3)) AS a), t AS (SELECT chrom, sum(n) AS total FROM m GROUP BY chrom)"
        ", p AS (SELECT chrom, i + o.a AS i, j + b.a AS j, greatest(abs(o.a), abs(b.a)) AS off, n FROM c, o, o b), w AS (SELECT unnest([0, 1, 2]) AS k)"
        ", ob AS (SELECT chrom, i, j, k, coalesce(sum(n) FILTER (off <= k), 0) AS n FROM p, w GROUP BY ALL), mw AS (SELECT chrom, i + a AS i, k, coalesce(sum(n) FILTER (abs(a) <= k), 0) AS n FROM m, o, w GROUP BY ALL)"
        ", pick AS (SELECT *, row_number() OVER (PARTITION BY chrom, i, j ORDER BY k) AS r FROM ob WHERE n >= 10 OR (k = 2 AND n >= 6))"
        " SELECT x.chrom, x.i, x.j, CAST(x.k AS INTEGER) AS window, CAST(x.n AS BIGINT) AS n, log2(x.n / (a.n * b.n / total)) AS ratio FROM pick x JOIN mw a ON a.chrom = x.chrom AND a.i = x.i AND a.k = x.k JOIN mw b ON b.chrom = x.chrom AND b.i = x.j AND b.k = x.k"
        " JOIN t ON t.chrom = x.chrom WHERE r = 1",
        "contacts",
    ),
    "d15_even_cells": _S(_EVEN + " SELECT cell_id, count(*) AS n FROM contacts JOIN ev USING (cell_id) WHERE max_enr <= 0.3 GROUP BY ALL", "contacts"),
    "p40_cell_stats": _S(
        _GR + _D + _QC + _EVEN + f", ci AS (SELECT cell_id, d FROM dd WHERE d IS NOT NULL), b AS (SELECT cell_id, {_BANDS} FROM ci GROUP BY ALL), bl AS (SELECT *, {_LOGS}, mid >= 0.19 AS mitotic_like FROM b)"
        ", p AS (SELECT cell_id, pow((n - 1) / n, reads) AS none, (reads / n) * pow((n - 1) / n, reads - 1) AS once FROM qc), ex AS (SELECT cell_id, CASE WHEN 1 - none <> 0 THEN (1 - none - once) / (1 - none) END AS expected FROM p)"
        " SELECT * FROM qc LEFT JOIN ex USING (cell_id) LEFT JOIN bl USING (cell_id) LEFT JOIN ev USING (cell_id) LEFT JOIN gr USING (cell_id)",
        "contacts", "cells",
    ),
    "g11_group_borders": _S(
        _BY_GROUP + ", rn0 AS (SELECT *, start - 500000 * row_number() OVER (PARTITION BY chrom, grp ORDER BY start) AS r FROM ins WHERE insulation < -2.5)"
        ", rn AS (SELECT chrom, grp, (min(start) + max(start) + 500000) // 2 AS start FROM rn0 GROUP BY chrom, grp, r), pt AS (SELECT DISTINCT chrom, start, start + 1 AS end_ FROM rn)"
        ", pr AS (SELECT a.chrom, a.start AS lo, b.start AS hi FROM pt a JOIN pt b ON a.chrom = b.chrom AND b.start - a.start BETWEEN 1 AND 1000000)"
        ", sp AS (SELECT * FROM pr UNION ALL SELECT chrom, start, end_ FROM pt WHERE (chrom, start) NOT IN (SELECT (chrom, lo) FROM pr))" + _ISLANDS.format(rows="sp")
        + ", u AS (SELECT chrom, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY chrom, island), b AS (SELECT chrom, (lo + hi) // 2 AS start FROM u WHERE hi - lo <= 1000000)"
        " SELECT b.chrom, b.start, n.grp, ins.insulation FROM b CROSS JOIN (SELECT DISTINCT grp FROM gr) n LEFT JOIN ins ON ins.chrom = b.chrom AND ins.grp = n.grp AND ins.start = b.start // 500000 * 500000",
        "contacts", "cells",
    ),
    "l41_group_insulation": _S(_BY_GROUP + " SELECT * FROM ins", "contacts", "cells"),
    "g20_slice_insulation": _S(
        _ORD + _KIND.format(s=300000) + f", c AS (SELECT chrom, loc, grp, {_ABB} FROM tr JOIN sl USING (cell_id) GROUP BY ALL)"
        ", v AS (SELECT *, log2((a + 0.001) / (a + b1 + b2 + 0.001)) AS ins FROM c) SELECT chrom, loc AS \"at\", grp, a, b1, b2, ins, ins - avg(ins) OVER (PARTITION BY chrom, loc) AS centred FROM v",
        "contacts", "frags",
    ),
    "g10_sampled_triangles": _S(
        _KIND.format(s=1000000) + ", r AS (SELECT *, row_number() OVER (PARTITION BY chrom, loc ORDER BY md5('s:' || cell_id || ':' || start1 || ':' || start2), cell_id, start1, start2) AS k, count(*) OVER (PARTITION BY chrom, loc) AS m FROM tr)"
        f' SELECT chrom, loc AS "at", {_ABB} FROM r WHERE m >= 3 AND k <= 3 GROUP BY ALL',
        "contacts", "frags",
    ),
    "g12_pool_domains": _S(
        _INS.format(k="", src="contacts") + ", rn0 AS (SELECT *, start - 500000 * row_number() OVER (PARTITION BY chrom ORDER BY start) AS r FROM ins WHERE insulation >= (SELECT quantile_cont(insulation, 0.25) FROM ins))"
        ", rn AS (SELECT chrom, min(start) AS start, max(start) + 500000 AS end_ FROM rn0 GROUP BY chrom, r)"
        " SELECT rn.chrom, rn.start, rn.end_, avg(v) AS tor FROM rn LEFT JOIN tor t ON t.chrom = rn.chrom AND t.start < rn.end_ AND t.start + 100000 > rn.start WHERE rn.end_ - rn.start BETWEEN 1000000 AND 20000000 GROUP BY ALL",
        "contacts", "tor",
    ),
    "e24_hit_distances": _S(_HIT.format(i=1, t="F", r=500000) + _HIT.format(i=2, t="R", r=500000) + _DIST + " SELECT cell_id, chrom1, start1, chrom2, start2, x, y FROM hd", "contacts", "sites"),
    "f49_hotspots": _S(_HOT + ", sp AS (SELECT i - a AS i, j - b AS j, ratio FROM ra, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(a, b)) SELECT i, j, avg(ratio) AS ratio FROM sp GROUP BY i, j HAVING count(*) = 4", "contacts", "sites"),
    "f49_hotspots_plain": _S(_HOT + " SELECT * FROM ra", "contacts", "sites"),
    "g23_group_pile_up": _S(
        _GR + _NEAR + ", p AS (SELECT grp, CAST(least((dx + 200000) * 5 // 400001, 4) AS INT) AS x, CAST(least((dy + 200000) * 5 // 400001, 4) AS INT) AS y, count(*) AS n FROM nr JOIN gr USING (cell_id) GROUP BY ALL)"
        " SELECT *, log2(n / (sum(n) OVER (PARTITION BY grp) / 25)) AS enr FROM p",
        "contacts", "sites", "cells",
    ),
    "g24_replicated_loops": _S(
        _NEAR + ", e AS (SELECT chrom, site1, start1, site2, start2, count(*) FILTER (abs(dx) <= 50000 AND abs(dy) <= 50000) AS n1, count(*) AS n2 FROM nr GROUP BY ALL)"
        ", f AS (SELECT *, CASE WHEN n1 > 0 THEN greatest(log2(n1 / n2 / 0.0625), -1.0) ELSE -1.0 END AS enr FROM e)"
        f" SELECT site1, site2, n1, n2, enr, coalesce({_TOR.format(v='a.v')}, 0) AS tor1, coalesce({_TOR.format(v='b.v')}, 0) AS tor2 FROM f LEFT JOIN tor a ON a.chrom = f.chrom AND a.start // 100000 = start1 // 100000"
        " LEFT JOIN tor b ON b.chrom = f.chrom AND b.start // 100000 = start2 // 100000 WHERE enr >= (SELECT quantile_cont(enr, 0.8) FROM f)",
        "contacts", "sites", "tor",
    ),
    "f57_inner_contacts": _S(
        _NEAR + ", k AS (SELECT *, rank() OVER (PARTITION BY cell_id, chrom, start1 + dx, start2 + dy ORDER BY abs(dx) + abs(dy), site1, site2) AS r FROM nr)"
        f" SELECT site1 % 4 AS type1, site2 % 4 AS type2, {_QUAD} FROM k WHERE r = 1 GROUP BY ALL",
        "contacts", "sites",
    ),
    "g27_cut_domains": _S(
        _IN + _TRANS + ", sv AS (SELECT fid, ab, round(a_score, 6) AS v FROM sc JOIN dm USING (fid)), d AS (SELECT v, count(*) FILTER (ab = 'A') AS na, count(*) FILTER (ab = 'B') AS nb FROM sv GROUP BY v)"
        ", c AS (SELECT v, round(abs(sum(na) OVER o / (SELECT sum(na) FROM d) - sum(nb) OVER o / (SELECT sum(nb) FROM d)), 9) AS gap FROM d WINDOW o AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"
        ", b AS (SELECT v AS cut FROM c ORDER BY gap DESC, v LIMIT 1) SELECT fid, ab, v, cut, CASE WHEN v > cut THEN 'A' ELSE 'B' END AS label FROM sv, b",
        "contacts", "frags",
    ),
    "k21_class_expectation": _S(
        _IN + ", p AS (SELECT chrom1 = chrom2 AS cis, ab1, ab2 FROM ind WHERE fid1 <> fid2), b AS (SELECT cis, ab1 AS class1, ab2 AS class2 FROM p UNION ALL SELECT cis, ab2, ab1 FROM p)"
        ", c AS (SELECT cis, class1, class2, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY cis, class1) * sum(n) OVER (PARTITION BY cis, class2) / sum(n) OVER (PARTITION BY cis) AS expected FROM c)"
        " SELECT *, log2(n / expected) AS enr FROM m",
        "contacts", "frags",
    ),
    "k08_density": _S(
        ", c AS (SELECT CAST(floor(start1 / 5000000) AS BIGINT) AS x, CAST(floor(start2 / 5000000) AS BIGINT) AS y, count(*) AS n FROM contacts WHERE chrom1 = chrom2 GROUP BY ALL)"
        ", s AS (SELECT x, y, n, a, b FROM c, (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b))"
        " SELECT x + a AS i, y + b AS j, sum(n * exp(-(a * a + b * b) / 4.5)) / ((SELECT sum(n) FROM c) * 2.0 * pi() * 2.25 * 5000000.0 * 5000000.0) AS density FROM s GROUP BY ALL",
        "contacts",
    ),
    "l01_karyotype": _S(_KARYO + " SELECT *, log2(share / avg(share) OVER (PARTITION BY chrom)) AS enr FROM ks", "contacts"),
    "l01_quality_series": _S(
        _D + ", a AS (SELECT cell_id, count(*) AS n, sum(cnt)::BIGINT AS reads, count(*) FILTER (d IS NULL) / count(*) AS f_trans, count(*) FILTER (d < 1000) / count(*) AS f_nodig, count(*) FILTER (d >= 4000000) AS x,"
        " count(*) FILTER (d >= 1000 AND d < 2000000) AS y, 1 - count(*) / sum(cnt) AS f_dup FROM dd GROUP BY ALL) SELECT cell_id, n, reads, f_trans, f_nodig, CASE WHEN x > 0 AND y > 0 THEN log2(x / y) END AS far_close, f_dup FROM a",
        "contacts",
    ),
    "l02_early_coverage": _S(
        ", s AS (SELECT cell_id, chrom1 AS chrom, start1 // 100000 AS bin FROM contacts UNION ALL SELECT cell_id, chrom2, start2 // 100000 FROM contacts)"
        ", e AS (SELECT cell_id, s.chrom, count(*) FILTER (v >= 0) / count(*) AS early FROM s JOIN tor t ON t.chrom = s.chrom AND t.start // 100000 = bin WHERE v IS NOT NULL GROUP BY ALL)"
        " SELECT *, CASE WHEN early > 0 THEN log2(early / avg(early) OVER (PARTITION BY chrom)) END AS enr FROM e",
        "contacts", "tor",
    ),
    "l03_duplicates": _S(
        ", r AS (SELECT cell_id, count(*) AS n, sum(cnt)::BIGINT AS reads, count(*) FILTER (cnt > 1) / count(*) AS observed FROM contacts GROUP BY ALL)"
        ", p AS (SELECT *, pow((n - 1) / n, reads) AS none, (reads / n) * pow((n - 1) / n, reads - 1) AS once FROM r)"
        " SELECT cell_id, n, reads, observed, CASE WHEN 1 - none <> 0 THEN (1 - none - once) / (1 - none) END AS expected FROM p",
        "contacts",
    ),
    "l08_mean_profiles": _S(
        _GR + _D + f", b AS (SELECT cell_id, CAST(CASE WHEN d IS NULL THEN -1 ELSE {_BIN} END AS INTEGER) AS bin, count(*) AS n FROM dd WHERE d IS NULL OR d > 0 GROUP BY ALL), f AS (SELECT * FROM b WHERE bin IS NOT NULL)"
        ", s AS (SELECT *, n / sum(n) OVER (PARTITION BY cell_id) AS share FROM f), j AS (SELECT * FROM s JOIN gr USING (cell_id)), z AS (SELECT grp, count(DISTINCT cell_id) AS cells FROM j GROUP BY grp)"
        " SELECT grp, bin, cells, sum(share) / cells AS share FROM j JOIN z USING (grp) GROUP BY grp, bin, cells",
        "contacts", "cells",
    ),
    "l26_slice_maps": _S(_ORD + " SELECT grp, chrom1, start1 // 10000000 AS bin1, start2 // 10000000 AS bin2, sum(cnt)::BIGINT AS n FROM contacts JOIN sl USING (cell_id) WHERE chrom1 = chrom2 GROUP BY ALL", "contacts"),
    "l39_mean_distance": _S(
        _IN + f", t AS (SELECT fid, CASE WHEN end_ - f.start >= 1010000 THEN 3 WHEN end_ - f.start >= 1000000 THEN 2 WHEN end_ - f.start >= 990000 THEN 1 ELSE 0 END AS size, {_TOR.format(v='v')} AS tor FROM frags f JOIN tor ON tor.chrom = f.chrom"
        " AND tor.start = (f.start + f.end_) // 2 // 100000 * 100000), dd AS (SELECT size, t.tor, start2 - start1 AS d FROM ind JOIN t ON t.fid = fid1 WHERE fid1 = fid2 AND chrom1 = chrom2)"
        f", b AS (SELECT size, tor, {_BIN} AS bin FROM dd) SELECT size, tor, count(*) AS n, sum(10 + bin / 8) / count(*) AS mean FROM b WHERE bin IS NOT NULL GROUP BY size, tor",
        "contacts", "frags", "tor",
    ),
    "l58_band_fractions": _S(f", dd AS (SELECT cell_id, start2 - start1 AS d FROM contacts WHERE chrom1 = chrom2), b AS (SELECT cell_id, {_BANDS} FROM dd GROUP BY ALL) SELECT *, {_LOGS}, mid >= 0.19 AS mitotic_like FROM b", "contacts"),
    "l63_cis_trans_scores": _S(
        _IN + _TRANS + _SCORE.format(n="c", w="chrom1 = chrom2 AND abs(start2 - start1) >= 2000000") + " SELECT fid, scc.a_score AS cis_score, sc.a_score AS a_score FROM sc JOIN scc USING (fid)", "contacts", "frags"
    ),
    "i01_ranked_barcodes": _S(
        ", r AS (SELECT substr(q, s + 1, 4) AS code FROM (SELECT q, unnest(range(0, length(q), 40)) AS s FROM seqs)), c AS (SELECT code, count(*) AS n FROM r WHERE length(code) = 4 GROUP BY code)"
        " SELECT *, CAST(row_number() OVER (ORDER BY n DESC, code) AS INTEGER) AS rank FROM c",
        "seqs",
    ),
    "i04_orders": _S(
        _D + ", a AS (SELECT cell_id, count(*) AS n, count(*) FILTER (d IS NULL) AS trans, max(d) AS most FROM dd GROUP BY ALL)"
        " SELECT cell_id, " + ", ".join(f"CAST(row_number() OVER (ORDER BY {e} NULLS LAST, cell_id) AS INTEGER) AS {k}" for k, e in (("by_n", "n"), ("by_trans", "-trans"), ("by_share", "round(trans / n, 9)"), ("by_most", "most"))) + " FROM a",
        "contacts",
    ),
    "i06_ends_of_order": _S(_ORD + " SELECT cell_id, n, ord <= 5 AS head FROM o WHERE ord <= 5 OR ord > (SELECT max(ord) FROM o) - 5", "contacts"),
    "i07_most_spread": _S(_KARYO + " SELECT chrom, round(stddev_samp(share), 12) AS sd FROM ks GROUP BY chrom ORDER BY sd DESC, chrom LIMIT 10", "contacts"),
    "n01_spliced": _S(
        ", r AS (SELECT substr(q, s + 1, 40) AS a FROM (SELECT q, unnest(range(0, length(q), 40)) AS s FROM seqs)), m AS (SELECT regexp_extract(a, '^(..)([AC]+)(G)(.*)', 4) || substr(a, 1, 2) AS seq FROM r WHERE regexp_matches(a, '^..[AC]+G'))"
        " SELECT seq, translate(seq, 'ACGT', 'IJKL') AS qual, count(*) AS n FROM m GROUP BY ALL",
        "seqs",
    ),
    "e08_typed_sides": _S(_MB + " SELECT a.type AS type1, b.type AS type2, count(*) AS n FROM contacts JOIN mb a ON a.chrom = chrom1 AND a.mb = start1 // 1000000 JOIN mb b ON b.chrom = chrom2 AND b.mb = start2 // 1000000 GROUP BY ALL", "contacts", "sites"),
    "e09_loops_with_tor": _S(_LOOPS + " SELECT site1, site2, a.v AS tor1, b.v AS tor2 FROM l JOIN tor a ON a.chrom = l.chrom AND a.start // 100000 = start1 // 100000 JOIN tor b ON b.chrom = l.chrom AND b.start // 100000 = start2 // 100000", "sites", "tor"),
    "e10_permitted_squares": _S(
        _LOOPS + ", f AS (SELECT chrom1 AS chrom, start1 // 1000000 AS bin1, start2 // 1000000 AS bin2, count(*) AS n FROM contacts WHERE chrom1 = chrom2 GROUP BY ALL)"
        " SELECT * FROM f WHERE (chrom, bin1, bin2) IN (SELECT (chrom, start1 // 1000000, start2 // 1000000) FROM l)",
        "contacts", "sites",
    ),
    "j02_unmapped_reads": _S(" SELECT DISTINCT read_id FROM hits WHERE read_id NOT IN (SELECT read_id FROM hits WHERE qual >= 30)", "hits"),
    "j03_shared_bins": _S(" SELECT chrom1 AS chrom, start1 // 1000000 AS mb FROM contacts WHERE chrom1 = chrom2 AND cell_id IN (1, 2, 3) GROUP BY ALL HAVING count(DISTINCT cell_id) = 3", "contacts"),
    "n10_expressions": _S(
        ", w AS (SELECT site_id, count(v) AS n, avg(v) AS mean, min(v) AS least, max(v) AS most FROM sites s LEFT JOIN tor t ON s.chrom = t.chrom AND t.start < s.end_ + 150000 AND t.start + 100000 > s.start - 150000 GROUP BY site_id)"
        " SELECT site_id, CASE WHEN mean IS NOT NULL AND mean > 0 THEN most ELSE 0.0 END AS value, n > 2 AND least < 0 AS mixed FROM w",
        "sites", "tor",
    ),
}
