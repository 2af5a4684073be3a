"""Queries over sequences, digests, barcodes, statistics and phasing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandmap.functions import measures as M
from strandmap.functions import sequence as S
from strandmap.operators import contacts as C
from strandmap.operators import digest as G
from strandmap.operators import phasing as P
from strandmap.operators import statistics as K
from strandmap.plans.contact_queries import _FINE
from strandmap.plans.contact_queries import SQL as _CONTACT_SQL
from strandmap.plans.fixtures import duckdb_sql, view
from strandmap.plans.interval_queries import _ORD, _ordered


def _over(f, *views):
    return lambda spark, sf: f(*(view(spark, sf, v) for v in views))


def _quals(seqs):
    """Whole sequences as consecutive reads of 40 bases, the last one as short as it is, with qualities from their letters."""
    return seqs.select("doc_id", F.explode(S.reads(F.col("q"), 40)).alias("seq")).withColumn("qual", F.translate("seq", "ACGT", "#+5I")).withColumn("quals", S.phred(F.col("qual")))


def _named(seqs):
    return seqs.select(F.col("doc_id").alias("chrom"), F.col("q").alias("seq"))


def _shares(decay):
    rows = decay.where("bin > 36").withColumn("oct", F.floor(F.col("bin") / 16).cast("int")).groupBy("cell_id", "oct").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cell_id")))
    return rows.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("oct", "p"))).alias("m")).select("cell_id", F.transform(F.sequence(F.lit(2), F.lit(8)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("p"))


def _two(contacts):
    """Coverage and trans share of cells, in two groups."""
    rows = contacts.groupBy("cell_id").agg(F.count("*").alias("n"), F.avg((F.col("chrom1") != F.col("chrom2")).cast("int")).alias("f"))
    return rows.withColumn("g", (F.col("cell_id") % 2).cast("int"))


def _metrics(contacts, tor):
    decay = C.fine_decay(contacts)
    early = C.replication_shares(C.replication_counts(contacts, tor)).select("cell_id", "early_f")
    return P.decay_metrics(decay).join(early, "cell_id")


_RULES = P.PhaseRules(0.71, 0.74, 0.2, 0.705, -1.8, 1.13)  # the fixture has no biology: thresholds that give every group some cells

QUERIES = {
    "c01_split_reads": _over(lambda s: s.select("doc_id", F.explode(S.split_at_site(F.col("q"))).alias("s")).select("doc_id", F.col("s.from").alias("lo"), F.col("s.to").alias("hi")), "seqs"),
    "c03_share_of_good": _over(lambda s: _quals(s).select("doc_id", S.share_at_least(F.col("quals"), 20).alias("share"), S.mean_quality(F.col("quals")).alias("mean")), "seqs"),
    "c04_quality_profile": _over(lambda s: G.quality_profile(_quals(s), 20), "seqs"),
    "c06_trim_position": _over(lambda s: G.trim_position(G.quality_profile(_quals(s), 10), 20, 0.99), "seqs"),
    "c07_trimmed": _over(lambda s: _quals(s).withColumn("cut", F.slice("quals", 1, 25)).where(S.mean_quality(F.col("cut")) >= 18).select("doc_id", F.substring("seq", 1, 25).alias("seq")), "seqs"),
    "c08_sampled": _over(lambda s: s.where("doc_id % 123 = 0").select("doc_id", F.length("q").alias("n")), "seqs"),
    "c09_barcodes": _over(lambda s: _quals(s).select(F.concat(S.barcode(F.col("seq"), 2), F.lit("_"), S.barcode(F.substring("seq", 3, 40), 2)).alias("code")).groupBy("code").agg(F.count("*").alias("n")), "seqs"),
    "c10_reverse_complement": _over(lambda s: s.select("doc_id", F.md5(S.reverse_complement(F.col("q"))).alias("rc")), "seqs"),
    "c34_short_numbers": _over(lambda c: c.select("start1", M.short_number(F.col("start1")).alias("text")), "contacts"),
    "c36_shades": _over(lambda c: C.fine_decay(c).select("cell_id", "bin", M.shade(F.col("n"), [0, 4, 10, 40], 16).alias("shade")), "contacts"),
    "c41_binomial": _over(lambda c: c.groupBy("cell_id").agg(F.count("*").alias("n")).select("cell_id", *(M.binomial(F.lit(k), F.col("n").cast("double"), F.lit(1 / 500)).alias(f"p{k}") for k in range(3))), "contacts"),
    "c42_kl_divergence": _over(lambda c: (lambda p: p.where("cell_id > 0").crossJoin(F.broadcast(p.where("cell_id = 0").select(F.col("p").alias("q")))).select("cell_id", M.kl_divergence(F.transform("p", lambda x: x + 0.001), F.transform("q", lambda x: x + 0.001)).alias("kl")))(_shares(C.fine_decay(c))), "contacts"),
    "c44_motif_classes": _over(lambda s: s.select("site_id", M.motif_class(F.col("start") % 100, F.col("start") % 77, 40).alias("kind")), "sites"),
    "c45_loop_types": _over(lambda s: s.select(F.when(F.col("site_id") % 4 == 0, "N").otherwise(F.col("type")).alias("a"), F.when(F.col("site_id") % 3 == 0, "N").when(F.col("site_id") % 3 == 1, "F").otherwise("R").alias("b")).groupBy(M.loop_type(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("n")), "sites"),
    "b01_demultiplexed": _over(lambda s: G.demultiplex(_quals(s), 3, ["ACG", "CAT", "GGA"]).groupBy("code").agg(F.count("*").alias("n")), "seqs"),
    "f10_barcode_report": _over(lambda s: G.barcode_report(_quals(s), 3, ["ACG", "TTT"], 0.02), "seqs"),
    "f11_digest": _over(lambda s: G.digest(_named(s)), "seqs"),
    "f12_fragment_lengths": _over(lambda s: G.length_histogram(G.digest(_named(s)), 100, 3000), "seqs"),
    "f13_fragment_ranges": _over(lambda f: f.groupBy("chrom").agg(F.min("fid").alias("low"), F.max("fid").alias("high")), "frags"),
    "n12_fends": _over(lambda f: G.fends(f), "frags"),
    "n13_tiles": _over(lambda s: s.select("doc_id", F.explode(S.tiles(F.col("q"), 40, 100)).alias("t")).select("doc_id", F.col("t.start").alias("start"), F.col("t.read").alias("read")), "seqs"),
    "k01_ks_test": _over(lambda c: K.ks_statistic(_two(c), "g", "n").select("d", "n0", "n1"), "contacts"),
    "k01_adjusted": _over(lambda c: K.adjusted(_two(c).select("cell_id", (F.col("f") / 10 + F.col("cell_id") / 10000).alias("p")), "p"), "contacts"),
    "k02_rank_sum": _over(lambda c: K.rank_sum(_two(c), "g", "n"), "contacts"),
    "k03_linear_fit": _over(lambda c: K.linear_fit(_two(c), "n", "f"), "contacts"),
    "k04_correlations": _over(lambda c: K.correlation_matrix(C.fine_decay(c), "cell_id", "bin", "n"), "contacts"),
    "k05_spearman": _over(lambda c: K.spearman(_two(c), "n", "f"), "contacts"),
    "k06_z_scores": _over(lambda c: K.z_scores(_two(c).select("cell_id", "n", "f"), ["n", "f"]), "contacts"),
    "k11_ecdf": _over(lambda c: _two(c).select("cell_id", F.cume_dist().over(Window.partitionBy("g").orderBy("n")).alias("ecdf")), "contacts"),
    "k12_box_quartiles": _over(lambda c: _two(c).groupBy("g").agg(*(F.percentile("n", F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75))), "contacts"),
    "k14_share_matrix": _over(lambda c: c.groupBy("cell_id", "cnt").agg(F.count("*").alias("n")).select("cell_id", "cnt", (F.col("n") / F.sum("n").over(Window.partitionBy("cell_id"))).alias("share")), "contacts"),
    "k17_js_distances": _over(lambda c: K.js_distances(_shares(C.fine_decay(c)), "cell_id", "p", 8), "contacts"),
    "i08_seven_nearest": _over(lambda c: K.nearest_rows(K.js_distances(_shares(C.fine_decay(c)), "cell_id", "p", 8).withColumn("d", F.round("d", 9)), 7).select("i", "j", "rank"), "contacts"),
    "g18_phase_metrics": _over(lambda c: P.decay_metrics(C.fine_decay(c)).select("cell_id", "near", "mitotic", "far_mu", "far_tightness", "n"), "contacts"),
    "k01_ks_p": _over(lambda c: K.ks_statistic(_two(c), "g", "f").select("d", "p"), "contacts"),
    "g18_order": _over(lambda c, t: P.phased(_metrics(c, t), _RULES).select("cell_id", "group", "ord"), "contacts", "tor"),
    "g18_phased": _over(lambda c, t: P.phased(_metrics(c, t), _RULES).select("cell_id", "group"), "contacts", "tor"),
    "k18_order_agreement": _over(lambda c: P.order_agreement(_ordered(c.where("chrom1 % 2 = 0")).select("cell_id", "ord"), _ordered(c.where("chrom1 % 2 = 1")).select("cell_id", "ord")), "contacts"),
    "l27_on_a_wheel": _over(lambda c: P.on_a_wheel(_ordered(c).select("cell_id", "ord")), "contacts"),
    "b15_features_table": _over(lambda c, t, m: P.features_table(C.coarse_decay(c), C.replication_shares(C.replication_counts(c, t)).select("cell_id", "early_f"), C.mean_reads(c), m.select("cell_id", "cond")), "contacts", "tor", "cells"),
    "g19_decay_clusters": _over(lambda c: P.clustered(C.fine_decay(c), 6), "contacts"),
}

_S = duckdb_sql
_Q = (
    ", rd AS (SELECT doc_id, substr(q, s + 1, 40) AS seq FROM (SELECT doc_id, q, unnest(range(0, length(q), 40)) AS s FROM seqs))"
    ", ql AS (SELECT *, list_transform(string_split(translate(seq, 'ACGT', '#+5I'), ''), lambda c: ascii(c) - 33) AS quals FROM rd)"
)
_CUTS = ", cu AS (SELECT doc_id, q, list_filter(range(0, length(q) - 3), lambda i: substr(q, i + 1, 4) = 'GATC') AS cuts FROM seqs)"
_DIG = _CUTS + ", p AS (SELECT doc_id AS chrom, q, unnest(cuts) AS pos, unnest(range(0, len(cuts))) AS k FROM cu), f AS (SELECT chrom, CAST(k AS INT) AS k, q, coalesce(lag(pos) OVER (PARTITION BY chrom ORDER BY k), 0) AS start, pos AS end_ FROM p), g AS (SELECT *, substr(q, start + 1, end_ - start) AS b, end_ - start AS length FROM f WHERE end_ > start), dg AS (SELECT chrom, k, start, end_, length, " + ", ".join(f"length - length(replace(b, '{x}', '')) AS n_{x.lower()}" for x in "ACGT") + " FROM g)"
_TWO = ", tw AS (SELECT cell_id, count(*) AS n, avg((chrom1 <> chrom2)::INT) AS f, CAST(cell_id % 2 AS INT) AS g FROM contacts GROUP BY ALL)"
_RK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
_SH = _FINE + ", s8 AS (SELECT cell_id, bin // 16 AS o, sum(n) AS n FROM fine WHERE bin > 36 GROUP BY ALL), sh AS (SELECT cell_id, o, n / sum(n) OVER (PARTITION BY cell_id) AS p FROM s8), gr AS (SELECT cell_id, o, coalesce(p, 0) AS p FROM (SELECT DISTINCT cell_id FROM sh) CROSS JOIN (SELECT unnest(range(2, 9)) AS o) LEFT JOIN sh USING (cell_id, o))"
_JS = _SH + ", js AS (SELECT a.cell_id AS i, b.cell_id AS j, sqrt(greatest(sum(CASE WHEN a.p > 0 THEN a.p * ln(a.p / ((a.p + b.p) / 2)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * ln(b.p / ((a.p + b.p) / 2)) ELSE 0 END) / 2, 0)) AS d FROM gr a JOIN gr b USING (o) WHERE a.cell_id < b.cell_id GROUP BY ALL)"
_MET = _FINE + ", mt AS (SELECT cell_id, sum(n) FILTER (bin > 36 AND bin <= 88) / sum(n) AS near, sum(n) FILTER (bin > 88 AND bin <= 108) / sum(n) AS mitotic, sum(n * pow(2.0, 10 + bin / 8)) FILTER (bin BETWEEN 97 AND 142) / sum(n) FILTER (bin BETWEEN 97 AND 142) AS far_mu, max(n) FILTER (bin BETWEEN 97 AND 142) / sum(n) FILTER (bin BETWEEN 97 AND 142) AS far_tightness, sum(n)::BIGINT AS n FROM fine WHERE bin > 36 GROUP BY ALL)"
_R = _RULES
SQL = {
    "c01_split_reads": _S(_CUTS + ", e AS (SELECT doc_id, list_distinct(list_concat(list_transform(cuts, lambda i: i + 4), [length(q)])) AS ends FROM cu), x AS (SELECT doc_id, unnest(list_sort(ends)) AS hi FROM e), y AS (SELECT doc_id, CAST(coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY hi), 0) AS INT) AS lo, CAST(hi AS INT) AS hi FROM x) SELECT * FROM y WHERE hi - lo >= 16", "seqs"),
    "c03_share_of_good": _S(_Q + " SELECT doc_id, len(list_filter(quals, lambda x: x >= 20)) / len(quals) AS share, list_sum(quals) / len(quals) AS mean FROM ql", "seqs"),
    "c04_quality_profile": _S(_Q + ", p AS (SELECT CAST(unnest(range(0, len(quals))) AS INT) AS pos, unnest(quals) AS x FROM ql) SELECT pos, avg((x >= 20)::INT) AS share FROM p GROUP BY ALL", "seqs"),
    "c06_trim_position": _S(_Q + ", p AS (SELECT CAST(unnest(range(0, len(quals))) AS INT) AS pos, unnest(quals) AS x FROM ql), g AS (SELECT pos, avg((x >= 10)::INT) AS share FROM p GROUP BY ALL) SELECT min(pos) AS pos FROM g WHERE pos >= 19 AND share < 0.99", "seqs"),
    "c07_trimmed": _S(_Q + " SELECT doc_id, substr(seq, 1, 25) AS seq FROM ql WHERE list_sum(quals[1:25]) / least(25, len(quals)) >= 18", "seqs"),
    "c08_sampled": _S(" SELECT doc_id, length(q) AS n FROM seqs WHERE doc_id % 123 = 0", "seqs"),
    "c09_barcodes": _S(_Q + " SELECT CASE WHEN length(seq) >= 4 THEN substr(seq, 1, 2) || '_' || substr(seq, 3, 2) END AS code, count(*) AS n FROM ql GROUP BY ALL", "seqs"),
    "c10_reverse_complement": _S(" SELECT doc_id, md5(translate(reverse(q), 'GATC', 'CTAG')) AS rc FROM seqs", "seqs"),
    "c34_short_numbers": _S(" SELECT start1, CASE WHEN start1 >= 1000000 THEN printf('%.2fM', start1 / 1e6) WHEN start1 >= 1000 THEN printf('%.2fK', start1 / 1e3) ELSE printf('%.2f', start1::DOUBLE) END AS text FROM contacts", "contacts"),
    "c36_shades": _S(_FINE + ", v AS (SELECT cell_id, bin, greatest(least(n, 40), 0) AS v FROM fine) SELECT cell_id, bin, CASE WHEN v <= 4 THEN least(CAST(floor(v / 4 * 16) AS INT) + 1, 16) WHEN v <= 10 THEN least(CAST(floor((v - 4) / 6 * 16) AS INT) + 17, 32) ELSE least(CAST(floor((v - 10) / 30 * 16) AS INT) + 33, 48) END AS shade FROM v", "contacts"),
    "c41_binomial": _S(", n AS (SELECT cell_id, count(*) AS n FROM contacts GROUP BY ALL) SELECT cell_id, pow(1 - 1 / 500, n) AS p0, n / 500 * pow(1 - 1 / 500, n - 1) AS p1, n * (n - 1) / 2 / 250000 * pow(1 - 1 / 500, n - 2) AS p2 FROM n", "contacts"),
    "c42_kl_divergence": _S(_SH + " SELECT a.cell_id, sum((a.p + 0.001) * ln((a.p + 0.001) / (b.p + 0.001))) AS kl FROM gr a JOIN gr b USING (o) WHERE a.cell_id > 0 AND b.cell_id = 0 GROUP BY ALL", "contacts"),
    "c44_motif_classes": _S(" SELECT site_id, CASE WHEN start % 100 >= 40 AND start % 77 >= 40 THEN 'C' WHEN start % 100 >= 40 THEN 'F' WHEN start % 77 >= 40 THEN 'R' ELSE 'B' END AS kind FROM sites", "sites"),
    "c45_loop_types": _S(", x AS (SELECT CASE WHEN site_id % 4 = 0 THEN 'N' ELSE type END AS a, CASE site_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'F' ELSE 'R' END AS b FROM sites) SELECT CASE WHEN a = 'N' AND b = 'N' THEN 'none' WHEN a = 'N' OR b = 'N' THEN 'one_sided' WHEN a = 'F' AND b = 'R' THEN 'conv' WHEN a = 'R' AND b = 'F' THEN 'diver' ELSE 'same' END AS kind, count(*) AS n FROM x GROUP BY ALL", "sites"),
    "b01_demultiplexed": _S(_Q + " SELECT CASE WHEN substr(seq, 1, 3) IN ('ACG', 'CAT', 'GGA') THEN substr(seq, 1, 3) ELSE 'NoCode' END AS code, count(*) AS n FROM ql GROUP BY ALL", "seqs"),
    "f10_barcode_report": _S(_Q + ", n AS (SELECT CASE WHEN length(seq) >= 3 THEN substr(seq, 1, 3) END AS barcode, count(*) AS n FROM ql GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER () AS freq, barcode IN ('ACG', 'TTT') AS expected FROM n) SELECT * FROM f WHERE barcode IS NOT NULL AND (freq >= 0.02 OR expected)", "seqs"),
    "f11_digest": _S(_DIG + " SELECT *, floor((n_g + n_c) / length * 1000) / 1000 AS gc FROM dg", "seqs"),
    "f12_fragment_lengths": _S(_DIG + " SELECT least(length // 100, 30) * 100 AS bin, count(*) AS n FROM dg GROUP BY ALL", "seqs"),
    "f13_fragment_ranges": _S(" SELECT chrom, min(fid) AS low, max(fid) AS high FROM frags GROUP BY ALL", "frags"),
    "n12_fends": _S(" SELECT fid * 2 AS fend, chrom, start AS coord, start + 1 AS coord_end FROM frags UNION ALL SELECT fid * 2 + 1, chrom, end_ - 1, end_ FROM frags", "frags"),
    "n13_tiles": _S(", t AS (SELECT doc_id, q, unnest(range(100, length(q) - 40, 100)) AS s FROM seqs) SELECT doc_id, CAST(s AS INT) AS start, substr(q, s, 40) AS read FROM t", "seqs"),
    "k01_ks_test": _S(_TWO + ", e AS (SELECT DISTINCT n FROM tw), d AS (SELECT abs((SELECT count(*) FROM tw WHERE g = 0 AND tw.n <= e.n) / (SELECT count(*) FROM tw WHERE g = 0) - (SELECT count(*) FROM tw WHERE g = 1 AND tw.n <= e.n) / (SELECT count(*) FROM tw WHERE g = 1)) AS gap FROM e) SELECT max(gap) AS d, (SELECT count(*) FROM tw WHERE g = 0) AS n0, (SELECT count(*) FROM tw WHERE g = 1) AS n1 FROM d", "contacts"),
    "k01_adjusted": _S(_TWO + ", p AS (SELECT cell_id, f / 10 + cell_id / 10000 AS p FROM tw), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p) SELECT cell_id, p, least(min(p * n / k) OVER (ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM r", "contacts"),
    "k02_rank_sum": _S(_TWO + f", r AS (SELECT g, {_RK.format('n')} AS r, count(*) OVER (PARTITION BY n) AS t FROM tw), a AS (SELECT count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, sum(r) FILTER (g = 1) AS ranks, sum(t * t - 1) AS ties FROM r), w AS (SELECT *, ranks - n1 * (n1 + 1) / 2 AS w FROM a) SELECT n0, n1, w, (w - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS z FROM w", "contacts"),
    "k03_linear_fit": _S(_TWO + " SELECT regr_slope(f, n) AS slope, regr_intercept(f, n) AS intercept, regr_r2(f, n) AS r2 FROM tw", "contacts"),
    "k04_correlations": _S(_FINE + " SELECT a.cell_id AS i, b.cell_id AS j, corr(a.n, b.n) AS r, count(*) AS n FROM fine a JOIN fine b USING (bin) WHERE a.cell_id < b.cell_id GROUP BY ALL", "contacts"),
    "k05_spearman": _S(_TWO + f", r AS (SELECT {_RK.format('n')} AS a, {_RK.format('f')} AS b FROM tw) SELECT corr(a, b) AS rho FROM r", "contacts"),
    "k06_z_scores": _S(_TWO + " SELECT cell_id, n, f, (n - (SELECT avg(n) FROM tw)) / (SELECT stddev_samp(n) FROM tw) + (f - (SELECT avg(f) FROM tw)) / (SELECT stddev_samp(f) FROM tw) AS z FROM tw", "contacts"),
    "k11_ecdf": _S(_TWO + " SELECT cell_id, cume_dist() OVER (PARTITION BY g ORDER BY n) AS ecdf FROM tw", "contacts"),
    "k12_box_quartiles": _S(_TWO + " SELECT g, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75 FROM tw GROUP BY ALL", "contacts"),
    "k14_share_matrix": _S(" SELECT cell_id, cnt, count(*) / sum(count(*)) OVER (PARTITION BY cell_id) AS share FROM contacts GROUP BY cell_id, cnt", "contacts"),
    "k17_js_distances": _S(_JS + " SELECT * FROM js", "contacts"),
    "i08_seven_nearest": _S(_JS + ", b AS (SELECT i, j, round(d, 9) AS d FROM js UNION ALL SELECT j, i, round(d, 9) FROM js), r AS (SELECT i, j, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INT) AS rank FROM b) SELECT * FROM r WHERE rank <= 7", "contacts"),
    "g18_phase_metrics": _S(_MET + " SELECT * FROM mt", "contacts"),
    "k01_ks_p": _S(
        _TWO + ", e AS (SELECT DISTINCT f FROM tw), d AS (SELECT abs((SELECT count(*) FROM tw WHERE g = 0 AND tw.f <= e.f) / (SELECT count(*) FROM tw WHERE g = 0) - (SELECT count(*) FROM tw WHERE g = 1 AND tw.f <= e.f) / (SELECT count(*) FROM tw WHERE g = 1)) AS gap FROM e)"
        ", m AS (SELECT max(gap) AS d, max(gap) * sqrt((SELECT count(*) FROM tw WHERE g = 0) * (SELECT count(*) FROM tw WHERE g = 1) / (SELECT count(*) FROM tw)) AS x FROM d)"
        " SELECT d, least(greatest(CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(1, 21), lambda k: 2 * (-1) ** (k - 1) * exp(-2.0 * k * k * x * x))) END, 0), 1) AS p FROM m",
        "contacts",
    ),
    "g18_order": _S(
        _MET + ", rs AS (" + _CONTACT_SQL["f27_replication_shares"] + f"), gr AS (SELECT mt.*, early_f, CASE WHEN near > {_R.near_max_post_m} AND {_R.pre_m_slope} * mitotic - near + {_R.pre_m_intercept} < 0 THEN 5 WHEN mitotic >= {_R.mitotic_min_post_m} AND near <= {_R.near_max_post_m} THEN 1 WHEN near <= {_R.near_s_start} THEN 2 WHEN near <= {_R.near_mid_s} THEN 3 ELSE 4 END AS g FROM mt JOIN rs USING (cell_id))"
        ", st AS (SELECT *, avg(near) OVER w AS near_m, stddev_samp(near) OVER w AS near_s, avg(far_mu) OVER w AS far_m, stddev_samp(far_mu) OVER w AS far_s, var_samp(near) OVER w AS near_v, var_samp(early_f) OVER w AS early_v FROM gr WINDOW w AS (PARTITION BY g))"
        ", ky AS (SELECT cell_id, g, CASE g WHEN 1 THEN -mitotic WHEN 2 THEN coalesce((near - near_m) / nullif(near_s, 0), 0) + coalesce((far_mu - far_m) / nullif(far_s, 0), 0) WHEN 3 THEN coalesce(near / nullif(near_v, 0), 0) + coalesce(early_f / nullif(early_v, 0), 0) WHEN 4 THEN coalesce(near / nullif(near_v, 0), 0) - coalesce(early_f / nullif(early_v, 0), 0) ELSE mitotic END AS key FROM st)"
        " SELECT cell_id, g AS \"group\", CAST(row_number() OVER (ORDER BY g, round(key, 9), cell_id) AS INTEGER) AS ord FROM ky",
        "contacts", "tor",
    ),
    "g18_phased": _S(_MET + f" SELECT cell_id, CASE WHEN near > {_R.near_max_post_m} AND {_R.pre_m_slope} * mitotic - near + {_R.pre_m_intercept} < 0 THEN 5 WHEN mitotic >= {_R.mitotic_min_post_m} AND near <= {_R.near_max_post_m} THEN 1 WHEN near <= {_R.near_s_start} THEN 2 WHEN near <= {_R.near_mid_s} THEN 3 ELSE 4 END AS \"group\" FROM mt", "contacts"),
    "k18_order_agreement": _S("".join(f", t{i} AS (SELECT cell_id, count(*) AS n FROM contacts WHERE chrom1 % 2 = {i} GROUP BY ALL), o{i} AS (SELECT cell_id, CAST(row_number() OVER (ORDER BY n, cell_id) AS INT) AS ord FROM t{i})" for i in (0, 1)) + ", b AS (SELECT a.cell_id, a.ord AS x, b.ord AS y, count(*) OVER () AS n FROM o0 a JOIN o1 b USING (cell_id)) SELECT cell_id, x, y, least(abs(x - y), n - abs(x - y)) AS gap, least(abs(x - y), n - abs(x - y)) >= 0.1 * n AS outlier FROM b", "contacts"),
    "l27_on_a_wheel": _S(_ORD + " SELECT cell_id, ord, 2 * pi() * ord / (SELECT count(*) FROM o) AS angle FROM o", "contacts"),
}
from strandmap.plans.contact_queries import _REP, SQL as _C  # noqa: E402

_FEATURES = "WITH" + _C["f16_coarse_decay"][4:].replace(" SELECT cell_id, count(*) FILTER (d > 0", " , cd AS (SELECT cell_id, count(*) FILTER (d > 0") + "), " + _S("", "tor")[5:] + _REP + ", rp AS (SELECT cell_id, coalesce(sum(n) FILTER (kind LIKE '%tor3' OR kind LIKE '%tor4'), 0) / sum(n) AS early_f FROM r GROUP BY ALL), mr AS (SELECT cell_id, avg(cnt) FILTER (chrom1 = chrom2) AS cis_mean, avg(cnt) FILTER (chrom1 <> chrom2) AS trans_mean FROM contacts GROUP BY ALL), " + _S("", "cells")[5:] + " SELECT cd.*, early_f, cis_mean, trans_mean, cond FROM cd LEFT JOIN rp USING (cell_id) LEFT JOIN mr USING (cell_id) LEFT JOIN cells USING (cell_id)"
SQL["b15_features_table"] = _FEATURES
