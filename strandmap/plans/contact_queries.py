"""Queries over contacts: distances, marginals, duplicates, replication, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap.functions import distance as D
from strandmap.functions import measures as M
from strandmap.operators import contacts as C
from strandmap.plans.fixtures import CHROM_LEN, CHROMS, duckdb_sql, view

_EDGES = "[" + ", ".join(map(str, D.DECAY_EDGES)) + "]"
_BIN = f"CASE WHEN d > {D.DECAY_EDGES[-1]} THEN NULL ELSE len(list_filter({_EDGES}, lambda e: e < d)) END"
_D = ", dd AS (SELECT *, CASE WHEN chrom1 = chrom2 THEN start2 - start1 END AS d FROM contacts)"
_MODE = "CASE WHEN d IS NULL THEN 'trans' WHEN d < 1000 THEN 'self' WHEN d < 2000000 THEN '2M' ELSE 'far' END"


def _over(f, *views):
    return lambda spark, sf: f(*(view(spark, sf, v) for v in (views or ("contacts",))))


def _chroms(contacts):
    return contacts.sparkSession.range(1, CHROMS + 1).select(F.col("id").alias("chrom1"))


def _sql(body, *views):
    return duckdb_sql(body, *(views or ("contacts",)))


QUERIES = {
    "a26_full_scan": _over(lambda c: c.where("cell_id = 7").select("chrom1", "start1", "chrom2", "start2", "cnt")),
    "a27_scoped_scan": _over(lambda c: c.where(F.col("chrom1").isin(1, 2, 3) & F.col("chrom2").isin(1, 2, 3)).groupBy("chrom1", "chrom2").agg(F.count("*").alias("n"), F.sum("cnt").alias("total"))),
    "a28_banded_scan": _over(lambda c: c.where("chrom1 = chrom2 and start1 - start2 >= -1000000 and start1 - start2 < -100000").groupBy("chrom1").agg(F.count("*").alias("n"), F.sum(F.col("start2") - F.col("start1")).alias("span"))),
    "b11_track_stats": _over(C.track_stats),
    "b12_track_vars_pivot": _over(lambda c: C.track_stats(c).select("cell_id", F.explode(F.create_map(F.lit("n_adj"), "n_adj", F.lit("cis_frac"), "cis_frac")).alias("key", "value")).groupBy("cell_id").pivot("key", ["n_adj", "cis_frac"]).agg(F.first("value"))),
    "c23_decades": _over(lambda c: C.with_distance(c).where("d is not null").groupBy(D.decade(F.col("d")).alias("decade")).agg(F.count("*").alias("n"))),
    "c25_modes": _over(lambda c: C.with_distance(c).groupBy(D.contact_mode(F.col("d")).alias("mode")).agg(F.count("*").alias("n"))),
    "c28_log_steps": _over(lambda c: C.with_distance(c).where("d >= 1").groupBy(D.log_step(F.col("d")).alias("bin")).agg(F.count("*").alias("n"))),
    "c29_half_decades": _over(lambda c: C.with_distance(c).groupBy(D.half_decade(F.col("d")).alias("bin")).agg(F.count("*").alias("n"))),
    "f04_merge_raw_sum": _over(lambda c: C.merged(c, "raw_sum", 10_000_000)),
    "f04_merge_binary": _over(lambda c: C.merged(c, "binary_per_adj", 10_000_000)),
    "f04_merge_log_mean": _over(lambda c: C.merged(c, "to_imp", 10_000_000)),
    "f16_coarse_decay": _over(C.coarse_decay),
    "f18_partitioned_decay": _over(lambda c: C.partitioned_decay(c, 10)),
    "f19_fine_decay": _over(C.fine_decay),
    "f20_mode_counts": _over(lambda c: C.mode_counts(c, _chroms(c))),
    "f22_marginal_z": _over(C.marginal_z),
    "f23_repeated_fends": _over(lambda c: C.repeated_fends(c, 1_000_000)),
    "f26_replication_counts": _over(C.replication_counts, "contacts", "tor"),
    "f27_replication_shares": _over(lambda c, t: C.replication_shares(C.replication_counts(c, t)), "contacts", "tor"),
    "f28_shared_trans": _over(lambda c: C.shared_trans(c, 10_000_000)),
    "f29_shared_trans_of_pair": _over(lambda c: C.shared_trans(c.where("chrom1 = 5 and chrom2 = 6"), 10_000_000)),
    "f30_reads_per_contact": _over(C.reads_per_contact),
    "f31_mean_reads": _over(C.mean_reads),
    "f32_chromosome_pairs": _over(C.chromosome_pairs),
    "f34_orientations": _over(C.orientations),
    "f36_unique_ends": _over(lambda c: C.unique_ends(c, 1_000_000)),
    "f40_normalised_decay": _over(C.normalised_decay),
    "f41_octave_decay": _over(C.octave_decay),
    "f42_decays_side_by_side": _over(lambda c: C.octave_decay(c, ("cell_id",)).select("octave", "cell_id", "n")),
    "f43_pair_correlations": _over(lambda c: C.pair_correlations(c, 30)),
    "f46_marginal": _over(lambda c: C.marginal(c, 1_000_000)),
    "f51_alignment": _over(lambda c: C.alignment(c, CHROM_LEN, 3)),
    "f67_peaks_ratio": _over(lambda c: C.peaks_ratio(C.fine_decay(c))),
    "f69_batches": _over(lambda c, m: c.groupBy("cell_id").agg(F.sum("cnt").alias("reads")).join(m, "cell_id").groupBy("cond", "batch_id").agg(F.count("*").alias("n"), F.sum("valid").alias("n_good"), F.avg("reads").alias("mean_reads")), "contacts", "cells"),
    "f72_band_summary": _over(lambda c: C.band_summary(c, 100_000, 10_000_000)),
    "g15_pooled": _over(lambda c: C.canonical(c.withColumn("cell_id", F.lit(0).cast("long")))),
    "g17_pools_by_group": _over(lambda c, m: c.join(F.broadcast(m), "cell_id").groupBy("cond", "chrom1", "chrom2").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n")), "contacts", "cells"),
    "j01_symmetrised": _over(lambda c: C.symmetrize(c).groupBy("chrom1").agg(F.count("*").alias("n"), F.sum("start1").alias("places"))),
    "d07_quality": _over(lambda c: C.quality(c, 0.1, 0.2, 500, 10**6, 0.4)),
    "d08_covered_cells": _over(lambda c: (lambda n: n.crossJoin(F.broadcast(n.agg(F.percentile("n", F.lit(0.25)).alias("cut")))).where("n >= cut").select("cell_id", "n"))(c.where("chrom1 = 3").groupBy("cell_id").agg(F.count("*").alias("n")))),
    "c39_expected_duplicates": _over(lambda c: C.repeated_fends(c, 1_000_000).groupBy("cell_id").agg(F.sum("n_fends").alias("k"), F.sum("n_dup").alias("dup")).withColumn("expected", M.expected_duplicates(F.col("k").cast("double"), F.col("k") * 2.0))),
    "l21_coverage_quartiles": _over(lambda c: c.groupBy("cell_id").agg(F.count("*").alias("n")).agg(F.percentile("n", F.lit(0.25)).alias("q1"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.75)).alias("q3"))),
    "l22_trans_fraction": _over(lambda c: c.groupBy("cell_id").agg(F.avg((F.col("chrom1") != F.col("chrom2")).cast("int")).alias("f")).agg(F.percentile("f", F.lit(0.5)).alias("median"))),
    "l44_saturation": _over(lambda c: c.groupBy("cell_id").agg(F.sum("cnt").alias("reads"), F.count("*").alias("molecules"), F.avg((F.col("cnt") == 1).cast("int")).alias("p_single"))),
    "l59_pair_density": _over(lambda c: C.chromosome_pairs(c).groupBy("a", "b").agg(F.avg("n").alias("mean"), F.avg((F.col("n") >= 2).cast("int")).alias("share"))),
}

_Z = _D + """, n AS (SELECT cell_id, chrom1, count(*) AS n FROM contacts GROUP BY ALL),
z AS (SELECT *, sum(n) OVER (PARTITION BY cell_id)::DOUBLE * sum(n) OVER (PARTITION BY chrom1) / sum(n) OVER () AS expected FROM n)"""
_REP = """, p AS (SELECT DISTINCT chrom1, start1 FROM contacts WHERE chrom1 = chrom2),
m AS (SELECT chrom1, start1, avg(v) AS tor FROM p JOIN tor ON chrom = chrom1 AND start // 100000 BETWEEN greatest(start1 - 10000, 0) // 100000 AND (start1 + 10000) // 100000 GROUP BY ALL),
r AS (SELECT cell_id, CASE WHEN start2 - start1 < 1000 THEN 'self_tor' ELSE 'good_tor' END || (CAST(floor(greatest(least(tor, 2 - 1e-4), -2.0)) AS INT) + 3) AS kind, count(*) AS n FROM contacts JOIN m USING (chrom1, start1) WHERE chrom1 = chrom2 GROUP BY ALL)"""
_BINNED = """, b AS (SELECT cell_id, CASE WHEN (chrom1, start1 // 10000000) <= (chrom2, start2 // 10000000) THEN chrom1 ELSE chrom2 END AS c1, CASE WHEN (chrom1, start1 // 10000000) <= (chrom2, start2 // 10000000) THEN start1 // 10000000 ELSE start2 // 10000000 END AS s1,
  CASE WHEN (chrom1, start1 // 10000000) <= (chrom2, start2 // 10000000) THEN chrom2 ELSE chrom1 END AS c2, CASE WHEN (chrom1, start1 // 10000000) <= (chrom2, start2 // 10000000) THEN start2 // 10000000 ELSE start1 // 10000000 END AS s2, cnt FROM contacts),
k AS (SELECT cell_id, c1 AS chrom1, s1 AS start1, c2 AS chrom2, s2 AS start2, sum(cnt) AS cnt FROM b GROUP BY ALL)"""
_PAIRS = """, n AS (SELECT cell_id, least(chrom1, chrom2) AS a, greatest(chrom1, chrom2) AS b, count(*) AS n FROM contacts WHERE chrom1 <> chrom2 GROUP BY ALL),
g AS (SELECT cell_id, a, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT cell_id FROM n) CROSS JOIN (SELECT DISTINCT a, b FROM n) LEFT JOIN n USING (cell_id, a, b))"""
_SYM = ", s AS (SELECT * FROM contacts UNION ALL SELECT cell_id, chrom2, start2, chrom1, start1, cnt FROM contacts)"
_OCT = _D + ", o AS (SELECT cell_id, CASE WHEN d < 1024 THEN 9 ELSE CAST(floor(log2(d)) AS INT) END AS octave FROM dd WHERE d >= 1 AND d < 536870912)"
_FINE = _D + f", fine AS (SELECT cell_id, bin, count(*) AS n FROM (SELECT cell_id, CASE WHEN d IS NULL THEN -1 ELSE {_BIN} END AS bin FROM dd WHERE d IS NULL OR d > 0) WHERE bin IS NOT NULL GROUP BY ALL)"
_FEND = ", e AS (SELECT cell_id, chrom1, start1 // 1000000 AS f, count(*) AS n FROM contacts WHERE chrom1 = chrom2 GROUP BY ALL), x AS (SELECT cell_id, chrom1, count(*) AS n_fends, count(*) FILTER (n > 1) AS n_dup FROM e GROUP BY ALL)"

SQL = {
    "a26_full_scan": _sql(" SELECT chrom1, start1, chrom2, start2, cnt FROM contacts WHERE cell_id = 7"),
    "a27_scoped_scan": _sql(" SELECT chrom1, chrom2, count(*) AS n, sum(cnt)::BIGINT AS total FROM contacts WHERE chrom1 IN (1, 2, 3) AND chrom2 IN (1, 2, 3) GROUP BY ALL"),
    "a28_banded_scan": _sql(" SELECT chrom1, count(*) AS n, sum(start2 - start1)::BIGINT AS span FROM contacts WHERE chrom1 = chrom2 AND start1 - start2 >= -1000000 AND start1 - start2 < -100000 GROUP BY ALL"),
    "b11_track_stats": _sql(_SYM + " SELECT cell_id, count(*) / 2 AS n_adj, avg((chrom1 = chrom2)::INT) AS cis_frac FROM s GROUP BY ALL"),
    "b12_track_vars_pivot": _sql(_SYM + " SELECT cell_id, count(*) / 2 AS n_adj, avg((chrom1 = chrom2)::INT) AS cis_frac FROM s GROUP BY ALL"),
    "c23_decades": _sql(_D + " SELECT greatest(2, CAST(floor(log10(1 + abs(d))) AS INT)) AS decade, count(*) AS n FROM dd WHERE d IS NOT NULL GROUP BY ALL"),
    "c25_modes": _sql(_D + f" SELECT {_MODE} AS mode, count(*) AS n FROM dd GROUP BY ALL"),
    "c28_log_steps": _sql(_D + " SELECT floor(log2(d) * 8) / 8 AS bin, count(*) AS n FROM dd WHERE d >= 1 GROUP BY ALL"),
    "c29_half_decades": _sql(_D + " SELECT coalesce(round_even(2 * greatest(0.0, log10(1 + abs(d)) - 3), 0) / 2, -1.0) AS bin, count(*) AS n FROM dd GROUP BY ALL"),
    "f04_merge_raw_sum": _sql(_BINNED + " SELECT chrom1, start1, chrom2, start2, sum(cnt)::BIGINT AS value FROM k GROUP BY ALL"),
    "f04_merge_binary": _sql(_BINNED + " SELECT chrom1, start1, chrom2, start2, count(DISTINCT cell_id) AS value FROM k GROUP BY ALL"),
    "f04_merge_log_mean": _sql(_BINNED + " SELECT chrom1, start1, chrom2, start2, floor(100 * 64 * (exp(sum(ln(1 + cnt)) / 64) - 1)) / 100 AS value FROM k GROUP BY ALL"),
    "f16_coarse_decay": _sql(_D + " SELECT cell_id, " + ", ".join(f"count(*) FILTER (d > {a} AND d < {b}) AS c{i}" for i, (a, b) in enumerate([(0, 10**3), (10**3, 10**4), (10**4, 10**5), (10**5, 10**6), (10**6, 10**7), (10**7, 10**8)])) + ", count(*) FILTER (d IS NULL) AS ctrans FROM dd GROUP BY ALL"),
    "f18_partitioned_decay": _sql(_D + f" SELECT cell_id, chrom1, part, bin, sum(CASE WHEN bin = -1 THEN 0.5 ELSE 1.0 END)::DOUBLE AS n FROM (SELECT cell_id, chrom1, CAST((start1 * 31 + start2 * 17) % 10 AS INT) AS part, CASE WHEN d IS NULL THEN -1 ELSE {_BIN} END AS bin FROM dd) WHERE bin IS NOT NULL GROUP BY ALL"),
    "f19_fine_decay": _sql(_FINE + " SELECT * FROM fine"),
    "f20_mode_counts": _sql(_D + f", m AS (SELECT *, {_MODE} AS mode FROM dd), n AS (SELECT cell_id, chrom1, count(*) FILTER (mode = 'self') AS n_self, count(*) FILTER (mode = '2M') AS n_2m, count(*) FILTER (mode = 'far') AS n_far, count(*) FILTER (mode = 'trans') AS n_trans FROM m GROUP BY ALL) SELECT cell_id, chrom1, coalesce(n_self, 0) AS n_self, coalesce(n_2m, 0) AS n_2m, coalesce(n_far, 0) AS n_far, coalesce(n_trans, 0) AS n_trans FROM (SELECT DISTINCT cell_id FROM contacts) CROSS JOIN (SELECT unnest(range(1, 20)) AS chrom1) LEFT JOIN n USING (cell_id, chrom1)"),
    "f22_marginal_z": _sql(_Z + " SELECT cell_id, chrom1, n, expected, (n - expected) / sqrt(expected) AS z, log2((n + 1) / (expected + 1)) AS enr FROM z"),
    "f23_repeated_fends": _sql(_FEND + " SELECT *, n_dup / n_fends AS f_dup FROM x"),
    "f26_replication_counts": _sql(_REP + " SELECT * FROM r", "contacts", "tor"),
    "f27_replication_shares": _sql(_REP + " SELECT cell_id, " + ", ".join(f"coalesce(sum(n) FILTER (kind LIKE '%tor{i}'), 0) / sum(n) AS tor{i}" for i in range(1, 5)) + ", coalesce(sum(n) FILTER (kind LIKE '%tor3' OR kind LIKE '%tor4'), 0) / sum(n) AS early_f FROM r GROUP BY ALL", "contacts", "tor"),
    "f28_shared_trans": _sql(" SELECT cells, count(*) AS n FROM (SELECT count(DISTINCT cell_id) AS cells FROM contacts WHERE chrom1 <> chrom2 GROUP BY chrom1, start1 // 10000000, chrom2, start2 // 10000000) GROUP BY ALL"),
    "f29_shared_trans_of_pair": _sql(" SELECT cells, count(*) AS n FROM (SELECT count(DISTINCT cell_id) AS cells FROM contacts WHERE chrom1 = 5 AND chrom2 = 6 GROUP BY start1 // 10000000, start2 // 10000000) GROUP BY ALL"),
    "f30_reads_per_contact": _sql(" SELECT cell_id, chrom1 = chrom2 AS cis, cnt, count(*) AS n FROM contacts GROUP BY ALL"),
    "f31_mean_reads": _sql(" SELECT cell_id, avg(cnt) FILTER (chrom1 = chrom2) AS cis_mean, avg(cnt) FILTER (chrom1 <> chrom2) AS trans_mean FROM contacts GROUP BY ALL"),
    "f32_chromosome_pairs": _sql(_PAIRS + " SELECT * FROM g"),
    "f34_orientations": _sql(_D + " SELECT 'f' || (start1 % 2) || (start2 % 2) AS orientation, floor(log2(d) * 8) / 8 AS bin, count(*) AS n FROM dd WHERE d >= 100 AND d < 10000 GROUP BY ALL"),
    "f36_unique_ends": _sql(_SYM + " SELECT cell_id, count(*) AS n_ends FROM (SELECT DISTINCT cell_id, chrom1, start1 // 1000000 FROM s) GROUP BY ALL"),
    "f40_normalised_decay": _sql(_D + ", h AS (SELECT round_even(2 * greatest(0.0, log10(1 + abs(d)) - 3), 0) / 2 AS bin, count(*) AS n FROM dd WHERE d >= 1000 GROUP BY ALL) SELECT bin, n, n / sum(n) OVER () / (pow(10.0, bin + 3) * (sqrt(10.0) - 1)) AS density FROM h"),
    "f41_octave_decay": _sql(_OCT + " SELECT octave, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM o GROUP BY octave"),
    "f42_decays_side_by_side": _sql(_OCT + " SELECT octave, cell_id, count(*) AS n FROM o GROUP BY ALL"),
    "f43_pair_correlations": _sql(" SELECT chrom1, chrom2, count(*) AS n, corr(start1, start2) AS r FROM contacts WHERE chrom1 <> chrom2 GROUP BY ALL HAVING count(*) >= 30"),
    "f46_marginal": _sql(_SYM + " SELECT chrom1 AS chrom, start1 // 1000000 * 1000000 AS start, count(*) AS area, sum(cnt)::BIGINT AS weighted FROM s GROUP BY ALL"),
    "f51_alignment": _sql(f", w AS (SELECT cell_id, count(*) AS n, count(*) FILTER (chrom1 <> chrom2) AS ntrans, corr(start1 / {CHROM_LEN}, start2 / {CHROM_LEN}) FILTER (chrom1 <> chrom2) AS c_align FROM contacts GROUP BY ALL), p AS (SELECT cell_id, corr(start1 / {CHROM_LEN}, start2 / {CHROM_LEN}) AS r FROM contacts WHERE chrom1 <> chrom2 GROUP BY cell_id, chrom1, chrom2 HAVING count(*) > 3), f AS (SELECT cell_id, avg((r > 0)::INT) AS frac_pos FROM p GROUP BY ALL) SELECT * FROM w LEFT JOIN f USING (cell_id)"),
    "f67_peaks_ratio": _sql(_FINE + " SELECT cell_id, (sum(n) FILTER (bin BETWEEN 10 AND 94))::DOUBLE / (sum(n) FILTER (bin BETWEEN 104 AND 138)) AS ratio FROM fine GROUP BY ALL"),
    "f69_batches": _sql(", r AS (SELECT cell_id, sum(cnt) AS reads FROM contacts GROUP BY ALL) SELECT cond, batch_id, count(*) AS n, sum(valid)::BIGINT AS n_good, avg(reads) AS mean_reads FROM r JOIN cells USING (cell_id) GROUP BY ALL", "contacts", "cells"),
    "f72_band_summary": _sql(_D + " SELECT count(*) AS n, sum(cnt)::BIGINT AS total, min(cnt) AS least, max(cnt) AS most, avg(cnt) AS mean, stddev_samp(cnt) AS sd FROM dd WHERE d >= 100000 AND d < 10000000"),
    "g15_pooled": _sql(", k AS (SELECT CASE WHEN (chrom1, start1) <= (chrom2, start2) THEN [chrom1, start1, chrom2, start2] ELSE [chrom2, start2, chrom1, start1] END AS x, cnt FROM contacts) SELECT 0::BIGINT AS cell_id, x[1] AS chrom1, x[2] AS start1, x[3] AS chrom2, x[4] AS start2, sum(cnt)::BIGINT AS cnt FROM k GROUP BY ALL"),
    "g17_pools_by_group": _sql(" SELECT cond, chrom1, chrom2, sum(cnt)::BIGINT AS cnt, count(*) AS n FROM contacts JOIN cells USING (cell_id) GROUP BY ALL", "contacts", "cells"),
    "j01_symmetrised": _sql(_SYM + " SELECT chrom1, count(*) AS n, sum(start1)::BIGINT AS places FROM s GROUP BY ALL"),
    "d07_quality": _sql(_Z + ", q AS (SELECT cell_id, count(*) AS total, avg((coalesce(d, 1000000000) < 1000)::INT) AS f_nodig, avg((d IS NULL)::INT) AS f_trans FROM dd GROUP BY ALL), k AS (SELECT cell_id, max(abs(log2((n + 1) / (expected + 1)))) AS max_enr FROM z GROUP BY ALL) SELECT *, f_nodig <= 0.1 AND f_trans <= 0.2 AND total BETWEEN 500 AND 1000000 AND max_enr <= 0.4 AS passed FROM q JOIN k USING (cell_id)"),
    "d08_covered_cells": _sql(", n AS (SELECT cell_id, count(*) AS n FROM contacts WHERE chrom1 = 3 GROUP BY ALL) SELECT * FROM n WHERE n >= (SELECT quantile_cont(n, 0.25) FROM n)"),
    "c39_expected_duplicates": _sql(_FEND + ", y AS (SELECT cell_id, sum(n_fends)::BIGINT AS k, sum(n_dup)::BIGINT AS dup FROM x GROUP BY ALL), w AS (SELECT *, pow((k - 1) / k, k * 2.0) AS none, 2.0 * pow((k - 1) / k, k * 2.0 - 1) AS once FROM y) SELECT cell_id, k, dup, (1 - none - once) / (1 - none) AS expected FROM w"),
    "l21_coverage_quartiles": _sql(" SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3 FROM (SELECT count(*) AS n FROM contacts GROUP BY cell_id)"),
    "l22_trans_fraction": _sql(" SELECT quantile_cont(f, 0.5) AS median FROM (SELECT avg((chrom1 <> chrom2)::INT) AS f FROM contacts GROUP BY cell_id)"),
    "l44_saturation": _sql(" SELECT cell_id, sum(cnt)::BIGINT AS reads, count(*) AS molecules, avg((cnt = 1)::INT) AS p_single FROM contacts GROUP BY ALL"),
    "l59_pair_density": _sql(_PAIRS + " SELECT a, b, avg(n) AS mean, avg((n >= 2)::INT) AS share FROM g GROUP BY ALL"),
}
