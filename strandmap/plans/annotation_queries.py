"""Queries over values around places, classes of sites and contacts, and the path from hits to pairs of fragment ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap.functions import sequence as S
from strandmap.operators import annotation as A
from strandmap.operators import chains as CH
from strandmap.operators import contacts as C
from strandmap.operators import digest as G
from strandmap.operators import intervals as I
from strandmap.plans.fixtures import CHROM_LEN, duckdb_sql, view
from strandmap.sources.files import contacts_of


def _over(f, *views):
    return lambda spark, sf: f(*(view(spark, sf, v) for v in views))


def _typed(sites):
    kind = F.when(F.col("site_id") % 4 == 0, "C").when(F.col("site_id") % 7 == 0, "B").otherwise(F.col("type"))
    return sites.select("chrom", "start", "end_", kind.alias("type"))


def _rects(sites):
    """Squares of 500 kb up and down of the forward sites, off the diagonal."""
    at = F.col("start")
    return sites.where("type = 'F'").select("site_id", F.col("chrom").alias("chrom1"), (at - 500_000).alias("lo1"), at.alias("hi1"), F.col("chrom").alias("chrom2"), at.alias("lo2"), (at + 500_000).alias("hi2"))


def _marked(sites, tor):
    places = sites.select("site_id", "chrom", "start", "end_")
    rna = A.window_values(places, tor, "site_id", 100_000, 0, 1000).select("site_id", F.col("most").alias("rna"))
    mark = A.window_values(places, tor, "site_id", 100_000, -2000, 2000).select("site_id", F.col("mean").alias("mark"))
    return places.join(rna, "site_id").join(mark, "site_id")


def _absolute(tor):
    return tor.select("chrom", "start", F.abs("v").alias("v"))


def _millionths(tor):
    """Whole numbers, whose sums no engine rounds."""
    return tor.select("chrom", "start", F.round(F.col("v") * 1_000_000).alias("v"))


def _chains(hits):
    return CH.fendchains(hits.withColumnRenamed("end_", "end"))


def _key(segments):
    return CH.chain_key(segments).alias("key")


def _ends(frags):
    return G.fends(frags).withColumnRenamed("chrom", "chr")


def _baited(hits):
    chain = _chains(hits)
    keys = chain.select("read_id", (F.col("read_id") % 10).alias("key"))
    baits = keys.where("key < 7").select("key", (F.col("key") + 100).alias("fid")).distinct()
    return CH.baited(chain, keys, baits).select("read_id", _key(F.col("segments")))


def _mates(contacts):
    cols = [c for i in (1, 2) for c in ((F.col(f"start{i}") % 50 - 1).alias(f"fid{i}"), (F.col(f"start{i}") % 2).alias(f"side{i}"), (F.floor(F.col(f"start{i}") / 50) % 10).alias(f"off{i}"))]
    return contacts.select(*cols, (F.col("cnt") + 36).alias("q1"), (F.col("cell_id") % 4 + 37).alias("q2"))


def _sam(hits):
    flag = F.when(F.col("pos") % 4 == 0, 4).when(F.col("pos") % 4 == 1, 16).otherwise(0)
    return hits.select("read_id", "i", "pos", flag.alias("flag"), F.col("qual").alias("mapq"), (F.col("end_") - F.col("pos")).alias("len"))


def _came_back(contacts):
    name = F.concat_ws("_", F.col("chrom1").cast("string"), F.col("start1").cast("string"))
    return contacts.select(name.alias("read_id"), F.col("chrom1").cast("string").alias("chrom"), (F.col("start1") + (F.col("cnt") == 1).cast("long")).alias("pos"))


def _named_cells(cells):
    names = cells.select(F.concat_ws("_", F.lower("cond"), F.col("batch_id").cast("string")).alias("name")).distinct()
    return names.withColumn("key", A.natural_key(F.col("name")))


def _two_reads(seqs):
    rows = seqs.select(F.explode(S.reads(F.col("q"), 40)).alias("r"))
    return rows.select(F.substring("r", 1, 20).alias("seq"), F.substring("r", 21, 20).alias("seq2"))


QUERIES = {
    "f58_ctcf_contacts": _over(lambda c, s: A.contact_classes(c.select("chrom1", "start1", "chrom2", "start2"), _typed(s), 50_000).groupBy("type1", "type2", "type").agg(F.count("*").alias("n")), "contacts", "sites"),
    "f78_values_around": _over(lambda s, t: A.window_values(s, _millionths(t), "site_id", 100_000, -150_000, 150_000), "sites", "tor"),
    "f79_rectangles": _over(lambda c, s: A.rectangle_values(_rects(s), c, "site_id", 500_000), "contacts", "sites"),
    "f76_rectangles_in_band": _over(lambda c, s: A.rectangle_values(_rects(s), c, "site_id", 500_000, (20_000, 400_000)), "contacts", "sites"),
    "g21_start_classes": _over(lambda s, t: A.start_classes(_marked(s, t), "site_id", 0.5, 300_000, CHROM_LEN).select("site_id", "type", "selected"), "sites", "tor"),
    "f50_domain_means": _over(lambda f, s, t: A.domain_means(f, s, _absolute(t), "fid", 100_000), "frags", "sites", "tor"),
    "f15_middle_fragments": _over(lambda s, f: A.middle_fragments(s.select("site_id", "chrom", F.col("start").alias("at")), f, "site_id", 5_000_000, f.where("fid % 9 = 0")), "sites", "frags"),
    "j09_common_borders": _over(lambda s: A.common_borders(s, 1000, 400_000), "sites"),
    "c18_fragment_offsets": _over(lambda s, f: A.fragment_offsets(s, f, "site_id"), "sites", "frags"),
    "n14_mappable": _over(lambda c: A.mappable(_came_back(c), 1_000_000), "contacts"),
    "f07_pattern_counts": _over(lambda s: A.pattern_counts(_two_reads(s), "^(..)A", "(C[AG])T"), "seqs"),
    "i03_natural_order": _over(_named_cells, "cells"),
    "d01_usable_segments": _over(lambda h: CH.usable_segments(_sam(h), 20, 25).select("read_id", "i", "strand", F.col("end").alias("end_")), "hits"),
    "p06_fendchains": _over(lambda h: _chains(h).select("read_id", _key(F.col("segments"))), "hits"),
    "c12_reversed_chains": _over(lambda h: _chains(h).select("read_id", _key(CH.reverse_chain(F.col("segments")))), "hits"),
    "c13_digested_segments": _over(lambda h: _chains(h).select("read_id", _key(CH.without_undigested(F.col("segments"), 3))), "hits"),
    "c14_baits": _over(lambda h: _chains(h).select("read_id", CH.has_bait(F.col("segments"), 7).alias("bait")), "hits"),
    "e05_baited_chains": _over(_baited, "hits"),
    "f01_molecules": _over(lambda h: CH.molecules(_chains(h)).select("key", "reads"), "hits"),
    "f02_fend_pairs": _over(lambda h: CH.fend_pairs(CH.molecules(_chains(h))), "hits"),
    "d04_without_switches": _over(lambda h: CH.fend_pairs(CH.molecules(_chains(h)), 0.5), "hits"),
    "f03_multiplicity": _over(lambda h, f: CH.multiplicity(_chains(h), f), "hits", "frags"),
    "f05_composition": _over(lambda h, f: CH.composition(CH.molecules(_chains(h)), f, 1_500_000), "hits", "frags"),
    "e04_pair_coordinates": _over(lambda h, f: contacts_of(CH.fend_pairs(CH.molecules(_chains(h))).select("fend1", "fend2", "mol"), _ends(f)), "hits", "frags"),
    "d02_direct_counters": _over(lambda c: CH.direct_pairs(_mates(c))[1], "contacts"),
    "d03_direct_adjacency": _over(lambda c: CH.direct_pairs(_mates(c))[0], "contacts"),
    "f06_ligation_classes": _over(lambda c: c.withColumns({"fend1": F.floor(F.col("start1") / 1000), "fend2": F.floor(F.col("start2") / 1000)}).groupBy(CH.ligation_class().alias("kind")).agg(F.count("*").alias("n")), "contacts"),
    "g08_shuffled_contacts": _over(lambda c: A.shuffled(c, "s1"), "contacts"),
    "k16_pair_enrichments": _over(lambda c: A.pair_enrichments(C.chromosome_pairs(c), CHROM_LEN), "contacts"),
    "b07_piled_reads": _over(lambda h: A.piled_up(h.select((F.col("fid") % 19 + 1).alias("chrom"), (F.col("pos") * 50).alias("start"), (F.col("end_") * 50).alias("end_")), 200), "hits"),
    "f66_chromosome_phasing": _over(lambda c: A.chromosome_phasing(c), "contacts"),
}

_S = duckdb_sql
_TYPED = ", st AS (SELECT chrom, start, end_, CASE WHEN site_id % 4 = 0 THEN 'C' WHEN site_id % 7 = 0 THEN 'B' ELSE type END AS t FROM sites)"
_SIDES = (
    _TYPED + ", pl AS (SELECT chrom1 AS chrom, start1 AS start FROM contacts UNION SELECT chrom2, start2 FROM contacts)"
    ", k AS (SELECT p.chrom, p.start, list(DISTINCT t) AS ts FROM pl p JOIN st ON p.chrom = st.chrom AND p.start >= st.start - 50000 AND p.start < st.end_ + 50000 GROUP BY ALL)"
    ", ty AS (SELECT chrom, start, CASE WHEN list_contains(ts, 'B') OR (list_contains(ts, 'F') AND list_contains(ts, 'R')) THEN 'B' WHEN list_contains(ts, 'F') THEN 'F' WHEN list_contains(ts, 'R') THEN 'R' ELSE 'C' END AS t FROM k)"
    ", c AS (SELECT coalesce(a.t, 'N') AS type1, coalesce(b.t, 'N') AS type2 FROM contacts LEFT JOIN ty a ON a.chrom = chrom1 AND a.start = start1 LEFT JOIN ty b ON b.chrom = chrom2 AND b.start = start2)"
)
_RECT = (
    " SELECT r.site_id, count(start1) AS area, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS weighted, max(cnt) AS most FROM (SELECT * FROM sites WHERE type = 'F') r LEFT JOIN contacts"
    " ON chrom1 = r.chrom AND chrom2 = r.chrom AND start1 >= r.start - 500000 AND start1 < r.start AND start2 >= r.start AND start2 < r.start + 500000{band} GROUP BY ALL"
)
_ISLANDS = (
    ", w AS (SELECT *, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {rows})"
    ", g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM w)"
)
_CHAINS = (
    ", w AS (SELECT *, coalesce(lag(fid) OVER v = fid, false) AS same, coalesce(lag(end_) OVER v <= pos + 5 OR lag(pos) OVER v >= end_ - 5, true) AS ok FROM hits WINDOW v AS (PARTITION BY read_id ORDER BY i))"
    ", g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM w)"
    ", p AS (SELECT read_id, grp, min(fid) AS fid, arg_min(strand, i) AS strand, bool_or(same AND NOT ok) AS bad FROM g GROUP BY read_id, grp)"
    ", c AS (SELECT read_id, list(fid ORDER BY grp) AS fids, list(fid || ':' || strand ORDER BY grp) AS fw, list(fid || ':' || translate(strand, '+-', '-+') ORDER BY grp DESC) AS bw FROM p GROUP BY read_id HAVING NOT bool_or(bad))"
)
_MOLS = _CHAINS + ", m AS (SELECT least(array_to_string(fw, ','), array_to_string(bw, ',')) AS key, count(*) AS reads FROM c WHERE len(fw) > 1 GROUP BY ALL)"
_PAIRS = (
    _MOLS + ", x AS (SELECT reads, string_split(key, ',') AS s FROM m), y AS (SELECT reads, s, unnest(range(1, len(s))) AS k FROM x)"
    ", z AS (SELECT reads, s[k] AS a, s[k + 1] AS b, 1 AS step FROM y UNION ALL SELECT reads, s[k], s[k + 2], 2 FROM y WHERE k + 2 <= len(s))"
    ", e AS (SELECT reads, step, CAST(split_part(a, ':', 1) AS BIGINT) * 2 + (split_part(a, ':', 2) = '+')::INT AS u, CAST(split_part(b, ':', 1) AS BIGINT) * 2 + (split_part(b, ':', 2) = '-')::INT AS v FROM z)"
    ", q AS (SELECT least(u, v) AS fend1, greatest(u, v) AS fend2, reads, step FROM e)"
)
_SUMS = " SELECT fend1, fend2, count(*) FILTER (step = 1) AS direct, count(*) FILTER (step = 2) AS indirect, count(*) AS mol, CAST(sum(reads) AS BIGINT) AS reads, max(reads) AS max_reads FROM {0} GROUP BY fend1, fend2"
_FENDS = ", fe AS (SELECT fid * 2 AS fend, chrom, start AS coord FROM frags UNION ALL SELECT fid * 2 + 1, chrom, end_ - 1 FROM frags)"
_MATES = (
    ", r AS (SELECT start1 % 50 - 1 AS fid1, start1 % 2 AS side1, (start1 // 50) % 10 AS off1, start2 % 50 - 1 AS fid2, start2 % 2 AS side2, (start2 // 50) % 10 AS off2, cnt + 36 AS q1, cell_id % 4 + 37 AS q2 FROM contacts)"
    ", d AS (SELECT *, CASE WHEN least(q1, q2) < 38 THEN 'lowq' WHEN fid1 = -1 OR fid2 = -1 THEN 'nomap' WHEN fid1 = fid2 THEN 'self' ELSE 'ok' END AS kind FROM r)"
)

SQL = {
    "f58_ctcf_contacts": _S(
        _SIDES + " SELECT type1, type2, CASE WHEN type1 || type2 = 'NN' THEN 'none' WHEN type1 = 'C' OR type2 = 'C' THEN 'chip' WHEN type1 || type2 IN ('FR', 'BR', 'FB') THEN 'diver'"
        " WHEN type1 || type2 IN ('RF', 'BF', 'RB', 'BB') THEN 'conv' WHEN type1 || type2 IN ('RR', 'FF') THEN 'same' ELSE 'one_sided' END AS type, count(*) AS n FROM c GROUP BY ALL",
        "contacts", "sites",
    ),
    "f78_values_around": _S(
        " SELECT site_id, count(v) AS n, avg(v) AS mean, min(v) AS least, max(v) AS most, sum(v) AS total, sum(v * (least(s.end_ + 150000, t.start + 100000) - greatest(s.start - 150000, 0, t.start))) AS weighted"
        " FROM sites s LEFT JOIN (SELECT chrom, start, round(v * 1000000) AS v FROM tor) t ON s.chrom = t.chrom AND t.start < s.end_ + 150000 AND t.start + 100000 > s.start - 150000 GROUP BY site_id",
        "sites", "tor",
    ),
    "f79_rectangles": _S(_RECT.format(band=""), "contacts", "sites"),
    "f76_rectangles_in_band": _S(_RECT.format(band=" AND start2 - start1 >= 20000 AND start2 - start1 < 400000"), "contacts", "sites"),
    "g21_start_classes": _S(
        ", b AS (SELECT site_id, s.chrom, s.start, greatest(s.start - 300000, 0) AS lo, least(s.end_ + 300000, 200000000) AS hi,"
        " (SELECT max(v) FROM tor t WHERE t.chrom = s.chrom AND t.start < s.end_ + 1000 AND t.start + 100000 > s.start) AS rna,"
        " (SELECT avg(v) FROM tor t WHERE t.chrom = s.chrom AND t.start < s.end_ + 2000 AND t.start + 100000 > s.start - 2000) AS mark FROM sites s)" + _ISLANDS.format(rows="b")
        + " SELECT site_id, CASE WHEN rna >= 0.5 THEN 'T' ELSE 'F' END AS type, mark IS NOT NULL AND row_number() OVER (PARTITION BY chrom, island ORDER BY mark DESC NULLS LAST, site_id) = 1 AS selected FROM g",
        "sites", "tor",
    ),
    "f50_domain_means": _S(
        ", a AS (SELECT s.chrom, s.start, log2(1 + abs(v)) AS x FROM sites s JOIN tor t ON s.chrom = t.chrom AND s.start // 100000 = t.start // 100000)"
        " SELECT fid, avg(x) AS mean FROM frags f LEFT JOIN a ON a.chrom = f.chrom AND a.start >= f.start AND a.start < f.end_ GROUP BY fid",
        "frags", "sites", "tor",
    ),
    "f15_middle_fragments": _S(
        ", h AS (SELECT site_id, fid, row_number() OVER (PARTITION BY site_id ORDER BY f.start, fid) AS k, count(*) OVER (PARTITION BY site_id) AS n FROM sites s JOIN frags f"
        " ON f.chrom = s.chrom AND f.start >= s.start - 5000000 AND f.end_ <= s.start WHERE fid % 9 <> 0) SELECT site_id, fid FROM h WHERE k = greatest(round_even(n / 2, 0), 1)",
        "sites", "frags",
    ),
    "j09_common_borders": _S(
        ", pt AS (SELECT DISTINCT chrom, start, end_ FROM sites), pr AS (SELECT a.chrom, a.start AS lo, b.start AS hi FROM pt a JOIN pt b ON a.chrom = b.chrom AND b.start - a.start BETWEEN 1000 AND 400000)"
        ", sp AS (SELECT * FROM pr UNION ALL SELECT chrom, start, end_ FROM pt WHERE (chrom, start) NOT IN (SELECT (chrom, lo) FROM pr))" + _ISLANDS.format(rows="sp")
        + ", u AS (SELECT chrom, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY chrom, island) SELECT chrom, (lo + hi) // 2 AS start, (lo + hi) // 2 + 1 AS end_ FROM u WHERE hi - lo <= 400000",
        "sites",
    ),
    "c18_fragment_offsets": _S(" SELECT site_id, fid, s.start - f.start AS off5, f.end_ - s.start AS off3 FROM sites s JOIN frags f ON s.chrom = f.chrom AND s.start >= f.start AND s.start < f.end_", "sites", "frags"),
    "n14_mappable": _S(" SELECT CAST(chrom1 AS VARCHAR) AS chrom, start1 // 1000000 * 1000000 AS start, count(*) AS n FROM contacts WHERE cnt <> 1 GROUP BY ALL", "contacts"),
    "f07_pattern_counts": _S(
        ", r AS (SELECT substr(q, s + 1, 20) AS a, substr(q, s + 21, 20) AS b FROM (SELECT q, unnest(range(0, length(q), 40)) AS s FROM seqs))"
        " SELECT regexp_extract(a, '^(..)A', 1) || regexp_extract(b, '(C[AG])T', 1) AS code, count(*) AS n FROM r WHERE regexp_matches(a, '^(..)A') AND regexp_matches(b, '(C[AG])T') GROUP BY ALL",
        "seqs",
    ),
    "i03_natural_order": _S(
        ", n AS (SELECT DISTINCT lower(cond) || '_' || batch_id AS name FROM cells)"
        " SELECT name, array_to_string(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(ltrim(x, '0'), 30, '0') ELSE x END), '') AS key FROM n",
        "cells",
    ),
    "d01_usable_segments": _S(" SELECT read_id, i, CASE WHEN pos % 4 = 1 THEN '-' ELSE '+' END AS strand, end_ FROM hits WHERE pos % 4 <> 0 AND qual > 20 AND end_ - pos >= 25", "hits"),
    "p06_fendchains": _S(_CHAINS + " SELECT read_id, array_to_string(fw, ',') AS key FROM c", "hits"),
    "c12_reversed_chains": _S(_CHAINS + " SELECT read_id, array_to_string(bw, ',') AS key FROM c", "hits"),
    "c13_digested_segments": _S(_CHAINS + " SELECT read_id, array_to_string(list_filter(fw, lambda x, k: k = len(fw) OR abs(fids[k] - fids[k + 1]) > 3), ',') AS key FROM c", "hits"),
    "c14_baits": _S(_CHAINS + " SELECT read_id, len(fids) >= 3 AND fids[1] = 7 AS bait FROM c", "hits"),
    "e05_baited_chains": _S(_CHAINS + " SELECT read_id, (read_id % 10 + 100) || ':+,' || array_to_string(fw, ',') AS key FROM c WHERE read_id % 10 < 7", "hits"),
    "f01_molecules": _S(_MOLS + " SELECT key, reads FROM m", "hits"),
    "f02_fend_pairs": _S(_PAIRS + _SUMS.format("q"), "hits"),
    "d04_without_switches": _S(_PAIRS + ", o AS (SELECT * FROM q QUALIFY reads >= max(reads) OVER (PARTITION BY fend1, fend2) * 0.5)" + _SUMS.format("o"), "hits"),
    "f03_multiplicity": _S(
        _CHAINS + ", k AS (SELECT array_to_string(fw, ',') AS key, any_value(fids) AS fids, count(*) AS reads FROM c GROUP BY ALL), f AS (SELECT key, reads, unnest(fids) AS fid FROM k)"
        ", t AS (SELECT key, reads > 1 AS multi, count(DISTINCT chrom) > 1 AS trans FROM f LEFT JOIN frags USING (fid) GROUP BY key, reads) SELECT multi, trans, count(*) AS n FROM t GROUP BY ALL",
        "hits", "frags",
    ),
    "f05_composition": _S(
        _MOLS + ", x AS (SELECT key, string_split(key, ',') AS s FROM m), y AS (SELECT key, unnest(s) AS a, unnest(range(0, len(s))) AS k FROM x)"
        ", z AS (SELECT key, k, chrom, start FROM y JOIN frags ON fid = CAST(split_part(a, ':', 1) AS BIGINT))"
        ", l AS (SELECT *, lag(chrom) OVER v AS c0, lag(start) OVER v AS s0 FROM z WINDOW v AS (PARTITION BY key ORDER BY k))"
        ", n AS (SELECT key, count(*) FILTER (chrom <> c0) AS n_trans, count(*) FILTER (chrom = c0 AND abs(start - s0) <= 1500000) AS n_close, count(*) FILTER (chrom = c0 AND abs(start - s0) > 1500000) AS n_far FROM l WHERE c0 IS NOT NULL GROUP BY key)"
        " SELECT n_trans, n_close, n_far, count(*) AS count FROM n GROUP BY n_trans, n_close, n_far",
        "hits", "frags",
    ),
    "e04_pair_coordinates": _S(
        _PAIRS + _FENDS + ", o AS (SELECT fend1, fend2, count(*) AS mol FROM q GROUP BY ALL) SELECT o.*, a.chrom AS chrom1, a.coord AS start1, b.chrom AS chrom2, b.coord AS start2"
        " FROM o LEFT JOIN fe a ON a.fend = fend1 LEFT JOIN fe b ON b.fend = fend2",
        "hits", "frags",
    ),
    "d02_direct_counters": _S(_MATES + " SELECT kind, count(*) AS n FROM d GROUP BY ALL", "contacts"),
    "d03_direct_adjacency": _S(
        _MATES + ", e AS (SELECT least((fid1 * 2 + side1, off1), (fid2 * 2 + side2, off2)) AS a, greatest((fid1 * 2 + side1, off1), (fid2 * 2 + side2, off2)) AS b FROM d WHERE kind = 'ok')"
        " SELECT a[1] AS fend1, b[1] AS fend2, count(DISTINCT (a[2], b[2])) AS count FROM e GROUP BY ALL",
        "contacts",
    ),
    "f06_ligation_classes": _S(
        " SELECT CASE WHEN chrom1 <> chrom2 THEN 'trans' WHEN abs(start1 // 1000 - start2 // 1000) <= 1 THEN 'no_site' ELSE 'cis_' || (length(CAST(abs(start2 - start1) AS VARCHAR)) - 1) END AS kind, count(*) AS n FROM contacts GROUP BY ALL",
        "contacts",
    ),
    "g08_shuffled_contacts": _S(
        ", h AS (SELECT *, chrom1 || ':' || start1 || ':' || chrom2 || ':' || start2 AS k FROM contacts), o AS (SELECT *, md5('s1a:' || k) AS ha, md5('s1b:' || k) AS hb FROM h)"
        ", a AS (SELECT chrom1, start1, row_number() OVER (ORDER BY ha) AS pos FROM o), b AS (SELECT chrom2, start2, row_number() OVER (ORDER BY hb) AS pos FROM o) SELECT chrom1, start1, chrom2, start2 FROM a JOIN b USING (pos)",
        "contacts",
    ),
    "k16_pair_enrichments": _S(
        ", n AS (SELECT cell_id, least(chrom1, chrom2) AS a, greatest(chrom1, chrom2) AS b, count(*) AS n FROM contacts WHERE chrom1 <> chrom2 GROUP BY ALL)"
        ", g AS (SELECT cell_id, a, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT cell_id FROM n) CROSS JOIN (SELECT DISTINCT a, b FROM n) LEFT JOIN n USING (cell_id, a, b))"
        ", s AS (SELECT *, n / sum(n) OVER (PARTITION BY cell_id) AS share FROM g)"
        " SELECT cell_id, a, b, n, share, CASE WHEN n > 0 THEN log2(share / avg(share) OVER (PARTITION BY a, b)) END AS enrichment, n / (200.0 * 200.0) AS density FROM s",
        "contacts",
    ),
    "b07_piled_reads": _S(
        ", r AS (SELECT fid % 19 + 1 AS chrom, pos * 50 AS lo, end_ * 50 AS hi FROM hits), b AS (SELECT chrom, unnest(range(lo // 200, (hi - 1) // 200 + 1)) * 200 AS start FROM r WHERE lo < hi) SELECT chrom, start, count(*) AS n FROM b GROUP BY ALL",
        "hits",
    ),
    "f66_chromosome_phasing": _S(
        ", d AS (SELECT cell_id, chrom1 AS chrom, start2 - start1 AS d FROM contacts WHERE chrom1 = chrom2 AND start2 > start1)"
        " SELECT cell_id, chrom, count(*) AS n, count(*) FILTER (d >= 25000 AND d < 2000000) / count(*) AS near, CAST(sum(d) FILTER (d >= 4500000) AS DOUBLE) / count(*) FILTER (d >= 4500000) AS far_mean FROM d GROUP BY ALL",
        "contacts",
    ),
}
