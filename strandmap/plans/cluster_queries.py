"""Queries over clusters and peaks: decay profiles of cells, domains by their contacts with other domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap.operators import clusters as CL
from strandmap.operators import contacts as C
from strandmap.operators import domains as DO
from strandmap.operators import intervals as I
from strandmap.operators import lineage
from strandmap.operators import peaks as PK
from strandmap.operators import projection as PR
from strandmap.operators import trees as T
from strandmap.plans.fixtures import duckdb_sql, view

CELLS, DOMAINS, ROUNDS, QUANTILE = 4, 3, 2, 0.825
NEAR = 7
DELTA, TRIM = 1.0, -3.0
PEAK = {"size": 3_000_000, "width": 2, "high": 2.0, "around": 0.5, "distance": 9_000_000, "least": 100}


def _over(f, *views):
    return lambda spark, sf: f(*(view(spark, sf, v) for v in views))


def _octaves(contacts):
    """Contacts of each cell within chromosomes by octave of distance; octaves without contacts are missing."""
    rows = contacts.where("chrom1 = chrom2 and start2 > start1")
    return rows.groupBy(F.col("cell_id").alias("row"), F.length(F.bin(F.col("start2") - F.col("start1"))).alias("col")).agg(F.count("*").alias("n"))


def _profiles(contacts):
    """Shares of the octaves of distance in each cell's contacts within chromosomes; octaves without contacts are missing."""
    rows = _octaves(contacts)
    total = rows.groupBy("row").agg(F.sum("n").alias("_all"))
    return rows.join(total, "row").select("row", "col", (F.col("n") / F.col("_all")).alias("v"))


def _cells(contacts):
    entries = _profiles(contacts)
    return CL.kmeans(entries, CL.seeds(entries, CELLS, QUANTILE), CELLS, ROUNDS)[0].select(F.col("row").alias("cell_id"), "cluster")


def _seeds(contacts):
    return CL.seeds(_profiles(contacts), CELLS, QUANTILE).select("cluster", F.col("col").alias("octave"), F.round("c", 9).alias("share"))


def _domains(scale):
    def query(contacts, frags):
        lengths = frags.select("fid", (F.col("end_") - F.col("start")).alias("len"))
        entries = CL.normalised_pairs(DO.pair_totals(contacts, frags), lengths, scale, DELTA, TRIM)
        return CL.kmeans(entries, CL.seeds(entries, DOMAINS, QUANTILE), DOMAINS, 1)[0].select(F.col("row").alias("fid"), "cluster")

    return query


def _normalised(contacts, frags):
    lengths, pairs = frags.select("fid", (F.col("end_") - F.col("start")).alias("len")), DO.pair_totals(contacts, frags)
    found = [CL.normalised_pairs(pairs, lengths, s, DELTA).withColumnRenamed("v", s) for s in ("mean", "area", "marginal")]
    return found[0].join(found[1], ["row", "col"]).join(found[2], ["row", "col"]).withColumnsRenamed({"row": "fid1", "col": "fid2"})


def _peaks(contacts, frags):
    points = I.containing(contacts, frags, "chrom1", "start1", "fid", "fid").select(F.col("cell_id").alias("key"), F.col("chrom1").alias("chrom"), F.col("start1").alias("pos"), "fid")
    return PK.peaks_by_key(points, frags, **PEAK)


def _tree(contacts):
    merges = T.ward(T.leaves(_profiles(contacts)))
    return merges.select("left_row", "right_row", F.round("height", 9).alias("height"), "size", "made", "row")


def _tree_order(contacts):
    entries = _profiles(contacts)
    merges = lineage.cut(T.ward(T.leaves(entries)))
    means = entries.groupBy("row").agg(F.sum(F.col("col") * F.col("v")).alias("weight"))
    return T.leaf_order(T.reordered(merges, means)).select(F.col("row").alias("cell_id"), "place")


def _projection(contacts):
    found, values = PR.projected(_octaves(contacts).withColumnRenamed("n", "v"), NEAR, 2)
    axes = [F.round(F.element_at("vector", i), 6).alias(f"axis{i}") for i in (1, 2)]
    return found.select(F.col("node").alias("cell_id"), *axes, *(F.lit(round(x, 6)).alias(f"value{i}") for i, x in enumerate(values, 1)))


QUERIES = {
    "g32_projection": _over(_projection, "contacts"),
    "k10_tree_order": _over(_tree_order, "contacts"),
    "k10_ward": _over(_tree, "contacts"),
    "g30_seeds": _over(_seeds, "contacts"),
    "g29_profile_clusters": _over(_cells, "contacts"),
    "g14_normalised_pairs": _over(_normalised, "contacts", "frags"),
    "g14_domain_clusters": _over(_domains("marginal"), "contacts", "frags"),
    "f14_peaks": _over(_peaks, "contacts", "frags"),
}

_PROFILES = ", oc AS (SELECT cell_id AS r, len(ltrim(CAST(CAST(start2 - start1 AS BIT) AS VARCHAR), '0')) AS c, count(*) AS n FROM contacts WHERE chrom1 = chrom2 AND start2 > start1 GROUP BY ALL), en AS (SELECT r, c, n / sum(n) OVER (PARTITION BY r) AS v FROM oc)"
_PAIRS = (
    ", ind AS (SELECT c.*, a.fid AS fid1, b.fid AS fid2 FROM contacts c JOIN frags a ON c.chrom1 = a.chrom AND c.start1 >= a.start AND c.start1 < a.end_ JOIN frags b ON c.chrom2 = b.chrom AND c.start2 >= b.start AND c.start2 < b.end_)"
    ", pt AS (SELECT fid1, fid2, sum(cnt)::BIGINT AS n FROM (SELECT fid1, fid2, cnt FROM ind WHERE chrom1 <> chrom2 UNION ALL SELECT fid2, fid1, cnt FROM ind WHERE chrom1 <> chrom2) GROUP BY ALL)"
    f", mg AS (SELECT fid1 AS fid, sum(n + 1) AS m FROM pt GROUP BY ALL), tt AS (SELECT sum(n + {DELTA}) AS s, sum(n + 1) AS p, avg(n + {DELTA}) AS mean FROM pt)"
    ", ar AS (SELECT fid1, fid2, n, (a.end_ - a.start)::DOUBLE * (b.end_ - b.start) AS area FROM pt JOIN frags a ON a.fid = fid1 JOIN frags b ON b.fid = fid2)"
    f", nm AS (SELECT fid1, fid2, log2((n + {DELTA}) / mean) AS mean, log2((n + {DELTA}) / (area * s / (SELECT sum(area) FROM ar))) AS area, log2((n + {DELTA}) / (a.m / p * (b.m / p) * s)) AS marginal FROM ar JOIN mg a ON a.fid = fid1 JOIN mg b ON b.fid = fid2 CROSS JOIN tt)"
)


def _chosen(k):
    """First centres c0 (cluster, c, v) of entries en (r, c, v)."""
    sql = ", ch1 AS (SELECT 0 AS cluster, r FROM (SELECT DISTINCT r FROM en) ORDER BY md5('s' || r), r LIMIT 1)"
    for i in range(1, k):
        sql += (
            f", dd{i} AS (SELECT r, min(d) AS d FROM (SELECT e.r, cluster, round(avg((e.v - s.v) ** 2), 9) AS d FROM en e JOIN (SELECT cluster, c, v FROM en JOIN ch{i} USING (r)) s USING (c) WHERE e.r NOT IN (SELECT r FROM ch{i}) GROUP BY ALL) GROUP BY ALL)"
            f", rk{i} AS (SELECT *, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM dd{i})"
            f", ch{i + 1} AS (SELECT * FROM ch{i} UNION ALL SELECT {i}, min(r) FROM rk{i} WHERE d = (SELECT d FROM rk{i} WHERE k = ceil({QUANTILE} * n)))"
        )
    return sql + f", c0 AS (SELECT cluster, c, v FROM en JOIN ch{k} USING (r))"


def _rounds(n):
    """Labels lb (r, cluster) after n rounds from c0."""
    sql = ""
    for i in range(n + 1):
        sql += f", as{i} AS (SELECT e.r, cluster, round(avg((e.v - s.v) ** 2), 9) AS d FROM en e JOIN c{i} s USING (c) GROUP BY ALL), lb{i} AS (SELECT r, cluster FROM as{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)"
        if i < n:
            sql += f", mv{i} AS (SELECT cluster, c, avg(v) AS m FROM en JOIN lb{i} USING (r) GROUP BY ALL), c{i + 1} AS (SELECT cluster, c, coalesce(m, v) AS v FROM c{i} FULL JOIN mv{i} USING (cluster, c))"
    return sql + f", lb AS (SELECT * FROM lb{n})"


_TREE = """, col AS (SELECT DISTINCT c FROM en), row_ AS (SELECT DISTINCT r FROM en),
wt AS (SELECT r, sum(c * v) AS x FROM en GROUP BY r), w(k, r, made, size, centre, lr, rr, h, x, ls) AS (
  SELECT 0, r, 0, 1::BIGINT, list(coalesce(v, 0) ORDER BY c), 0::BIGINT, 0::BIGINT, 0::DOUBLE, any_value(x), [r] FROM row_ CROSS JOIN col LEFT JOIN en USING (r, c) JOIN wt USING (r) GROUP BY r
  UNION ALL
  SELECT k, g, CASE WHEN two THEN k ELSE made END, size, CASE WHEN two THEN list_transform(list_zip(ca, cb), lambda z: (z[1] * na + z[2] * nb) / (na + nb)) ELSE ca END, CASE WHEN two THEN bl ELSE lr END, CASE WHEN two THEN br ELSE rr END, CASE WHEN two THEN sqrt(d) ELSE h END, x, CASE WHEN two THEN list_concat(la, lb) ELSE la END
  FROM (SELECT w.k + 1 AS k, CASE WHEN w.r IN (bl, br) THEN least(bl, br) ELSE w.r END AS g, count(*) = 2 AS two, max(made) AS made, sum(size)::BIGINT AS size, min_by(centre, w.r = br) AS ca, max_by(centre, w.r = br) AS cb, min_by(size, w.r = br) AS na, max_by(size, w.r = br) AS nb, any_value(bl) AS bl, any_value(br) AS br, any_value(lr) AS lr, any_value(rr) AS rr, any_value(h) AS h, any_value(d) AS d, sum(x) AS x, min_by(ls, (w.x / w.size, w.r = br)) AS la, max_by(ls, (w.x / w.size, w.r = br)) AS lb
        FROM w CROSS JOIN (SELECT a.r AS bl, b.r AS br, list_sum(list_transform(list_zip(a.centre, b.centre), lambda z: (z[1] - z[2]) ** 2)) * 2 * a.size * b.size / (a.size + b.size) AS d FROM w a JOIN w b ON a.made < b.made OR (a.made = b.made AND a.r < b.r) ORDER BY d, a.made, a.r LIMIT 1) p
        GROUP BY 1, 2))"""
_GRAPH = f""", oc AS (SELECT cell_id AS r, len(ltrim(CAST(CAST(start2 - start1 AS BIT) AS VARCHAR), '0')) AS c, count(*) AS n FROM contacts WHERE chrom1 = chrom2 AND start2 > start1 GROUP BY ALL),
col AS (SELECT DISTINCT c FROM oc), row_ AS (SELECT DISTINCT r FROM oc), fl AS (SELECT r, c, coalesce(n, 1)::DOUBLE AS n FROM row_ CROSS JOIN col LEFT JOIN oc USING (r, c)),
sh AS (SELECT r, c, n / sum(n) OVER (PARTITION BY r) AS p FROM fl),
ds AS (SELECT a.r AS i, b.r AS j, round(sum((a.p - b.p) * (ln(a.p) - ln(b.p))), 9) AS d FROM sh a JOIN sh b ON a.c = b.c AND a.r <> b.r GROUP BY ALL),
nr AS (SELECT i, j FROM ds QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= {NEAR}), eg AS (SELECT i, j FROM nr UNION SELECT j, i FROM nr),
dg AS (SELECT i, count(*) AS g FROM eg GROUP BY i), la AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN a.g WHEN eg.i IS NOT NULL THEN -1 ELSE 0 END::DOUBLE AS l FROM dg a CROSS JOIN dg b LEFT JOIN eg ON eg.i = a.i AND eg.j = b.i),
m1 AS (SELECT i, j, CASE WHEN i = j THEN 1 ELSE 0 END - l / (SELECT 2 * max(g) FROM dg) - 1.0::DOUBLE / (SELECT count(*) FROM dg) AS v FROM la)"""


def _leading(k):
    """Matrix m{k} squared 22 times: its leading vector v{k} (i, x), the Laplacian's value e{k} (e), and m{k + 1} without both."""
    return f""", s{k}(k, i, j, v) AS (SELECT 0, i, j, v FROM m{k} UNION ALL
  SELECT k, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (SELECT a.k + 1 AS k, a.i, b.j, sum(a.v * b.v) AS v FROM s{k} a JOIN s{k} b ON a.j = b.i WHERE a.k < 22 GROUP BY ALL)),
p{k} AS (SELECT i, j, v FROM s{k} WHERE k = 22), t{k} AS (SELECT i AS top, v AS big FROM p{k} WHERE i = j ORDER BY round(sqrt(v), 9) DESC, i LIMIT 1),
v{k} AS (SELECT i, v / sqrt(big) AS x FROM p{k} JOIN t{k} ON j = top), e{k} AS (SELECT sum(a.x * l * b.x) AS e FROM la JOIN v{k} a ON a.i = la.i JOIN v{k} b ON b.i = la.j),
m{k + 1} AS (SELECT m{k}.i, m{k}.j, v - (1 - e / (SELECT 2 * max(g) FROM dg)) * a.x * b.x AS v FROM m{k} JOIN v{k} a ON a.i = m{k}.i JOIN v{k} b ON b.i = m{k}.j CROSS JOIN e{k})"""


_P = PEAK
SQL = {
    "g32_projection": duckdb_sql(
        _GRAPH + _leading(1) + _leading(2) + " SELECT a.i AS cell_id, round(a.x, 6) AS axis1, round(b.x, 6) AS axis2, round(e1.e, 6) AS value1, round(e2.e, 6) AS value2 FROM v1 a JOIN v2 b USING (i) CROSS JOIN e1 CROSS JOIN e2", "contacts"
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "k10_ward": duckdb_sql(_PROFILES + _TREE + " SELECT lr AS left_row, rr AS right_row, round(h, 9) AS height, size, made, r AS row FROM w WHERE k > 0 AND made = k", "contacts").replace("WITH ", "WITH RECURSIVE ", 1),
    "k10_tree_order": duckdb_sql(_PROFILES + _TREE + " SELECT ls[i] AS cell_id, i - 1 AS place FROM (SELECT ls, unnest(range(1, size + 1)) AS i FROM w WHERE k = (SELECT max(k) FROM w))", "contacts").replace("WITH ", "WITH RECURSIVE ", 1),
    "g30_seeds": duckdb_sql(_PROFILES + _chosen(CELLS) + " SELECT cluster, c AS octave, round(v, 9) AS share FROM c0", "contacts"),
    "g29_profile_clusters": duckdb_sql(_PROFILES + _chosen(CELLS) + _rounds(ROUNDS) + " SELECT r AS cell_id, cluster FROM lb", "contacts"),
    "g14_normalised_pairs": duckdb_sql(_PAIRS + " SELECT * FROM nm", "contacts", "frags"),
    "g14_domain_clusters": duckdb_sql(_PAIRS + f", en AS (SELECT fid1 AS r, fid2 AS c, greatest(marginal, {TRIM}) AS v FROM nm)" + _chosen(DOMAINS) + _rounds(1) + " SELECT r AS fid, cluster FROM lb", "contacts", "frags"),
    "f14_peaks": duckdb_sql(
        f""", pp AS (SELECT cell_id AS key, c.chrom1 AS chrom, start1 AS pos, fid FROM contacts c JOIN frags f ON c.chrom1 = f.chrom AND start1 >= f.start AND start1 < f.end_ WHERE cell_id IN (SELECT cell_id FROM contacts c JOIN frags f ON c.chrom1 = f.chrom AND start1 >= f.start AND start1 < f.end_ GROUP BY cell_id HAVING count(*) >= {_P['least']})),
        b AS (SELECT key, chrom, CAST(ceil(pos / {_P['size']}) AS BIGINT) * {_P['size']} AS bin, count(*) AS n FROM pp GROUP BY ALL),
        m AS (SELECT key, chrom, median(n) AS med FROM b GROUP BY ALL),
        a AS (SELECT b.key, b.chrom, b.bin, b.n, (SELECT sum(o.n) FROM b o WHERE o.key = b.key AND o.chrom = b.chrom AND abs(o.bin - b.bin) <= {_P['width'] * _P['size']} AND o.bin <> b.bin) AS near, med FROM b JOIN m ON m.key = b.key AND m.chrom = b.chrom),
        cd AS (SELECT *, row_number() OVER (PARTITION BY key, chrom ORDER BY n DESC, bin) AS k FROM a WHERE n >= {_P['high']} * med AND coalesce(near, 0) / {2 * _P['width']} >= {_P['around']} * med),
        st AS (SELECT key, chrom, list(bin ORDER BY k) AS bins, list(n ORDER BY k) AS ns FROM cd GROUP BY ALL),
        kp AS (SELECT key, chrom, bins, ns, list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(bins, lambda x: [x])), lambda s, x: CASE WHEN len(list_filter(s[2:], lambda y: abs(y - x[1]) < {_P['distance']})) = 0 THEN list_concat(s, x) ELSE s END)[2:] AS kept FROM st),
        pk AS (SELECT key, chrom, unnest(kept) AS bin, ns, bins FROM kp),
        fr AS (SELECT pk.key, pk.chrom, bin, ns[list_position(bins, bin)] AS n, f.fid, f.start FROM pk LEFT JOIN frags f ON f.chrom = pk.chrom AND f.start >= bin - {_P['size']} AND f.end_ <= bin AND NOT EXISTS (SELECT 1 FROM pp WHERE pp.key = pk.key AND pp.fid = f.fid)),
        nn AS (SELECT *, row_number() OVER w AS i, count(fid) OVER (PARTITION BY key, chrom, bin) AS c FROM fr WINDOW w AS (PARTITION BY key, chrom, bin ORDER BY start, fid))
        SELECT key, chrom, bin AS "at", n, fid FROM nn WHERE i = greatest(round_even(c / 2, 0), 1)""",
        "contacts", "frags",
    ),
}
