"""Queries over the plane of contacts: areas of rectangles, scores of neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap.operators import areas as AR
from strandmap.operators import neighbour_score as NS
from strandmap.plans.fixtures import duckdb_sql, view

SCALE, GAP, NEAR = 300_000, 1000, 1000
SHIFTS = {"a": (-SCALE, 0, 0, SCALE), "b1": (-SCALE, -GAP, -SCALE, -GAP), "b2": (GAP, SCALE, GAP, SCALE)}


def _over(f, *views):
    return lambda spark, sf: f(*(view(spark, sf, v) for v in views))


def _loci(frags):
    return frags.select("chrom", F.col("start").alias("at"))


def _group_areas(contacts, cells, frags):
    groups = cells.select("cell_id", F.col("cond").alias("grp"))
    names = groups.select("grp").distinct()  # a row a group
    return AR.shifted_areas(contacts.join(groups, "cell_id"), _loci(frags).crossJoin(F.broadcast(names)), SHIFTS, (NEAR, 2 * SCALE), weight=F.col("cnt"), by=("grp",))


#: Bases of a bin, and neighbours of the scores: whole maps in bins.
BIN, K = 4_000_000, 20


def _binned(points):
    return points.select("chrom", F.floor(F.col("x") / BIN).alias("x"), F.floor(F.col("y") / BIN).alias("y"))


def _seen(contacts):
    return contacts.where("chrom1 = chrom2 and start2 >= start1").select(F.col("chrom1").alias("chrom"), F.col("start1").alias("x"), F.col("start2").alias("y"))


QUERIES = {
    "f77_shifted_areas": _over(lambda c, f: AR.shifted_areas(c, _loci(f), SHIFTS, (NEAR, 2 * SCALE)), "contacts", "frags"),
    "f77_group_areas": _over(_group_areas, "contacts", "cells", "frags"),
    "l49_neighbour_scores": _over(lambda c: NS.neighbour_scores(_binned(_seen(c)), _binned(NS.shuffled_distances(c, "s")), K, 7), "contacts"),
    "p65_shuffled_distances": _over(lambda c: _binned(NS.shuffled_distances(c, "s")).groupBy("chrom", "x", "y").agg(F.count("*").alias("n")), "contacts"),
}

_SHUFFLED = (
    ", ci AS (SELECT chrom1 AS chrom, start1 AS x, start2 - start1 AS d, row_number() OVER (PARTITION BY chrom1, start1, start2) AS i FROM contacts WHERE chrom1 = chrom2 AND start2 >= start1)"
    ", nm AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY md5('sa:' || chrom || ':' || x || ':' || d || ':' || i)) AS p, row_number() OVER (PARTITION BY chrom ORDER BY md5('sb:' || chrom || ':' || x || ':' || d || ':' || i)) AS q FROM ci)"
    ", sh AS (SELECT f.chrom, f.x, f.x + s.d AS y FROM nm f JOIN nm s ON f.chrom = s.chrom AND f.p = s.q)"
)
_BOX = {n: f"start1 >= lo.at + {s[0]} AND start1 < lo.at + {1 + s[1]} AND start2 >= lo.at + {s[2]} AND start2 < lo.at + {1 + s[3]}" for n, s in SHIFTS.items()}
_KEPT = f"chrom1 = chrom2 AND start2 - start1 >= {NEAR} AND start2 - start1 < {2 * SCALE}"
_AT = ", lo AS (SELECT DISTINCT chrom, start AS at FROM frags)"
SQL = {
    "f77_shifted_areas": duckdb_sql(
        f"{_AT}, k AS (SELECT chrom1, start1, start2 FROM contacts WHERE {_KEPT}) SELECT chrom, lo.at, " + ", ".join(f"count(*) FILTER ({b}) AS {n}" for n, b in _BOX.items()) + f" FROM lo LEFT JOIN k ON chrom1 = chrom AND start1 >= lo.at - {SCALE} AND start2 <= lo.at + {SCALE} GROUP BY ALL",
        "contacts", "frags",
    ),
    "f77_group_areas": duckdb_sql(
        f"{_AT}, gs AS (SELECT DISTINCT cond AS grp FROM cells), k AS (SELECT cond, chrom1, start1, start2, cnt FROM contacts JOIN cells USING (cell_id) WHERE {_KEPT}) SELECT grp, chrom, lo.at, " + ", ".join(f"coalesce(sum(cnt) FILTER ({b}), 0)::BIGINT AS {n}" for n, b in _BOX.items()) + f" FROM lo CROSS JOIN gs LEFT JOIN k ON cond = grp AND chrom1 = chrom AND start1 >= lo.at - {SCALE} AND start2 <= lo.at + {SCALE} GROUP BY ALL",
        "contacts", "cells", "frags",
    ),
    "l49_neighbour_scores": duckdb_sql(
        _SHUFFLED + f""", o AS (SELECT chrom1 AS chrom, start1 // {BIN} AS x, start2 // {BIN} AS y, count(*) AS n FROM contacts WHERE chrom1 = chrom2 AND start2 >= start1 GROUP BY ALL),
        e AS (SELECT chrom, x // {BIN} AS x, y // {BIN} AS y, count(*) AS n FROM sh GROUP BY ALL),
        enough AS (SELECT chrom FROM o GROUP BY chrom HAVING sum(n) > {K}),
        pt AS (SELECT chrom, x, y, sum(s)::BIGINT AS s, sum(m)::BIGINT AS m FROM (SELECT chrom, x, y, n AS s, 0 AS m FROM o UNION ALL SELECT chrom, x, y, 0, n FROM e) GROUP BY ALL),
        pr AS (SELECT o.chrom, o.x, o.y, any_value(o.n) AS n, (o.x - p.x) ** 2 + (o.y - p.y) ** 2 AS d, sum(p.s) AS s, sum(p.m) AS m FROM o JOIN enough USING (chrom) JOIN pt p ON p.chrom = o.chrom GROUP BY ALL),
        cu AS (SELECT *, sum(s) OVER w - 1 AS a, sum(m) OVER w AS b FROM pr WINDOW w AS (PARTITION BY chrom, x, y ORDER BY d ROWS UNBOUNDED PRECEDING)),
        gp AS (SELECT chrom, x, y, any_value(n) AS n, min(d) FILTER (a >= {K}) AS observed_kth, min(d) FILTER (b >= {K}) AS expected_kth, max(least(a, {K}) - least(b, {K})) AS up, min(least(a, {K}) - least(b, {K})) AS down FROM cu GROUP BY ALL)
        SELECT chrom, x, y, n, observed_kth::BIGINT AS observed_kth, expected_kth::BIGINT AS expected_kth, CASE WHEN up >= -down THEN up ELSE down END * 100.0::DOUBLE / {K} AS score FROM gp""",
        "contacts",
    ),
    "p65_shuffled_distances": duckdb_sql(_SHUFFLED + f" SELECT chrom, x // {BIN} AS x, y // {BIN} AS y, count(*) AS n FROM sh GROUP BY ALL", "contacts"),
}
