"""Contacts around loops: pairs of a site F and a site R after it, ``band`` (from, to) bases apart.

Pairs are not made. Among sorted sites the partners of a site are a run, and runs move on with
the sites, so running sums over sites give the number of loops in any rectangle; a contact asks
for a few of them. The other way round, a contact adds to a rectangle of loops by marks at its
corners, which running sums in both directions spread. Contacts meet the sites of one cell at a
time (``meetings``). Sites: chrom, start, site_id, type. Rows that occur twice count twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import distance as D
from strandmap.operators import meetings as M

#: Cells of a table of sites by sites that is held at once, and of a part of it that is written at once.
DENSE, BLOCK = 1 << 24, 1 << 19


class Loops:
    """Loops among sorted places of F and R: R from number lo[i] to below hi[i] are the partners of F number i."""

    def __init__(self, f: np.ndarray, r: np.ndarray, band: tuple[int, int]):
        self.f, self.r = f, r
        self.lo = np.searchsorted(r, f + band[0], "left")
        self.hi = np.maximum(np.searchsorted(r, f + band[1], "right"), self.lo)
        edges = np.arange(len(r) + 1)
        self.full, self.begun = np.searchsorted(self.hi, edges, "right"), np.searchsorted(self.lo, edges, "left")
        self.starts = np.concatenate([[0], np.cumsum(self.lo)])
        self.ends = np.concatenate([[0], np.cumsum(self.hi)])

    def below(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Loops of the first ``a`` F with the first ``c`` R: runs that end there, and those that have begun cut off at c."""
        full, begun = np.minimum(a, self.full[c]), np.minimum(a, self.begun[c])
        return self.ends[full] + (begun - full) * c - self.starts[begun]


def _sites(sites: DataFrame, cell: int, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Sites of each type in the cells from low to high bases from them."""
    out = None
    for kind, (t, (low, high)) in enumerate(spans.items()):
        start = F.col("start")
        part = M.spread(sites.where((F.col("type") == t) & F.col("chrom").isNotNull()), start + low, start + high, cell)
        part = part.select(F.col("chrom").alias("_chrom"), M.CELL, F.lit(kind).alias(M.KIND), start.alias(M.AT), F.col("site_id").alias("_site"))
        out = part if out is None else out.unionByName(part)
    return out


def _near(contacts: DataFrame, band: tuple[int, int], reach: int, columns: list[str]) -> DataFrame:
    """Contacts within chromosomes that can have a loop within reach of both sides."""
    x, y = F.col("start1"), F.col("start2")
    return contacts.where(D.is_cis() & (y - x).between(band[0] - 2 * reach, band[1] + 2 * reach)).select(*columns, F.col("chrom1").alias("_chrom"), x.alias(M.AT), y.alias("_y"))


def _around(contacts: DataFrame, sites: DataFrame, band: tuple[int, int], reach: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Contacts in the cells of their first sides, and the sites of all loops within reach."""
    cell = max(2 * reach, band[1], 1)
    rows = _near(contacts, band, reach, columns)
    return rows.withColumn(M.CELL, F.floor(F.col(M.AT) / cell)), _sites(sites, cell, {"F": (-reach, reach), "R": (-reach - band[1], reach - band[0])})


def _places(places: pa.Table, kind: int) -> np.ndarray:
    return np.sort(M.of_kind(places, kind)[M.AT].to_numpy())


def _named(places: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and names of the sites of a kind in order, and how often each occurs."""
    rows = M.of_kind(places, kind)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both, n = np.unique(np.stack([rows[M.AT].to_numpy(), rows["_site"].to_numpy()]), axis=1, return_counts=True)
    return both[0], both[1], n


def _types(df: DataFrame, columns: list[str]) -> list[str]:
    types = dict(df.dtypes)
    return [f"`{c}` {types[c]}" for c in columns]


def quadrants(contacts: DataFrame, sites: DataFrame, band: tuple[int, int], reach: int, by: list[str]) -> DataFrame:
    """Contacts within reach of a loop's sides, a contact for each loop, by the columns ``by``: all (n), and those in the four corners.

    A contact level with a side is in both corners that meet there.
    """
    names = ["oo", "oi", "io", "ii", "n"]
    rows, held = _around(contacts, sites, band, reach, by)

    def read(key: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        loops = Loops(_places(places, 0), _places(places, 1), band)
        if not len(loops.f) or not len(loops.r):
            return
        for part in parts:
            edges = []
            for p, at in ((loops.f, part[M.AT].to_numpy()), (loops.r, part["_y"].to_numpy())):
                edges.append([np.searchsorted(p, at + d, s) for d, s in ((-reach, "left"), (0, "left"), (0, "right"), (reach, "right"))])
            sums = [[loops.below(a, c) for c in edges[1]] for a in edges[0]]
            box = lambda a, c: sums[a[1]][c[1]] - sums[a[0]][c[1]] - sums[a[1]][c[0]] + sums[a[0]][c[0]]
            up, down = (1, 3), (0, 2)  # sites at or past the contact, and at or before it
            found = [box(up, down), box(up, up), box(down, down), box(down, up), box((0, 3), (0, 3))]
            out = pa.Table.from_arrays([*(part[c] for c in by), *map(pa.array, found)], [*by, *names])
            out = out.filter(pa.array(found[-1] > 0)).group_by(by).aggregate([(n, "sum") for n in names])
            yield out.select([*by, *(f"{n}_sum" for n in names)]).rename_columns([*by, *names])

    parts = M.meet(rows, held, ["_chrom"], read, ", ".join([*_types(rows, by), *(f"{n} long" for n in names)]))
    return parts.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names))


def pile_up(contacts: DataFrame, sites: DataFrame, band: tuple[int, int], reach: int, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Contacts around all loops in bins x bins cells, and log2 over their mean; for each value of the columns ``by``."""
    keys = list(by)
    rows, held = _around(contacts, sites, band, reach, keys)
    edges = [-(-u * (2 * reach + 1) // bins) - reach for u in range(bins + 1)]  # least distances of the bins

    def read(key: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        loops = Loops(_places(places, 0), _places(places, 1), band)
        if not len(loops.f) or not len(loops.r):
            return
        for part in parts:
            codes = np.zeros(len(part), np.int64)
            for k in keys:
                named = part[k].dictionary_encode(null_encoding="encode")
                codes = codes * len(named.dictionary) + named.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.diff(codes[order], prepend=-1))
            a, c = (np.stack([np.searchsorted(p, at - e, "right") for e in edges]) for p, at in ((loops.f, part[M.AT].to_numpy()[order]), (loops.r, part["_y"].to_numpy()[order])))
            sums = np.stack([np.add.reduceat(loops.below(a, one), first, 1) for one in c], 1)  # by edge of x, edge of y and key
            n = sums[:-1, :-1] - sums[1:, :-1] - sums[:-1, 1:] + sums[1:, 1:]
            x, y, k = np.nonzero(n)
            own = pa.Table.from_batches([part.select(keys)]).take(pa.array(order[first][k])) if keys else pa.table({})
            yield pa.Table.from_arrays([*own.columns, pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(n[x, y, k])], [*keys, "x", "y", "n"])

    parts = M.meet(rows, held, ["_chrom"], read, ", ".join([*_types(rows, keys), "x int", "y int", "n long"]))
    out = parts.groupBy(*by, "x", "y").agg(F.sum("n").alias("n"))
    mean = F.sum("n").over(Window.partitionBy(*by)) / (bins * bins)  # bins x bins rows
    return out.select(*by, "x", "y", "n", F.log2(F.col("n") / mean).alias("enr"))


def counts(contacts: DataFrame, sites: DataFrame, band: tuple[int, int], inner: int, outer: int) -> DataFrame:
    """Loops (chrom, site1, start1, site2, start2) with contacts within +-outer of both sides: how many there are (n2), and within +-inner (n1)."""
    cell = max(2 * outer, band[1], 1)
    rows = M.spread(_near(contacts, band, outer, []), F.col(M.AT) - outer, F.col(M.AT) + outer, cell)
    held = _sites(sites, cell, {"F": (0, 0), "R": (-band[1], -band[0])})

    def read(key: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        f, site1, m1 = _named(places, 0)
        r, site2, m2 = _named(places, 1)
        loops = Loops(f, r, band)
        if not (loops.hi > loops.lo).any():
            return
        step = max(1, DENSE // (len(r) + 1))
        if step < len(f):
            parts = list(parts)  # read once for each slice of the table
        for low in range(0, len(f), step):
            high = min(low + step, len(f))
            tables = [np.zeros((high - low + 1, len(r) + 1), np.int32) for _ in range(2)]
            for part in parts:
                x, y = part[M.AT].to_numpy(), part["_y"].to_numpy()
                for table, d in zip(tables, (inner, outer), strict=True):
                    a, b = (np.clip(np.searchsorted(f, x + s, side), low, high) - low for s, side in ((-d, "left"), (d, "right")))
                    c, e = (np.searchsorted(r, y + s, side) for s, side in ((-d, "left"), (d, "right")))
                    for i, j, w in ((a, c, 1), (b, c, -1), (a, e, -1), (b, e, 1)):
                        np.add.at(table.ravel(), i * (len(r) + 1) + j, w)
            for table in tables:
                np.cumsum(table, 0, out=table)
                np.cumsum(table, 1, out=table)
            block = max(1, BLOCK // (len(r) + 1))
            for k in range(low, high, block):
                own = np.arange(k, min(k + block, high))
                number = np.arange(len(r))
                made = (number >= loops.lo[own, None]) & (number < loops.hi[own, None]) & (tables[1][own - low, :-1] > 0)
                i, j = np.nonzero(made)
                i += k
                m = m1[i] * m2[j]
                n1, n2 = (t[i - low, j] * m for t in tables)
                chrom = pa.array([key[0]] * 1, places["_chrom"].type).take(pa.array(np.zeros(len(i), np.int64)))
                yield pa.Table.from_arrays([chrom, *map(pa.array, (site1[i], f[i], site2[j], r[j], n1, n2))], ["chrom", "site1", "start1", "site2", "start2", "n1", "n2"])

    types = dict(held.dtypes)
    return M.meet(rows, held, ["_chrom"], read, f"chrom {types['_chrom']}, site1 long, start1 long, site2 long, start2 long, n1 long, n2 long")


def lonely(sites: DataFrame, band: tuple[int, int], reach: int) -> DataFrame:
    """Loops (chrom, site1, start1, site2, start2) without another one whose sides are both within reach of theirs.

    Of a site's run only the ends and partners that are far from their neighbours can be in one, and those are counted.
    """
    cell = max(2 * reach, band[1], 1)
    held = _sites(sites, cell, {"F": (-reach, reach), "R": (-reach - band[1], reach - band[0])})
    none = held.limit(0).select("_chrom", M.CELL, M.AT)

    def read(key: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        f, site1, m1 = _named(places, 0)
        r, site2, m2 = _named(places, 1)
        loops = Loops(f, r, band)
        own = np.flatnonzero((f // cell == key[1]) & (loops.hi > loops.lo))
        if not len(own):
            return
        gap = np.diff(r) > reach
        alone = np.flatnonzero(np.concatenate([[True], gap]) & np.concatenate([gap, [True]]))
        first, last = np.searchsorted(alone, loops.lo[own]), np.searchsorted(alone, loops.hi[own])
        n = last - first
        runs = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        i, j = np.unique(np.stack([np.concatenate([np.repeat(own, n), own, own]), np.concatenate([alone[runs], loops.lo[own], loops.hi[own] - 1])]), axis=1)
        a, b = (np.searchsorted(f, f[i] + d, s) for d, s in ((-reach, "left"), (reach, "right")))
        c, e = (np.searchsorted(r, r[j] + d, s) for d, s in ((-reach, "left"), (reach, "right")))
        single = loops.below(b, e) - loops.below(a, e) - loops.below(b, c) + loops.below(a, c) == 1
        i, j = i[single], j[single]
        i, j = (np.repeat(k, m1[i] * m2[j]) for k in (i, j))
        chrom = pa.array([key[0]], places["_chrom"].type).take(pa.array(np.zeros(len(i), np.int64)))
        yield pa.Table.from_arrays([chrom, *map(pa.array, (site1[i], f[i], site2[j], r[j]))], ["chrom", "site1", "start1", "site2", "start2"])

    types = dict(held.dtypes)
    return M.meet(none, held, ["_chrom"], read, f"chrom {types['_chrom']}, site1 long, start1 long, site2 long, start2 long")


class _Least:
    """The place of the least of ranks in any range, by minima of runs of powers of two."""

    def __init__(self, keys: list[np.ndarray], good: np.ndarray):
        self.order = np.lexsort(keys[::-1])
        rank = np.empty(len(good), np.int64)
        rank[self.order] = np.arange(len(good))
        self.none = len(good)
        self.levels = [np.where(good, rank, self.none)]
        while (w := 1 << len(self.levels)) <= len(good):
            before = self.levels[-1]
            self.levels.append(np.minimum(before[: len(good) - w + 1], before[w // 2 : len(good) - w // 2 + 1]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each a and b the place of the least of numbers a to below b; -1 without any."""
        out = np.full(len(a), self.none)
        power = np.full(len(a), -1)
        power[b > a] = np.frexp((b - a)[b > a].astype(float))[1] - 1
        for k, level in enumerate(self.levels):
            at = power == k
            out[at] = np.minimum(level[a[at]], level[b[at] - (1 << k)])
        return np.where(out == self.none, -1, np.append(self.order, -1)[out])


def nearest(contacts: DataFrame, sites: DataFrame, band: tuple[int, int], reach: int, columns: list[str]) -> DataFrame:
    """``columns`` of contacts with the nearest loop within reach of both sides (smallest |dx| + |dy|, then smaller site1 and site2): site1, site2, dx, dy; others go.

    Given one side, the best other one is next to the contact or at an end of the band, so a contact
    looks at a few loops: those of the R on either side of it, and the best of the F that reach past or short of it.
    """
    rows, held = _around(contacts, sites, band, reach, columns)
    low, high = band

    def read(key: tuple, places: pa.Table, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        sides = []
        for kind in (0, 1):
            at, name, n = _named(places, kind)
            one = np.concatenate([[True], np.diff(at) > 0])[: len(at)]  # of sites at one place the smaller name
            sides.append((at[one], name[one], n[one]))
        (f, site1, m1), (r, site2, m2) = sides
        loops = Loops(f, r, band)
        if not (loops.hi > loops.lo).any():
            return
        good = loops.hi > loops.lo
        near, far = np.minimum(loops.lo, len(r) - 1), np.maximum(loops.hi - 1, 0)  # ends of each run
        up_left = _Least([r[near] - f, site1, site2[near]], good)
        up_right = _Least([r[near] + f], good)
        down_right = _Least([f - r[far], site1, site2[far]], good)
        down_left = _Least([-(f + r[far])], good)
        for part in parts:
            x, y = part[M.AT].to_numpy(), part["_y"].to_numpy()
            of = lambda p, v, side: np.searchsorted(p, v, side)
            first, last = of(f, x - reach, "left"), of(f, x + reach, "right")
            pairs = []
            after = of(r, y, "left")
            for j in (after - 1, after):  # the R on either side, with the F next to the contact among its own
                held_j = (j >= 0) & (j < len(r))
                at = r[np.clip(j, 0, len(r) - 1)]
                a, b = of(f, at - high, "left"), of(f, at - low, "right")
                here = of(f, x, "left")
                for i in (here - 1, here):
                    pairs.append((np.clip(i, a, np.maximum(b - 1, a)), j, held_j & (b > a)))
            # F whose partners are all past y take the first, those whose are all before it the last
            a, b = np.maximum(first, of(f, y - low, "right")), np.minimum(last, of(r[near], y + reach, "right"))
            mid = np.clip(of(f, x, "right"), a, np.maximum(b, a))
            for least, i0, i1, partner in ((up_left, a, mid, near), (up_right, mid, b, near)):
                i = least(i0, i1)
                pairs.append((i, partner[i], i >= 0))
            a, b = np.maximum(first, of(r[far], y - reach, "left")), np.minimum(last, of(f, y - high, "left"))
            mid = np.clip(of(f, x, "left"), a, np.maximum(b, a))
            for least, i0, i1, partner in ((down_left, a, mid, far), (down_right, mid, b, far)):
                i = least(i0, i1)
                pairs.append((i, partner[i], i >= 0))
            i, j, held_ij = (np.stack(v) for v in zip(*pairs, strict=True))
            i, j = np.clip(i, 0, len(f) - 1), np.clip(j, 0, len(r) - 1)
            dx, dy = x - f[i], y - r[j]
            held_ij = held_ij & (np.abs(dx) <= reach) & (np.abs(dy) <= reach)
            cost = np.where(held_ij, np.abs(dx) + np.abs(dy), np.iinfo(np.int64).max)
            best = np.lexsort((site2[j], site1[i], cost), axis=0)[0]
            k = np.arange(len(x))
            found = held_ij[best, k]
            i, j, dx, dy = (v[best, k][found] for v in (i, j, dx, dy))
            m = m1[i] * m2[j]
            own = pa.Table.from_batches([part.select(columns)]).take(pa.array(np.repeat(k[found], m))) if columns else pa.table({})
            yield pa.Table.from_arrays([*own.columns, *(pa.array(np.repeat(v, m)) for v in (site1[i], site2[j], dx, dy))], [*columns, "site1", "site2", "dx", "dy"])

    return M.meet(rows, held, ["_chrom"], read, ", ".join([*_types(rows, columns), "site1 long", "site2 long", "dx long", "dy long"]))


def enrichment(counted: DataFrame, inner: int, outer: int, floor: float = -1.0) -> DataFrame:
    """Counted loops (see ``counts``) with enr: log2 of n1 over n2, against the areas' ratio, not below ``floor``."""
    return counted.withColumn("enr", F.when(F.col("n1") > 0, F.greatest(F.log2(F.col("n1") / F.col("n2") / (inner / outer) ** 2), F.lit(floor))).otherwise(F.lit(floor)))


def shares(near: DataFrame, by: list[str]) -> DataFrame:
    """Rows with dx and dy by the columns ``by``: all (n), and those in the four corners, as in ``quadrants``."""
    corners: dict[str, Column] = {"oo": (F.col("dx") <= 0) & (F.col("dy") >= 0), "oi": (F.col("dx") <= 0) & (F.col("dy") <= 0), "io": (F.col("dx") >= 0) & (F.col("dy") >= 0), "ii": (F.col("dx") >= 0) & (F.col("dy") <= 0)}
    return near.groupBy(*by).agg(*(F.count_if(v).alias(k) for k, v in corners.items()), F.count("*").alias("n"))
