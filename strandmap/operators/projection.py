"""Projection of profiles: a graph of nearest profiles by symmetrised divergence, and the lowest eigenvectors of its Laplacian.

Neighbours are sought block against block; a task returns k rows a profile, never all
pairs. Eigenvectors come from a block Krylov space that is built anew from the best
vectors so far until these are exact: a step is a join of edges with ``WIDTH`` numbers a
node, and what reaches the driver is the products of the vectors, at most
(1 + WIDTH * (STEPS + 1)) * WIDTH numbers, whatever the number of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.operators.lineage import cut
from strandmap.operators.trees import leaves

#: Profiles of a block; vectors that are sought together, and blocks of them beyond the first.
BLOCK, WIDTH, STEPS = 1024, 8, 8

#: W becomes (W - V C) T; V and W are what a row has, C and T small matrices.
Pass = tuple[np.ndarray, np.ndarray]


def shares(entries: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """row, share: the profile of each row of (row, col, v) over all columns that occur, ``pseudo`` in place of 0; shares sum to 1."""
    filled = F.transform("centre", lambda c: F.when(c == 0, F.lit(pseudo)).otherwise(c))
    rows = leaves(entries).select("row", filled.alias("_x"))
    total = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x)
    return rows.select("row", total.alias("_t"), "_x").select("row", F.transform("_x", lambda x: x / F.col("_t")).alias("share"))


def _nearest_of_block(k: int):
    def nearest(looking: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if looking.empty or others.empty:
            return pd.DataFrame(columns=["row", "to_row", "d"])
        others = others.sort_values("row")
        names, rows = others["row"].to_numpy(), looking["row"].to_numpy()
        p, q = np.stack(looking["share"].to_list()), np.stack(others["share"].to_list())
        lp, lq = np.log(p), np.log(q)
        d = (p * lp).sum(1)[:, None] + (q * lq).sum(1) - p @ lq.T - lp @ q.T
        d = np.where(rows[:, None] == names, np.inf, np.round(np.maximum(d, 0), 9))
        best = d.argsort(1, kind="stable")[:, :k]
        out = pd.DataFrame({"row": np.repeat(rows, best.shape[1]), "to_row": names[best].ravel(), "d": np.take_along_axis(d, best, 1).ravel()})
        return out[out["d"] < np.inf]

    return nearest


def nearest_profiles(profiles: DataFrame, k: int) -> DataFrame:
    """row, to_row, d, rank: the k other profiles (row, share) of the least symmetrised divergence, to nine places; ties to the smaller row."""
    profiles = cut(profiles.select("row", "share"))
    blocks = max(1, ceil(profiles.count() / BLOCK))
    at, every = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = [F.col(c).alias(c) for c in ("row", "share")]
    a = profiles.select(*own, at.cast("int").alias("_g"), every.alias("_h"))
    b = profiles.select(*own, every.alias("_g"), at.cast("int").alias("_h"))
    met = a.groupBy("_g", "_h").cogroup(b.groupBy("_g", "_h")).applyInPandas(_nearest_of_block(k), "row long, to_row long, d double")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("d", "to_row"))).where(F.col("rank") <= k)


def _after(v: np.ndarray, w: np.ndarray, passes: list[Pass]) -> np.ndarray:
    for c, t in passes:
        w = (w - v @ c) @ t
    return w


def _products(rows: DataFrame, passes: list[Pass], width: int) -> np.ndarray:
    """Products of all vectors v, and below them of w itself, with w after ``passes``."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                v, w = np.stack(batch["v"].to_list()), np.stack(batch["w"].to_list())
                w = _after(v, w, passes)
                part = np.concatenate([v, w], 1).T @ w
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size, dtype=np.int32), "x": total.ravel()})

    found = rows.select("v", "w").mapInPandas(summed, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    return np.array([r.x for r in sorted(found.collect())]).reshape(-1, width)


def _independent(rows: DataFrame, passes: list[Pass], width: int, floor: float) -> tuple[list[Pass], int, np.ndarray]:
    """Passes that make w orthonormal and orthogonal to v, how many columns are left of it, and products of w before it was scaled. Columns not longer than ``floor`` go."""
    before = None
    for _ in range(2):
        both = _products(rows, passes, width)
        c, g = both[:-width], both[-width:]
        before = g if before is None else before
        length = np.sqrt(np.maximum(np.diag(g - c.T @ c), 0))
        long = length > floor
        if not long.any():
            return passes, 0, before
        scaled = (g - c.T @ c)[np.ix_(long, long)] / np.outer(length[long], length[long])
        values, u = np.linalg.eigh(scaled)
        good = values > 1e-10
        t = np.zeros((width, int(good.sum())))
        t[long] = u[:, good] / np.sqrt(values[good]) / length[long][:, None]
        passes, width, floor = [*passes, (c, t)], t.shape[1], 0.1
    return passes, width, before


def _mapped(rows: DataFrame, change) -> DataFrame:
    """Rows (node, degree, v, w) with v as ``change(v, w)`` gives it."""

    def changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = change(np.stack(batch["v"].to_list()), np.stack(batch["w"].to_list()))
                yield pd.DataFrame({"node": batch["node"], "degree": batch["degree"], "v": list(v)})

    return rows.select("node", "degree", "v", "w").mapInPandas(changed, "node long, degree long, v array<double>")


def _applied(rows: DataFrame, edges: DataFrame, size: int, width: int) -> DataFrame:
    """Rows with w, the Laplacian times the last ``width`` vectors of v, written once; they are cached only while that is done."""
    last = [F.element_at("v", size - width + c + 1) for c in range(width)]
    sent = rows.select(F.col("node").alias("j"), *(x.alias(f"x{c}") for c, x in enumerate(last)))
    around = edges.join(sent, "j").groupBy(F.col("i").alias("node")).agg(*(F.sum(f"x{c}").alias(f"s{c}") for c in range(width)))
    found = rows.join(around, "node").select("node", "degree", "v", F.array(*(F.col("degree") * x - F.col(f"s{c}") for c, x in enumerate(last))).alias("w"))
    found = found.persist()
    written = cut(found)
    found.unpersist()
    return written


def embedding(edges: DataFrame, dims: int = 2, tolerance: float = 1e-10, rounds: int = 100, steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """Rows (node, vector) of the Laplacian's eigenvectors 1 .. dims, and their eigenvalues, in ascending order, of the graph of ``edges`` (i, j).

    Either direction and repeats of an edge count once, loops and nulls not at all. Vector
    0, the constant one, is left out; each vector has length 1 and its largest number, to
    nine places, is positive (of equally large ones that of the smaller node). There are
    at most n - 1 vectors. Eigenvalues that occur several times, as 0 does where the
    graph is in parts, have vectors that span their space, in no set order. It is an
    error if ``rounds`` do not reach ``tolerance`` times the largest degree.
    """
    if not 0 < dims <= WIDTH:
        raise ValueError(f"dims is from 1 to {WIDTH}")
    ways = edges.where("i <> j").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    ways = cut(ways.unionByName(ways.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    nodes = cut(ways.groupBy(F.col("i").alias("node")).agg(F.count("*").alias("degree")))
    n, most = nodes.agg(F.count("*"), F.max("degree")).first()
    empty = nodes.limit(0).select("node", F.array().cast("array<double>").alias("vector"))
    if n == 0:
        return empty, []
    width = min(WIDTH, n - 1)
    drawn = F.array(*(F.pmod(F.xxhash64("node", F.lit(c)), F.lit(1 << 40)) / float(1 << 40) - 0.5 for c in range(width)))
    rows = nodes.select("node", "degree", F.array(F.lit(n**-0.5)).alias("v"), drawn.alias("w"))
    passes, width, _ = _independent(rows, [], width, 0.0)
    rows = _mapped(cut(rows), lambda v, w, p=passes: np.concatenate([v, _after(v, w, p)], 1))
    kept = width
    for _ in range(rounds):
        size, width, sums = 1 + kept, kept, []
        for step in range(steps + 1):
            rows = _applied(rows, ways, size, width)
            c = _products(rows, [], width)[:-width]
            sums.append((size, width, c))
            passes, new, beyond = _independent(rows, [(c, np.eye(width))], width, 1e-13 * most)
            if step == steps or new == 0:
                break
            rows = _mapped(rows, lambda v, w, p=passes: np.concatenate([v, _after(v, w, p)], 1))
            size, width = size + new, new
        h = np.zeros((size, size))
        for m, p, c in sums:
            h[:m, m - p : m] = c
            h[m - p : m, :m] = c.T
        values, y = np.linalg.eigh(h[1:, 1:])
        values, y = values[:kept], y[:, :kept]
        left = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", y[-width:], beyond, y[-width:]), 0))
        rows = _mapped(rows, lambda v, w, y=y: np.concatenate([v[:, :1], v[:, 1:] @ y], 1))
        if (left[:dims] <= tolerance * most).all():
            break
    else:
        raise ValueError(f"eigenvectors are not exact after {rounds} rounds")
    found = min(dims, kept)
    at = [F.element_at("v", c + 2) for c in range(found)]
    signs = rows.agg(*(F.signum(F.max_by(x, F.struct(F.round(F.abs(x), 9), -F.col("node")))).alias(f"_s{c}") for c, x in enumerate(at)))  # one row
    signed = rows.crossJoin(F.broadcast(signs))
    return signed.select("node", F.array(*(x * F.col(f"_s{c}") for c, x in enumerate(at))).alias("vector")), values[:found].tolist()


def projected(entries: DataFrame, k: int = 7, dims: int = 2, pseudo: float = 1.0) -> tuple[DataFrame, list[float]]:
    """``embedding`` of the rows of (row, col, v): each is linked with its k nearest, and with those whose nearest it is among."""
    near = nearest_profiles(shares(entries, pseudo), k)
    return embedding(near.select(F.col("row").alias("i"), F.col("to_row").alias("j")), dims)
