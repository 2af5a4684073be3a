"""Operator 5, exact top-k inner products by distributed histogram selection.

Vectors become whole numbers, floor(scale * x), and are packed into blocks. Query
vectors are gathered from the blocks into groups; every group meets every block
once a round and scores it in one matrix product. A round lays each query's
scores above its block's own kth into ``BINS`` equal bins, sums the histograms
over all blocks, and keeps the bin in which the kth score lies; bins get
narrower until they hold one score or few rows. A last pass keeps the rows at or
above that bin, of equal scores at the kth place the k smallest ids a block, and
ranks them by score, then id.

Vectors that are null, empty, or hold null or non-finite components, and rows
with a null id take no part. A vector is scored against those of its length. A
row is a candidate for every query but itself, so rows that share an id score
each other. Scores must lie within 64 bits; products are exact beyond 2^53 too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.shared import partitions, shared_table

BLOCK, GROUP, BINS, FEW = 4096, 1024, 1024, 64


def whole_numbers(rows: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(rows.astype(np.float64) * scale)


def _blocks(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """block, dim, ids, data (float64 rows), top (largest size of a component)."""
    from pyspark import TaskContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows: dict[int, int] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            rows.pop(dim)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([float(np.abs(data).max(initial=0))])], ["block", "dim", "ids", "data", "top"])

        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.asarray(column.value_lengths())
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                data = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                good = np.isfinite(data).all(1)
                for low in range(0, int(good.sum()), BLOCK):
                    held.setdefault(dim, []).append((ids[at][good][low : low + BLOCK], whole_numbers(data[good][low : low + BLOCK], scale)))
                    rows[dim] = rows.get(dim, 0) + len(held[dim][-1][0])
                    if rows[dim] >= BLOCK:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(pack, "block long, dim int, ids binary, data binary, top double")


def _matrix(data: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(data.as_py(), np.float64).reshape(-1, dim)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    return (np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(b).T).astype(np.int64)


_QUERIES = "query_block long, dim int, ids binary, block_of binary, row_of binary, data binary"


def _queries(blocks: DataFrame, every: int) -> DataFrame:
    """Groups of query vectors (ids divisible by ``every``) with the blocks and rows that they are."""
    names = [x.split()[0] for x in _QUERIES.split(", ")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                dim = batch.column("dim")[k].as_py()
                ids = np.frombuffer(batch.column("ids")[k].as_py(), np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    block = batch.column("block")[k].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[at], np.full(len(at), block), at, _matrix(batch.column("data")[k], dim)[at]))], names)

    def gather(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for k in range(0, table.num_rows, max(1, GROUP // 82)):
            part = table.slice(k, max(1, GROUP // 82))
            out.append((part["query_block"][0].as_py(), part["dim"][0].as_py(), *(b"".join(x.as_py() for x in part[c]) for c in names[2:])))
        kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    picked = blocks.mapInArrow(pick, _QUERIES)
    # a group of about 16 blocks' queries; blocks are numbered within partitions
    near = F.pmod(F.xxhash64("query_block"), F.lit(max(1, partitions(blocks.sparkSession))))
    return picked.withColumn("near", near).groupBy("near", "dim").applyInArrow(lambda t: gather(t.sort_by("query_block")), _QUERIES)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's kth largest score, or the least there can be."""
    if scores.shape[1] <= k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


_NONE = np.iinfo(np.int64).min


def _locator(wide: int, k: int, span: int) -> Callable[[pa.Table], pa.Table]:
    """From a group's histograms the bin of each query's kth score: low (its first and past-the-last score), most (rows at or above it)."""

    def locate(table: pa.Table) -> pa.Table:
        low, n = table["low"][0].as_py(), table["size"][0].as_py()
        rows = sorted((x["query"], -x["bin"], x["n"]) for x in table["cells"][0].as_py())
        base = np.full(n, -span) if low is None else np.frombuffer(low, np.int64).reshape(-1, 2)[:, 0]
        out, sums, done = np.stack([base, base + wide], 1), np.zeros(n, np.int64), np.zeros(n, bool)
        for q, b, c in rows:
            if not done[q]:
                sums[q] += c
                first = base[q] + -b * wide
                out[q] = first, first + wide
                done[q] = sums[q] >= k
        return pa.table([table["query_block"], table["dim"], pa.array([out.astype(np.int64).tobytes()], pa.binary()), pa.array([int(sums.max(initial=0))])], ["query_block", "dim", "low", "most"])

    return locate


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows, fewer if there are fewer."""
    spark = vectors.sparkSession
    blocks = shared_table(_blocks(vectors, scale, id_col, vector_col), "blocks")
    queries = shared_table(_queries(blocks, every), "queries")
    limits = blocks.groupBy("dim").agg(F.max("top").alias("top"), F.count("*").alias("n")).collect()  # a row a vector length
    span = max([int(r.dim * (r.top + 1) ** 2) + 1 for r in limits], default=1)
    salts = max(1, min(partitions(spark), sum(r.n for r in limits)))
    dealt = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    spread = queries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).withColumnRenamed("ids", "query_ids").withColumnRenamed("data", "query_data")
    width = max(1, -(-2 * span // BINS))
    state = queries.select("query_block", "dim", F.lit(None).cast("binary").alias("low"))

    def meetings(now: DataFrame) -> DataFrame:
        return dealt.join(spread.join(now, ["query_block", "dim"]), ["salt", "dim"]).select("query_block", "dim", "query_ids", "block_of", "row_of", "query_data", "low", "block", "ids", "data")

    def scores(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        dim = batch.column("dim")[i].as_py()
        q = _matrix(batch.column("query_data")[i], dim)
        got = _product(q, _matrix(batch.column("data")[i], dim))
        block, of, row = batch.column("block")[i].as_py(), np.frombuffer(batch.column("block_of")[i].as_py(), np.int64), np.frombuffer(batch.column("row_of")[i].as_py(), np.int64)
        own = np.flatnonzero(of == block)
        got[own, row[own]] = _NONE
        low = batch.column("low")[i].as_py()
        return got, np.frombuffer(batch.column("query_ids")[i].as_py(), np.int64), np.frombuffer(batch.column("ids")[i].as_py(), np.int64), None if low is None else np.frombuffer(low, np.int64).reshape(-1, 2)

    while True:
        wide = width

        def count(batches: Iterator[pa.RecordBatch], wide: int = wide) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    got, _, _, known = scores(batch, i)
                    base = np.full(len(got), -span) if known is None else known[:, 0]
                    past = np.full(len(got), 2 * span) if known is None else known[:, 1]
                    floor = base + (np.clip(_top(got, k), base, past) - base) // wide * wide
                    r, c = np.nonzero((got >= floor[:, None]) & (got != _NONE))
                    bin_ = np.minimum((got[r, c] - base[r]) // wide, BINS)  # BINS: above all bins
                    cell, n = np.unique(r * (BINS + 1) + bin_, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), batch.column("query_block")[i].as_py())), pa.array(np.full(len(cell), batch.column("dim")[i].as_py()), pa.int32()), pa.array(cell // (BINS + 1)), pa.array(cell % (BINS + 1)), pa.array(n.astype(np.int64))], ["query_block", "dim", "query", "bin", "n"])

        cells = meetings(state).mapInArrow(count, "query_block long, dim int, query long, bin long, n long").groupBy("query_block", "dim", "query", "bin").agg(F.sum("n").alias("n"))
        cells = cells.groupBy("query_block", "dim").agg(F.collect_list(F.struct("query", "bin", "n")).alias("cells"))
        sizes = queries.select("query_block", "dim", (F.octet_length("ids") / 8).cast("int").alias("size"))
        located = state.join(sizes, ["query_block", "dim"]).join(cells, ["query_block", "dim"], "left").withColumn("cells", F.coalesce("cells", F.expr("cast(array() as array<struct<query:long,bin:long,n:long>>)")))
        found = shared_table(located.groupBy("query_block", "dim").applyInArrow(_locator(width, k, span), "query_block long, dim int, low binary, most long"), "histograms")
        state = found.select("query_block", "dim", "low")
        if width == 1 or (found.agg(F.max("most")).first()[0] or 0) <= FEW:
            break
        width = -(-width // BINS)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                got, query, ids, low = scores(batch, i)
                least = np.maximum(low[:, 0], _top(got, k))  # no row below its block's own kth is among the k best
                r, c = np.nonzero((got >= least[:, None]) & (got != _NONE))
                order = np.lexsort([ids[c], -got[r, c], r])
                r, c = r[order], c[order]
                first = np.searchsorted(r, r)
                best = np.arange(len(r)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(int(best.sum()), batch.column("query_block")[i].as_py()), r[best], query[r[best]], ids[c[best]], got[r[best], c[best]])], ["query_block", "query", "query_id", "vec_id", "score"])

    rows = meetings(state).mapInArrow(keep, "query_block long, query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_block", "query").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
