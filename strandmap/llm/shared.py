"""What the operators of this subpackage share.

Every operator projects the columns it needs before anything else, so further
columns of its input never clash with its own. A null text counts as an empty
text unless an operator says otherwise; a null id is kept as a null id.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on at once.
STEP_BYTES = (1 << 20) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors reach; on one machine, where that is unset, below its temporary folder.

    On a cluster an unset spark.checkpoint.dir is an error: each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go when it is whole, and Python gets texts in small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{label}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Delete tables that ``shared_table`` wrote, once what was made of them is written in its turn."""
    for t in tables:
        context = t.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def tidied(result: Any = None) -> Any:
    """``result``, after memory that numpy and Arrow keep for later has gone back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
    return result


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if column.null_count:
        valid = np.asarray(column.is_valid())
        lengths = np.diff(off)
        if lengths[~valid].any():
            raw = raw[np.repeat(valid, lengths)]
        off = np.concatenate([[0], np.cumsum(np.where(valid, lengths, 0))])
    return raw, off


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers start .. start + length - 1 of every pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the public murmur3 finalizer)."""
    a, b, s = _MIX
    x = (x ^ (x >> s)) * a
    x = (x ^ (x >> s)) * b
    return x ^ (x >> s)


#: Bits of a table of ids; it filters less the more ids there are, and never loses one.
ID_BITS = 1 << 26


def id_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ID_BITS))


def id_table(ids: DataFrame, column: str) -> Broadcast:
    """A table of bits (8 MB) in which the bits of all ids are set, on all executors; see ``id_bit``."""
    return _bit_table(ids.select((id_bit(column) + 1).alias("bit")))


def _bit_table(bit: DataFrame) -> Broadcast:
    spark = bit.sparkSession  # which counts bits from 1
    words = bit.groupBy(F.expr("bitmap_bucket_number(bit)").alias("word")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()
    bits = np.zeros(ID_BITS // 8, np.uint8)  # 2048 pieces of 4096 bytes at most
    for r in words:
        bits[(r.word - 1) * 4096 : r.word * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return spark.sparkContext.broadcast(bits)


def key_table(keys: DataFrame, column: str) -> Broadcast:
    """The same of values that are hashes themselves: the bits of their lowest digits."""
    return _bit_table(keys.select((F.col(column).bitwiseAND(F.lit(ID_BITS - 1)) + 1).alias("bit")))


def in_table(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bits[positions >> 3] >> (positions & 7).astype(np.uint8) & 1).astype(bool)
