"""Tables of pairs of fragment ends on disk: sorted files with an index of their keys, published in one step.

A version is written beside the published one: data files cut by ranges of (fend1,
fend2) and sorted, then an index of a row a file. Nothing of it can be read until its
name is put into the file ``CURRENT``, which one rename replaces, so readers see the
old version or the new one, whole, whatever fails in between. Readers by key open only
the files whose range of keys the index says may hold it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("fend1", "fend2")


def merged(pairs: DataFrame, count: str = "mol") -> DataFrame:
    """fend1 <= fend2 and ``count``: (a, b) and (b, a) together."""
    return pairs.groupBy(F.least("fend1", "fend2").alias("fend1"), F.greatest("fend1", "fend2").alias("fend2")).agg(F.sum(count).alias("count"))


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Put the version's name into CURRENT: written aside, then renamed over the old one."""
    jvm = spark.sparkContext._jvm
    aside, store = _store(spark, f"{path}/.CURRENT-{version}")
    out = store.create(aside)
    out.write(version.encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    current = _store(spark, f"{path}/CURRENT")[0]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, current, options)


def current(spark: SparkSession, path: str) -> str | None:
    """Name of the published version, None where there is none."""
    where, store = _store(spark, f"{path}/CURRENT")
    if not store.exists(where):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def write_pairs(pairs: DataFrame, path: str, files: int | None = None) -> str:
    """Publish ``pairs`` (fend1, fend2, further columns) below ``path``; the version's name. Null ends are refused."""
    spark = pairs.sparkSession
    version = uuid.uuid4().hex
    checked = pairs.withColumns({k: F.when(F.col(k).isNotNull(), F.col(k)).otherwise(F.raise_error(f"{k} is null")) for k in KEYS})
    cut = [files, *KEYS] if files else list(KEYS)
    checked.repartitionByRange(*cut).sortWithinPartitions(*KEYS).write.parquet(f"{path}/data-{version}")
    data = spark.read.schema(pairs.schema).parquet(f"{path}/data-{version}")
    key = F.struct(*KEYS)
    index = data.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
    index.withColumn("file", F.substring_index("file", "/", -1)).coalesce(1).write.parquet(f"{path}/index-{version}")
    data.limit(0).write.parquet(f"{path}/schema-{version}")
    _publish(spark, path, version)
    return version


def read_pairs(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The published pairs, of those with low <= fend1 < high where given; only files that may hold some are opened."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no published table in {path}")
    schema = spark.read.parquet(f"{path}/schema-{version}").schema
    keep: Column = F.lit(True)
    files = spark.read.parquet(f"{path}/index-{version}")
    if low is not None:
        files, keep = files.where(F.col("last.fend1") >= low), keep & (F.col("fend1") >= low)
    if high is not None:
        files, keep = files.where(F.col("first.fend1") < high), keep & (F.col("fend1") < high)
    names = [f"{path}/data-{version}/{r.file}" for r in files.select("file").collect()]  # a row a file
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*names).where(keep)


def drop_old(spark: SparkSession, path: str) -> None:
    """Delete all versions but the published one, once no reader holds them."""
    kept = current(spark, path)
    where, store = _store(spark, path)
    for status in store.listStatus(where):
        name = status.getPath().getName()
        if "-" in name and name.rsplit("-", 1)[1] != kept:
            store.delete(status.getPath(), True)
