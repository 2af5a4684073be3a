"""Contacts that arrive as files, added to per-cell decay counts; sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmap.operators.contacts import fine_decay

SCHEMA = "cell_id long, chrom1 long, start1 long, chrom2 long, start2 long, cnt long"


def contact_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's decay counts into its own folder; a batch that runs again replaces it, so each contact counts once."""

    def add(batch: DataFrame, number: int) -> None:
        fine_decay(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("cell_id", "bin").agg(F.sum("n").alias("n"))
