"""Chains of reads from alignments that arrive bit by bit: the segments of a read may come in several micro-batches.

State holds the open reads' segments, a list for each read, and a timer. A read is
closed, resolved as in batch and its state dropped, once the watermark has passed its
last segment by ``gap``; a later segment of it moves the timer on. The watermark trails
the newest segment by ``late``. Segments older than the watermark are dropped by the
engine, and a segment that arrives for a read already closed opens it anew, so ``late``
must cover the disorder of the input and ``gap`` the pause within a read. What is open
when the input ends stays in the state for the next run; a restart from the same
checkpoint goes on where the last batch was committed, each chain written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strandmap.operators.chains import CHAIN, resolve_read, usable_segments
from strandmap.sources.files import sam_fields

_HIT = "mate int, seg int, rfr int, rto int, chrom string, pos bigint, strand string, qual int, `end` bigint"
_NAMES = ("mate", "seg", "rfr", "rto", "chrom", "pos", "strand", "qual", "end")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _OpenReads(StatefulProcessor):
    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", _HIT)
        self.until = handle.getValueState("until", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self.until.get()[0] if self.until.exists() else None
        newest = last
        for frame in rows:
            self.hits.appendList([tuple(int(v) if c not in ("chrom", "strand") else v for c, v in zip(_NAMES, row, strict=True)) for row in frame[list(_NAMES)].itertuples(index=False)])
            end = int(frame["seen"].max().timestamp() * 1000) + self.gap
            newest = end if newest is None else max(newest, end)
        if newest != last:
            if last is not None:
                self.handle.deleteTimer(last)
            self.handle.registerTimer(newest)
            self.until.update((newest,))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        hits = [dict(zip(_NAMES, h, strict=True)) for h in self.hits.get()]
        self.hits.clear()
        self.until.clear()
        own = [[{k: v for k, v in h.items() if k not in ("mate", "seg")} for h in sorted(hits, key=lambda h: h["seg"]) if h["mate"] == m] for m in (1, 2)]
        chain, err = resolve_read(*own)
        yield pd.DataFrame({"read_id": [key[0]], "hits": [[{k: h[k] for k in _NAMES[2:]} for h in chain]], "err": [err]})

    def close(self) -> None:
        pass


def segment_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """SAM rows of files that appear in a folder, ``seen`` at their file's time."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder).select("value", F.col("_metadata.file_modification_time").alias("seen"))
    return sam_fields(lines, "seen")


def chain_stream(segments: DataFrame, gap: str = "60 seconds", late: str = "60 seconds", min_qual: int = 36, min_len: int = 20) -> DataFrame:
    """Chains (read_id, hits, err) of a stream of SAM rows with ``seen``; counts of rows and usable ones are observed as ``segments``."""
    counted = segments.observe("segments", F.count("*").alias("rows"), F.count_if((F.col("flag") != 4) & (F.col("mapq") > min_qual) & (F.col("len") >= min_len)).alias("usable"))
    rows = usable_segments(counted, min_qual, min_len).select("read_id", *(F.col(c).cast("int").alias(c) for c in ("mate", "seg", "rfr", "rto")), "chrom", F.col("pos").cast("long").alias("pos"), "strand", F.col("mapq").cast("int").alias("qual"), F.col("end").cast("long").alias("end"), "seen")
    milliseconds = int(pd.Timedelta(gap).total_seconds() * 1000)
    return rows.withWatermark("seen", late).groupBy("read_id").transformWithStateInPandas(_OpenReads(milliseconds), CHAIN, "Append", "EventTime")


def start(chains: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write all chains that can be closed now below ``out``, and stop."""
    spark = chains.sparkSession
    before = spark.conf.get(_PROVIDER)
    try:
        spark.conf.set(_PROVIDER, ROCKS)  # lists and timers need it
        return chains.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
