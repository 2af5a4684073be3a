"""Cutting the lineage of tables that several parts of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; on one machine, where that is unset, its temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below ``shared_root``."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once below ``shared_root``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
