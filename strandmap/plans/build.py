"""All tables of a set of cells as one composition, kept as Parquet and built again only where missing or asked for."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.operators import chains as CH
from strandmap.operators import contacts as C
from strandmap.operators import maps as MA
from strandmap.operators import reports as R
from strandmap.operators.digest import fends
from strandmap.sources.files import contacts_of, read_sam


def contacts_from_sam(spark: SparkSession, path: str | list[str], frags: DataFrame, min_qual: int = 36, min_len: int = 20, switch_ratio: float = 0.0) -> DataFrame:
    """Alignments of one library as contacts: usable segments, chains of fragments, molecules, pairs of ends with their places.

    frags: fid, chrom (text, as in the alignments), start, end_. Reads without two fragments give none.
    """
    segments = CH.usable_segments(read_sam(spark, path), min_qual, min_len)
    hits = CH.fragment_hits(CH.chains(segments), frags).where("fid is not null")
    pairs = CH.fend_pairs(CH.molecules(CH.fendchains(hits)), switch_ratio)
    return contacts_of(pairs, fends(frags).withColumnRenamed("chrom", "chr"))


def tables(contacts: DataFrame, tor: DataFrame, cells: DataFrame, bands: dict[str, tuple[int, int]], scale: int = 2_000_000, res: int = 500_000) -> dict[str, Callable[[], DataFrame]]:
    """What is built from contacts, by name; each is planned only when called."""
    groups = cells.select("cell_id", F.col("cond").alias("grp"))
    return {
        "coarse_decay": lambda: C.coarse_decay(contacts),
        "fine_decay": lambda: C.fine_decay(contacts),
        "replication": lambda: C.replication_shares(C.replication_counts(contacts, tor)),
        "karyotype": lambda: R.karyotype(contacts),
        "early_coverage": lambda: R.early_coverage(contacts, tor, 100_000, 0.0),
        "pooled": lambda: C.canonical(contacts),
        "insulation": lambda: MA.insulation(contacts, scale, res),
        "group_insulation": lambda: MA.insulation(contacts.join(groups, "cell_id"), scale, res, by=("grp",)),
        "cell_stats": lambda: R.cell_stats(contacts, cells, bands, "mid", 0.19),
    }


def load(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A kept table, or None where there is none; a job that failed half-way leaves none."""
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException:
        return None


def key_of(spark: SparkSession, parameters: dict, *inputs: DataFrame) -> str:
    """A digest of parameters and of the files (names, sizes, times) that the inputs read: another one means other tables."""
    lines = [json.dumps(parameters, sort_keys=True, default=str)]
    for df in inputs:
        for name in sorted(df.inputFiles()):  # a row a file
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
            lines.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def build_all(spark: SparkSession, plans: dict[str, Callable[[], DataFrame]], path: str, rebuild: bool = False, key: str = "") -> dict[str, DataFrame]:
    """The tables of ``plans`` as kept below ``path``; missing ones, or all with ``rebuild``, are built and written first.

    Tables are kept by name and ``key`` (see ``key_of``), so those of other parameters or inputs are not taken for these.
    """
    out = {}
    for name, plan in plans.items():
        folder = f"{name}-{key}" if key else name
        kept = None if rebuild else load(spark, path, folder)
        if kept is None:
            plan().write.mode("overwrite").parquet(f"{path}/{folder}")
            kept = spark.read.parquet(f"{path}/{folder}")
        out[name] = kept
    return out
