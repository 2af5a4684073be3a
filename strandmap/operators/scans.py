"""Running sums, maxima and last values over long orders, chunk by chunk.

A window over a whole order would bring all its rows into one task. Here rows are
put into chunks of neighbours; a window runs within each chunk, one row a chunk
sums it up, and a window over those rows tells each chunk what lies before it.
Chunks come from cells of a whole-number axis, as many as the axis has, or from
ranges between quantiles of a value, as many as there are tasks to fill; neither
number grows with the rows. Within a chunk of an axis there are at most as many
rows as places, once rows of one place have been taken together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name of the chunk's column while a scan is made.
CHUNK = "_chunk"


def by_cells(rows: DataFrame, at: str, width: int) -> DataFrame:
    """Chunks of ``width`` places of a whole-number axis."""
    return rows.withColumn(CHUNK, F.floor(F.col(at) / width))


def by_ranges(rows: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """Chunks of about equally many rows, in order of a number; equal numbers are in one chunk.

    The quantiles between them, ``parts`` at most (by default four for each shuffle partition), come to the driver.
    """
    parts = parts or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = rows.withColumn("_number", F.col(value).cast("double"))
    cuts = sorted(set(number.approxQuantile("_number", [i / parts for i in range(1, parts)], 0.25 / parts)))
    if not cuts:
        return rows.withColumn(CHUNK, F.lit(0.0))
    ranges = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_number", outputCol=CHUNK, handleInvalid="keep")
    return ranges.transform(number).drop("_number")


def _over(how: str, value: Column, window: Window) -> Column:
    return {"sum": lambda: F.sum(value), "max": lambda: F.max(value), "last": lambda: F.last(value, ignorenulls=True)}[how]().over(window)


def scan(rows: DataFrame, by: list[str], order: str, found: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Chunked ``rows`` (see ``by_cells``, ``by_ranges``) with running values in the ascending order of a column without nulls.

    found: name -> (sum, max or last, the value, whether a row's own value counts). A sum before the first row is 0, other
    values are null there; nulls do not count. Chunks must be in the order of ``order``; of equal places any comes first.
    """
    named = rows.withColumns({f"_v_{n}": value for n, (_, value, _) in found.items()})
    total = []
    for n, (how, _, _) in found.items():
        v = F.col(f"_v_{n}")
        total.append({"sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, F.when(v.isNotNull(), F.col(order)))}[how].alias(n))
    chunks = named.groupBy(*by, CHUNK).agg(*total)
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    chunks = chunks.select(*(F.col(c).alias(f"_k_{c}") for c in (*by, CHUNK)), *(_over(how, F.col(n), earlier).alias(f"_b_{n}") for n, (how, _, _) in found.items()))
    both = named.join(chunks, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, CHUNK))))
    within = Window.partitionBy(*by, CHUNK).orderBy(order)
    out = {}
    for n, (how, _, own) in found.items():
        here, before = _over(how, F.col(f"_v_{n}"), within.rowsBetween(Window.unboundedPreceding, 0 if own else -1)), F.col(f"_b_{n}")
        out[n] = {"sum": lambda h=here, b=before: F.coalesce(h, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda h=here, b=before: F.greatest(h, b), "last": lambda h=here, b=before: F.coalesce(h, b)}[how]()
    return both.withColumns(out).drop(*(f"_k_{c}" for c in (*by, CHUNK)), *(f"_b_{n}" for n in found), *(f"_v_{n}" for n in found))


def unchunked(rows: DataFrame) -> DataFrame:
    return rows.drop(CHUNK)
