"""Classes and bins of contact distances, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper edges of the fine decay bins: 2^10 to 2^27.75 in eighths, whole numbers because distances are.
DECAY_EDGES = [int(2 ** (10 + i / 8)) for i in range(143)]


def is_cis() -> Column:
    return F.col("chrom1") == F.col("chrom2")


def distance() -> Column:
    """start2 - start1 of a contact within a chromosome; null between chromosomes."""
    return F.when(is_cis(), F.col("start2") - F.col("start1"))


def coarse_class(d: Column) -> Column:
    """c0 to c5 by open decades, ctrans for null; distances on an edge are in none."""
    bounds = [0, 10**3, 10**4, 10**5, 10**6, 10**7, 10**8]
    out = F.when(d.isNull(), F.lit("ctrans"))
    for i in range(6):
        out = out.when((d > bounds[i]) & (d < bounds[i + 1]), F.lit(f"c{i}"))
    return out


def contact_mode(d: Column) -> Column:
    """self, 2M, far or trans."""
    return F.when(d.isNull(), "trans").when(d < 1000, "self").when(d < 2_000_000, "2M").otherwise("far")


def decay_bin(d: Column) -> Column:
    """Number of the right-closed bin (edge[k - 1], edge[k]] that holds d, 0 for d up to 2^10; null beyond the last edge.

    A logarithm guesses the bin and the whole-number edges settle it, so no rounding decides.
    """
    edges = F.lit(DECAY_EDGES).cast("array<long>")
    n = len(DECAY_EDGES)

    def settled(x: Column) -> Column:
        guess = F.least(F.greatest(F.ceil(8 * F.log2(F.greatest(x, F.lit(1)).cast("double"))).cast("int") - 80, F.lit(0)), F.lit(n - 1))
        right = lambda g: F.when((g > 0) & (x <= F.get(edges, F.greatest(g - 1, F.lit(0)))), g - 1).when(x > F.get(edges, g), g + 1).otherwise(g)
        return F.when((x >= 0) & (x <= DECAY_EDGES[-1]), F.get(F.transform(F.array(guess), right), 0))

    # within a lambda the distance is a value: as a column it would be written out at every use
    return F.get(F.transform(F.array(d), settled), 0).cast("int")


def tor_class(tor: Column, d: Column | None = None) -> Column:
    """1 (latest) to 4 (earliest) replication class; with a distance self_tor1 .. good_tor4."""
    k = (F.floor(F.greatest(F.least(tor, F.lit(2 - 1e-4)), F.lit(-2.0))) + 3).cast("int")
    if d is None:
        return k
    return F.concat(F.when(d < 1000, "self_tor").otherwise("good_tor"), k.cast("string"))


def log_step(d: Column, per_octave: int = 8) -> Column:
    return F.floor(F.log2(d.cast("double")) * per_octave) / per_octave


def half_decade(d: Column) -> Column:
    """Half decades of 1 + d above 10^3, rounded half to even; -1 between chromosomes."""
    return F.coalesce(F.bround(2 * F.greatest(F.lit(0.0), F.log10(1 + F.abs(d)) - 3)) / 2, F.lit(-1.0))


def decade(d: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(F.log10(1 + F.abs(d))).cast("int"))
