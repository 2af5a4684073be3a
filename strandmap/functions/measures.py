"""Scalar measures: enrichments, divergences, duplication, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_duplicates(k: Column, n: Column) -> Column:
    """Expected share of those of k molecules seen at all that are seen more than once in n draws."""
    miss = (k - 1) / k
    none, once = F.pow(miss, n), (n / k) * F.pow(miss, n - 1)
    return F.try_divide(1 - none - once, 1 - none)


def compartment_enrichment(aa: Column, ab: Column, bb: Column) -> dict[str, Column]:
    """log2 of observed over expected A-A, B-B, and of expected over observed A-B, from the compartments' own shares."""
    total = aa + ab + bb
    a = F.try_divide(2.0 * aa + ab, 2.0 * total)
    b = 1 - a
    log2 = lambda x: F.when(x > 0, F.log2(x))
    return {"en_aa": log2(F.try_divide(aa, a * a * total)), "depl_ab": -log2(F.try_divide(ab, 2 * a * b * total)), "en_bb": log2(F.try_divide(bb, b * b * total))}


def binomial(x: Column, size: Column, p: Column) -> Column:
    """Binomial probability by products in logarithms; for small x."""
    choose = F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i <= x, F.ln((size - i + 1) / i)).otherwise(0.0))
    return F.exp(choose + x * F.ln(p) + (size - x) * F.ln(1 - p))


def kl_divergence(p: Column, q: Column) -> Column:
    """Sum of p ln(p / q) over two arrays, 0 where p is 0."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def js_divergence(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return (kl_divergence(p, m) + kl_divergence(q, m)) / 2


def fixed(x: Column, digits: int) -> Column:
    """A number of at least 0 with so many digits, rounded by its exact binary value and half to even, as C prints it."""
    unit = 10**digits
    low = F.floor(x * unit).cast("double")
    bits = [2 ** k for k in range((2 * unit).bit_length(), -1, -1) if 2 * unit & 2**k]
    over = x * float(bits[0]) - (2 * low + 1)  # x * 2 * unit less the middle, in terms that are exact
    for b in bits[1:]:
        over = over + x * float(b)
    k = (low + F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(low % 2)).cast("long")
    return F.concat(F.floor(k / unit).cast("string"), F.lit("."), F.lpad((k % unit).cast("string"), digits, "0"))


def short_number(n: Column, digits: int = 2) -> Column:
    """1500000 as 1.50M: G, M and K from a thousand each."""
    sign, size = F.when(n < 0, "-").otherwise(""), F.abs(n).cast("double")
    large = n.cast("double")
    return F.when(large >= 1e9, F.concat(fixed(size / 1e9, digits), F.lit("G"))).when(large >= 1e6, F.concat(fixed(size / 1e6, digits), F.lit("M"))).when(large >= 1e3, F.concat(fixed(size / 1e3, digits), F.lit("K"))).otherwise(F.concat(sign, fixed(size, digits)))


def shade(value: Column, breaks: list[float], shades: int = 256) -> Column:
    """Index (from 1) of a value among ``shades`` steps between each two breaks, linear within, clipped at both ends."""
    v = F.greatest(F.least(value, F.lit(float(breaks[-1]))), F.lit(float(breaks[0])))
    out = None
    for i in range(len(breaks) - 1):
        a, b = float(breaks[i]), float(breaks[i + 1])
        step = (F.floor((v - a) / (b - a) * shades).cast("int") + 1 + i * shades)
        step = F.least(step, F.lit((i + 1) * shades))
        out = F.when(v <= b, step) if out is None else out.when(v <= b, step)
    return out


def motif_class(forward: Column, reverse: Column, least: float) -> Column:
    """C for both orientations, F, R, or B for neither."""
    return F.when((forward >= least) & (reverse >= least), "C").when(forward >= least, "F").when(reverse >= least, "R").otherwise("B")


def loop_type(left: Column, right: Column, none: str = "N") -> Column:
    """conv (F then R), diver, same, chip (both without a motif), one_sided or none."""
    l_none, r_none = left == none, right == none
    return F.when(l_none & r_none, "none").when(l_none | r_none, "one_sided").when((left == "F") & (right == "R"), "conv").when((left == "R") & (right == "F"), "diver").when((left == right) & left.isin("F", "R"), "same").otherwise("chip")
