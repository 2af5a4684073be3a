"""DNA and read-quality expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "GATCgatc", "CTAGctag")


def pieces(seq: Column, site: str) -> Column:
    """The sequence cut before every recognition site, overlapping ones included; read once from left to right."""
    return F.split(seq, f"(?={re.escape(site)})", -1)


def piece_ends(parts: Column) -> Column:
    """Where each of an array of consecutive pieces ends."""
    none = F.array().cast("array<int>")
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["ends"], F.array(s["at"] + F.length(x))).alias("ends"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("ends")), step, lambda s: s["ends"])


def site_positions(seq: Column, site: str) -> Column:
    """0-based starts of a recognition site, overlaps included, as an array."""
    none = F.array().cast("array<int>")
    ends = piece_ends(pieces(seq, site))
    return F.concat(F.when(F.startswith(seq, F.lit(site)), F.array(F.lit(0))).otherwise(none), F.slice(ends, 1, F.size(ends) - 1))


def split_at_site(seq: Column, site: str = "GATC", min_len: int = 16, strict: bool = False) -> Column:
    """Segments (from, to) of a read cut after every site; each keeps its closing site and those shorter than ``min_len`` go.

    ``strict`` leaves a read whole if a site starts it.
    """
    cuts = site_positions(seq, site)
    if strict:
        cuts = F.when(F.get(cuts, F.lit(0)) == 0, F.array().cast("array<int>")).otherwise(cuts)
    ends = F.array_distinct(F.concat(F.transform(cuts, lambda i: i + len(site)), F.array(F.length(seq))))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    pairs = F.arrays_zip(starts.alias("from"), ends.alias("to"))
    return F.filter(F.transform(pairs, lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to"))), lambda p: (p["to"] - p["from"]) >= min_len)


def phred(qual: Column) -> Column:
    """Quality characters as numbers, ASCII less 33."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def mean_quality(quals: Column) -> Column:
    return F.try_divide(F.aggregate(quals, F.lit(0).cast("long"), lambda a, q: a + q), F.size(quals))


def share_at_least(quals: Column, least: int) -> Column:
    return F.try_divide(F.size(F.filter(quals, lambda q: q >= least)), F.size(quals))


def clean_name(name: Column) -> Column:
    """Runs of characters other than letters, digits, dot, minus and underscore, with underscores after them, become one underscore."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9.\-_]+_*", "_")


def barcode(seq: Column, length: int) -> Column:
    """A read's leading barcode; null if it has an N or is short."""
    b = F.substring(seq, 1, length)
    return F.when((F.length(b) == length) & (F.instr(b, "N") == 0), b)


def clipped_position(pos: Column, cigar: Column, reverse: Column) -> Column:
    """Position after soft clips: clips at the start move it right, those at the end of a reverse read left."""
    start = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, r"^(\d+)S", 1), F.lit("")), F.lit("999999")).cast("long"), F.lit(0))
    end = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, r"(\d+)S$", 1), F.lit("")), F.lit("999999")).cast("long"), F.lit(0))
    return F.when(reverse, pos - end).otherwise(pos + start)


def tiles(seq: Column, length: int, step: int) -> Column:
    """Reads of ``length`` taken every ``step`` bases, as structs (start, read)."""
    last = F.length(seq) - length - 1
    return F.when(last >= step, F.transform(F.sequence(F.lit(step), F.greatest(last, F.lit(step)), F.lit(step)), lambda i: F.struct(i.alias("start"), F.substring(seq, i, F.lit(length)).alias("read"))))


def reads(seq: Column, length: int) -> Column:
    """The whole sequence as consecutive reads of ``length`` bases; the last one may be shorter."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
