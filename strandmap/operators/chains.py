"""From aligned read segments to contact pairs between fragment ends.

SAM rows (read_id, mate, seg, rfr, rto, flag, chrom, pos, mapq, len) become chains
(ordered hits of a read), chains become fendchains (ordered fragments) and those
become pairs of fragment ends (fend = 2 * fid, + 1 for the 3' end). The state
machines over one read's few hits run grouped by read; all else is DataFrame
expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHAIN = "read_id string, hits array<struct<rfr:int,rto:int,chrom:string,pos:bigint,strand:string,qual:int,end:bigint>>, err string"


def usable_segments(sam: DataFrame, min_qual: int = 36, min_len: int = 20) -> DataFrame:
    """Mapped segments above ``min_qual`` and of ``min_len`` at least, with strand and end."""
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    kept = sam.where((F.col("flag") != 4) & (F.col("mapq") > min_qual) & (F.col("len") >= min_len))
    return kept.withColumns({"strand": strand, "end": F.col("pos") + F.col("len")})


def resolve_read(first: list[dict], second: list[dict], flip_to: int = 1000) -> tuple[list[dict], str | None]:
    """One read's chain from the hits of its two mates, in read order.

    Hits of the second mate continue the chain backwards: its strands flip and its read
    coordinates count down from ``flip_to``. A hit that overlaps the last one of the first mate
    is the same place seen twice and is merged, on the other strand it is an error.
    """
    flip = {"+": "-", "-": "+"}
    turned = [h | {"strand": flip[h["strand"]], "rfr": flip_to - h["rto"], "rto": flip_to - h["rfr"]} for h in reversed(second)]
    chain = [dict(h) for h in first]
    if not chain:
        return turned, None
    merged = False
    for k, hit in enumerate(turned):
        last = chain[-1]
        if not merged and hit["chrom"] == last["chrom"] and hit["pos"] <= last["end"] and last["pos"] <= hit["end"]:
            if hit["strand"] != last["strand"]:
                return [], "strand_endmis"
            if k:
                return [], "r2_skip"
            last["pos"], last["end"], last["qual"], merged = min(last["pos"], hit["pos"]), max(last["end"], hit["end"]), max(last["qual"], hit["qual"]), True
            continue
        chain.append(hit)
    return chain, None


def chains(segments: DataFrame) -> DataFrame:
    """A chain a read: hits, or the error that makes it unusable."""

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for read, hits in zip(frame["read_id"], frame["hits"], strict=True):
                hits = [dict(h) if isinstance(h, dict) else h.asDict() for h in hits]
                own = [[{k: v for k, v in h.items() if k not in ("mate", "seg")} for h in sorted(hits, key=lambda h: h["seg"]) if h["mate"] == m] for m in (1, 2)]
                chain, err = resolve_read(*own)
                rows.append((read, [{k: h[k] for k in ("rfr", "rto", "chrom", "pos", "strand", "qual", "end")} for h in chain], err))
            yield pd.DataFrame(rows, columns=["read_id", "hits", "err"])

    hit = F.struct("mate", "seg", F.col("rfr").cast("int").alias("rfr"), F.col("rto").cast("int").alias("rto"), "chrom", F.col("pos").cast("long").alias("pos"), "strand", F.col("mapq").cast("int").alias("qual"), F.col("end").cast("long").alias("end"))
    return segments.groupBy("read_id").agg(F.collect_list(hit).alias("hits")).mapInPandas(resolve, CHAIN)


def fragment_hits(chain: DataFrame, frags: DataFrame, scope: int = 1500) -> DataFrame:
    """Each hit with the fragment nearest to 15 bases inside its start; missing where its end names another one."""
    from strandmap.operators.intervals import nearest_end

    hits = chain.where("err is null").select("read_id", F.posexplode("hits").alias("i", "h")).select("read_id", "i", "h.*")
    near = lambda name, at: nearest_end(hits.select("chrom", at.alias("at")).distinct(), frags, "chrom", "at", scope).select("chrom", F.col("at").alias(name), F.col("fid").alias(f"fid_{name}"))
    out = hits.withColumns({"a": F.col("pos") + 15, "b": F.col("end") - 15})
    out = out.join(near("a", F.col("pos") + 15), ["chrom", "a"]).join(near("b", F.col("end") - 15), ["chrom", "b"], "left")
    missing = F.col("fid_b").isNull() | (F.col("fid_a") != F.col("fid_b"))
    return out.withColumn("missing", missing).withColumnRenamed("fid_a", "fid").drop("fid_b", "a", "b")


def fendchains(hits: DataFrame, slack: int = 5) -> DataFrame:
    """Ordered fragments of every read; neighbours on one fragment are one if they do not cross, else the read is dropped."""
    w = Window.partitionBy("read_id").orderBy("i")
    follows = F.lag("fid").over(w) == F.col("fid")
    ok = (F.lag("end").over(w) <= F.col("pos") + slack) | (F.lag("pos").over(w) >= F.col("end") - slack)
    rows = hits.withColumns({"same": F.coalesce(follows, F.lit(False)), "ok": F.coalesce(ok, F.lit(True))}).withColumn("group", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w))
    parts = rows.groupBy("read_id", "group").agg(F.min("fid").alias("fid"), F.min_by("strand", "i").alias("strand"), F.min("qual").alias("qual"), F.max(F.col("same") & ~F.col("ok")).alias("bad"))
    out = parts.groupBy("read_id").agg(F.max("bad").alias("bad"), F.array_sort(F.collect_list(F.struct("group", "fid", "strand", "qual"))).alias("s"))
    return out.where("not bad").select("read_id", F.transform("s", lambda x: F.struct(x["fid"].alias("fid"), x["strand"].alias("strand"), x["qual"].alias("qual"))).alias("segments"))


def reverse_chain(segments: F.Column) -> F.Column:
    """The chain read from its other end."""
    return F.reverse(F.transform(segments, lambda x: F.struct(x["fid"].alias("fid"), F.translate(x["strand"], "+-", "-+").alias("strand"), x["qual"].alias("qual"))))


def chain_key(segments: F.Column) -> F.Column:
    """A chain without its qualities, as text."""
    return F.array_join(F.transform(segments, lambda x: F.concat_ws(":", x["fid"].cast("string"), x["strand"])), ",")


def without_undigested(segments: F.Column, delta: int = 1) -> F.Column:
    """Segments whose fragment is further than ``delta`` from the next one's; the last one stays."""
    return F.filter(segments, lambda x, i: F.coalesce(F.abs(x["fid"] - F.get(segments, i + 1)["fid"]) > delta, F.lit(True)))


def has_bait(segments: F.Column, fid: int) -> F.Column:
    return (F.size(segments) >= 3) & (F.get(segments, F.lit(0))["fid"] == fid)


def molecules(chain: DataFrame) -> DataFrame:
    """Distinct chains, either way round, with their reads; chains of one segment go."""
    forward, back = chain_key(F.col("segments")), chain_key(reverse_chain(F.col("segments")))
    rows = chain.where(F.size("segments") > 1).select(F.when(forward <= back, F.col("segments")).otherwise(reverse_chain(F.col("segments"))).alias("segments"), F.least(forward, back).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("reads"), F.first("segments").alias("segments"))


def fend_pairs(mols: DataFrame, switch_ratio: float = 0.0) -> DataFrame:
    """Pairs of fragment ends: molecules, reads, most reads of one, direct and indirect (next but one) links; likely switches dropped if a ratio is given."""
    n = F.size("segments")
    fend = lambda x, out: x["fid"] * 2 + (x["strand"] == ("+" if out else "-")).cast("int")
    pairs = lambda step: F.when(n > step, F.transform(F.sequence(F.lit(0), F.greatest(n - 1 - step, F.lit(0))), lambda i: F.struct(fend(F.get("segments", i), True).alias("f1"), fend(F.get("segments", i + step), False).alias("f2"), F.lit(step).alias("step"))))
    rows = mols.select("reads", F.explode(F.concat(F.coalesce(pairs(1), F.array()), F.coalesce(pairs(2), F.array()))).alias("p"))
    rows = rows.select("reads", F.least("p.f1", "p.f2").alias("fend1"), F.greatest("p.f1", "p.f2").alias("fend2"), "p.step")
    if switch_ratio > 0:
        rows = rows.withColumn("_most", F.max("reads").over(Window.partitionBy("fend1", "fend2"))).where(F.col("reads") >= F.col("_most") * switch_ratio)
    return rows.groupBy("fend1", "fend2").agg(F.count_if(F.col("step") == 1).alias("direct"), F.count_if(F.col("step") == 2).alias("indirect"), F.count("*").alias("mol"), F.sum("reads").alias("reads"), F.max("reads").alias("max_reads"))


def composition(mols: DataFrame, frags: DataFrame, cutoff: int) -> DataFrame:
    """How many chains have how many links between chromosomes, near and far ones."""
    at = frags.select("fid", "chrom", "start")
    w = Window.partitionBy("key").orderBy("i")
    rows = mols.select("key", F.posexplode("segments").alias("i", "s")).select("key", "i", F.col("s.fid").alias("fid")).join(at, "fid")
    rows = rows.withColumns({"c0": F.lag("chrom").over(w), "s0": F.lag("start").over(w)}).where("c0 is not null")
    d = F.abs(F.col("start") - F.col("s0"))
    kinds = rows.groupBy("key").agg(F.count_if(F.col("chrom") != F.col("c0")).alias("n_trans"), F.count_if((F.col("chrom") == F.col("c0")) & (d <= cutoff)).alias("n_close"), F.count_if((F.col("chrom") == F.col("c0")) & (d > cutoff)).alias("n_far"))
    return kinds.groupBy("n_trans", "n_close", "n_far").agg(F.count("*").alias("count"))


def multiplicity(chain: DataFrame, frags: DataFrame) -> DataFrame:
    """Chains seen once or more often (multi), within or between chromosomes (trans): n of each kind. Segments on no known fragment do not make a chain trans."""
    seen = chain.groupBy(chain_key(F.col("segments")).alias("key")).agg(F.count("*").alias("reads"), F.first("segments").alias("segments"))
    at = frags.select("fid", "chrom")
    kinds = seen.select("key", "reads", F.explode("segments.fid").alias("fid")).join(at, "fid", "left").groupBy("key", "reads").agg((F.min("chrom") < F.max("chrom")).alias("trans"))
    return kinds.groupBy((F.col("reads") > 1).alias("multi"), F.coalesce("trans", F.lit(False)).alias("trans")).agg(F.count("*").alias("n"))


def ligation_class(near: int = 1) -> F.Column:
    """trans, no_site (ends at most ``near`` numbers apart) or the decade of the distance. fend1, fend2, chrom1, start1, chrom2, start2."""
    d = F.abs(F.col("start2") - F.col("start1"))
    decade = F.concat(F.lit("cis_"), (F.length(d.cast("string")) - 1).cast("string"))  # digits, so that no logarithm rounds
    return F.when(F.col("chrom1") != F.col("chrom2"), "trans").when(F.abs(F.col("fend1") - F.col("fend2")) <= near, "no_site").otherwise(decade)


def baited(chain: DataFrame, keys: DataFrame, baits: DataFrame) -> DataFrame:
    """Chains with the bait of their read in front: keys (read_id, key), baits (key, fid); reads without either go."""
    bait = keys.join(baits, "key").select("read_id", F.array(F.struct("fid", F.lit("+").alias("strand"), F.lit(None).cast("int").alias("qual"))).alias("_bait"))
    return chain.join(bait, "read_id").withColumn("segments", F.concat("_bait", "segments")).drop("_bait")


def spaced_offsets(rows: DataFrame, pad: int) -> DataFrame:
    """Of the reads of a pair (fend1, fend2, off1, off2) those that lie over ``pad`` from all kept before, in order of offsets."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        chosen = []
        for r in frame.sort_values(["off1", "off2"]).itertuples(index=False):
            if all(abs(r.off1 - a) > pad or abs(r.off2 - b) > pad for a, b in kept):
                kept.append((r.off1, r.off2))
                chosen.append(r)
        return pd.DataFrame(chosen, columns=frame.columns)

    return rows.select("fend1", "fend2", "off1", "off2").distinct().groupBy("fend1", "fend2").applyInPandas(keep, "fend1 long, fend2 long, off1 long, off2 long") if pad >= 0 else rows


def direct_pairs(reads: DataFrame, min_qual: int = 38) -> tuple[DataFrame, DataFrame]:
    """The path without chains: (adjacency, counters) from mapped pairs (fid1, side1, off1, q1, fid2, ...), -1 for no fragment."""
    kind = F.when(F.least("q1", "q2") < min_qual, "lowq").when((F.col("fid1") == -1) | (F.col("fid2") == -1), "nomap").when(F.col("fid1") == F.col("fid2"), "self").otherwise("ok")
    rows = reads.withColumn("kind", kind)
    fends = rows.where("kind = 'ok'").withColumns({"a": F.struct((F.col("fid1") * 2 + F.col("side1")).alias("f"), F.col("off1").alias("o")), "b": F.struct((F.col("fid2") * 2 + F.col("side2")).alias("f"), F.col("off2").alias("o"))}).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    adj = fends.groupBy(F.col("a.f").alias("fend1"), F.col("b.f").alias("fend2")).agg(F.count_distinct("a.o", "b.o").alias("count"))
    return adj, rows.groupBy("kind").agg(F.count("*").alias("n"))
