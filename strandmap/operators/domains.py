"""Domains (fid, chrom, start, end_, ab): compartment counts, scores, coverage, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import distance as D
from strandmap.functions import measures as M
from strandmap.operators.intervals import containing

_DOMAIN = ["fid", "chrom", "start", "end_", "ab"]


def in_domains(contacts: DataFrame, domains: DataFrame) -> DataFrame:
    """Contacts with the domains of both sides (fid1, fid2); those outside go."""
    return containing(containing(contacts, domains, "chrom1", "start1", "fid", "fid1"), domains, "chrom2", "start2", "fid", "fid2")


def _labelled(contacts: DataFrame, domains: DataFrame) -> DataFrame:
    side = lambda i: domains.select(F.col("fid").alias(f"fid{i}"), F.col("ab").alias(f"ab{i}"), F.col("start").alias(f"from{i}"), F.col("end_").alias(f"to{i}"))
    return in_domains(contacts, domains).join(side(1), "fid1").join(side(2), "fid2")


def compartment_contacts(contacts: DataFrame, domains: DataFrame, mindist: int = 2_000_000) -> DataFrame:
    """A-A, A-B and B-B contacts of every cell, within chromosomes (domains ``mindist`` apart at least) and between them."""
    rows = _labelled(contacts, domains)
    gap = F.greatest("from1", "from2") - F.least("to1", "to2")
    rows = rows.where((F.col("chrom1") != F.col("chrom2")) | (gap >= mindist))
    kind = F.concat(F.least("ab1", "ab2"), F.greatest("ab1", "ab2"))
    counts = {f"{where}_{k.lower()}": F.count_if((kind == k) & ((F.col("chrom1") == F.col("chrom2")) == cis)) for where, cis in (("cis", True), ("trans", False)) for k in ("AA", "AB", "BB")}
    return rows.groupBy("cell_id").agg(*(v.alias(k) for k, v in counts.items()), F.count("*").alias("total"))


def compartment_enrichments(counts: DataFrame, where: str = "trans") -> DataFrame:
    measures = M.compartment_enrichment(*(F.col(f"{where}_{k}").cast("double") for k in ("aa", "ab", "bb")))
    return counts.select("cell_id", *(v.alias(k) for k, v in measures.items()))


def coverage(contacts: DataFrame, domains: DataFrame, discard_below: int = 0, sums: bool = False) -> DataFrame:
    """Contacts (or their counts) of every cell and domain, either side; those within chromosomes below a distance are left out."""
    from strandmap.operators.contacts import symmetrize

    far = contacts.where((F.col("chrom1") != F.col("chrom2")) | (F.col("start2") - F.col("start1") >= discard_below))
    rows = containing(symmetrize(far), domains, "chrom1", "start1", "fid", "fid")
    return rows.groupBy("cell_id", "fid").agg((F.sum("cnt") if sums else F.count("*")).alias("n"))


def per_kb(contacts: DataFrame, domains: DataFrame, cells: int, low: float, high: float) -> DataFrame:
    """Domains whose contacts a kilobase and cell lie in a range."""
    n = coverage(contacts, domains).groupBy("fid").agg(F.sum("n").alias("n")).join(domains, "fid")
    return n.withColumn("cov", F.col("n") / ((F.col("end_") - F.col("start")) / 1000) / cells).where(F.col("cov").between(low, high)).select("fid", "n", "cov")


def pair_totals(contacts: DataFrame, domains: DataFrame, mindist: int = 2_000_000, trans: bool = True) -> DataFrame:
    """Contacts of every two domains of different chromosomes (or of one, ``mindist`` apart), both orders."""
    from strandmap.operators.contacts import symmetrize

    rows = symmetrize(contacts).where((F.col("chrom1") != F.col("chrom2")) if trans else (F.col("chrom1") == F.col("chrom2")) & (F.abs(F.col("start2") - F.col("start1")) >= mindist))
    return in_domains(rows, domains).groupBy("fid1", "fid2").agg(F.sum("cnt").alias("n"))


def a_share(pairs: DataFrame, domains: DataFrame) -> DataFrame:
    """Share of every domain's contacts that are with A domains."""
    ab = domains.select(F.col("fid").alias("fid2"), "ab")
    return pairs.join(ab, "fid2").groupBy("fid1").agg(F.sum(F.when(F.col("ab") == "A", F.col("n")).otherwise(0)).alias("n_a"), F.sum("n").alias("n")).select(F.col("fid1").alias("fid"), "n", (F.col("n_a") / F.col("n")).alias("p_a"))


def a_score(pairs: DataFrame, domains: DataFrame) -> DataFrame:
    """Mean share of A contacts of every domain's partners, weighted by contacts."""
    share = a_share(pairs, domains).select(F.col("fid").alias("fid2"), "p_a")
    return pairs.join(share, "fid2").groupBy("fid1").agg((F.sum(F.col("n") * F.col("p_a")) / F.sum("n")).alias("a_score")).withColumnRenamed("fid1", "fid")


def cell_scores(contacts: DataFrame, scores: DataFrame, domains: DataFrame, least: int = 4, partners: int = 2, mindist: int = 2_000_000) -> DataFrame:
    """For every cell and domain with enough contacts and partners: mean and variance of the partners' scores."""
    from strandmap.operators.contacts import symmetrize

    rows = symmetrize(contacts).where((F.col("chrom1") != F.col("chrom2")) | (F.abs(F.col("start2") - F.col("start1")) >= mindist))
    rows = in_domains(rows, domains).join(scores.select(F.col("fid").alias("fid2"), "a_score"), "fid2")
    out = rows.groupBy("cell_id", F.col("fid1").alias("fid")).agg(F.count("*").alias("n"), F.count_distinct("fid2").alias("partners"), F.avg("a_score").alias("mean"), F.var_samp("a_score").alias("var"))
    return out.where((F.col("n") >= least) & (F.col("partners") >= partners))


def decay_within(contacts: DataFrame, domains: DataFrame, tor: DataFrame, cuts: list[int]) -> DataFrame:
    """Contacts inside one domain by the domain's size class, replication class and distance bin."""
    same = in_domains(contacts.where(D.is_cis()), domains).where("fid1 = fid2")
    size = F.lit(0)
    length = F.col("end_") - F.col("start")
    for i, c in enumerate(cuts, 1):
        size = F.when(length >= c, i).otherwise(size)
    mid = F.floor((F.col("start") + F.col("end_")) / 2)
    about = domains.withColumn("size", size).withColumn("_bin", F.floor(mid / 100_000) * 100_000)
    about = about.join(tor.select("chrom", F.col("start").alias("_bin"), "v"), ["chrom", "_bin"]).select(F.col("fid").alias("fid1"), "size", D.tor_class(F.col("v")).alias("tor"))
    rows = same.join(about, "fid1").withColumn("bin", D.decay_bin(F.col("start2") - F.col("start1"))).where("bin is not null")
    return rows.groupBy("size", "tor", "bin").agg(F.count("*").alias("n"))


def overlap_score(domains: DataFrame, reference: DataFrame, cell: int = 1_000_000) -> DataFrame:
    """Mean of the reference's scores (chrom, start, end_, score) weighted by overlap."""
    from strandmap.operators.intervals import overlap_join

    ref = reference.select(F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("end_").alias("end2"), "score")
    both = overlap_join(domains, ref, ("chrom", "start", "end_"), ("chrom2", "start2", "end2"), cell)
    shared = F.least("end_", "end2") - F.greatest("start", "start2")
    return both.groupBy("fid").agg((F.sum(F.col("score") * shared) / F.sum(shared)).alias("score"))


def grid_totals(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Contacts of every two groups of domains (fid, pc), with observed over expected from the margins."""
    named = pairs.join(groups.select(F.col("fid").alias("fid1"), F.col("pc").alias("pc1")), "fid1").join(groups.select(F.col("fid").alias("fid2"), F.col("pc").alias("pc2")), "fid2")
    n = named.groupBy("pc1", "pc2").agg(F.sum("n").alias("n"))
    rows, columns, every = Window.partitionBy("pc1"), Window.partitionBy("pc2"), Window.partitionBy(F.lit(1))  # groups x groups rows
    return n.withColumn("enrichment", F.log2(F.col("n") * F.sum("n").over(every) / (F.sum("n").over(rows) * F.sum("n").over(columns))))
