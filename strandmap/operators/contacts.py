"""Per-cell statistics of contacts (cell_id, chrom1, start1, chrom2, start2, cnt): one grouped pass each, no job a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import distance as D


def with_distance(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("d", D.distance())


def forward(contacts: DataFrame) -> DataFrame:
    """One orientation: between chromosomes, or start2 > start1."""
    return contacts.where((F.col("chrom1") != F.col("chrom2")) | (F.col("start2") > F.col("start1")))


def symmetrize(contacts: DataFrame) -> DataFrame:
    """Both orientations of every contact."""
    swap = {"chrom1": "chrom2", "start1": "start2", "chrom2": "chrom1", "start2": "start1"}
    return contacts.unionByName(contacts.select(*(F.col(swap.get(c, c)).alias(c) for c in contacts.columns)))


def canonical(contacts: DataFrame) -> DataFrame:
    """Ascending sides; counts of a contact and of its mirror are summed for each cell."""
    a, b = (F.struct(F.col(f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("start")) for i in (1, 2))
    lo, hi = F.least(a, b), F.greatest(a, b)
    rows = contacts.select("cell_id", lo.alias("lo"), hi.alias("hi"), "cnt")
    summed = rows.groupBy("cell_id", "lo", "hi").agg(F.sum("cnt").alias("cnt"))
    return summed.select("cell_id", F.col("lo.chrom").alias("chrom1"), F.col("lo.start").alias("start1"), F.col("hi.chrom").alias("chrom2"), F.col("hi.start").alias("start2"), "cnt")


def coarse_decay(contacts: DataFrame) -> DataFrame:
    """c0 to c5 and ctrans of every cell."""
    kind = D.coarse_class(F.col("d"))
    return with_distance(contacts).groupBy("cell_id").agg(*(F.count_if(kind == c).alias(c) for c in ("c0", "c1", "c2", "c3", "c4", "c5", "ctrans")))


def fine_decay(contacts: DataFrame, by: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Contacts of every bin of distance, null bins beyond the last edge left out; bin -1 between chromosomes."""
    rows = with_distance(forward(contacts))
    bins = rows.withColumn("bin", F.when(F.col("d").isNull(), -1).otherwise(D.decay_bin(F.col("d"))))
    return bins.where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def partitioned_decay(contacts: DataFrame, parts: int) -> DataFrame:
    """Decay of every cell, chromosome and part, with contacts between chromosomes counted half; parts by a hash of the ends."""
    part = F.pmod(F.col("start1") * 31 + F.col("start2") * 17, F.lit(parts)).cast("int")
    rows = with_distance(contacts).withColumn("part", part)
    rows = rows.withColumn("bin", F.when(F.col("d").isNull(), -1).otherwise(D.decay_bin(F.col("d")))).where("bin is not null")
    return rows.groupBy("cell_id", "chrom1", "part", "bin").agg((F.count("*") * F.when(F.col("bin") == -1, 0.5).otherwise(1.0)).alias("n"))


def mode_counts(contacts: DataFrame, chroms: DataFrame) -> DataFrame:
    """Contacts of every cell, chromosome and mode, with zeros; chroms: chrom1."""
    counts = with_distance(contacts).withColumn("mode", D.contact_mode(F.col("d"))).groupBy("cell_id", "chrom1").agg(*(F.count_if(F.col("mode") == m).alias(n) for m, n in (("self", "n_self"), ("2M", "n_2m"), ("far", "n_far"), ("trans", "n_trans"))))
    grid = contacts.select("cell_id").distinct().crossJoin(F.broadcast(chroms))  # cells x a few chromosomes
    return grid.join(counts, ["cell_id", "chrom1"], "left").na.fill(0, ["n_self", "n_2m", "n_far", "n_trans"])


def marginal_z(contacts: DataFrame) -> DataFrame:
    """Observed and expected contacts of every cell and chromosome, their z and log2 enrichment."""
    n = contacts.groupBy("cell_id", "chrom1").agg(F.count("*").alias("n"))
    cell, chrom, every = Window.partitionBy("cell_id"), Window.partitionBy("chrom1"), n.agg(F.sum("n").alias("total"))
    rows = n.withColumn("cell_n", F.sum("n").over(cell)).withColumn("chrom_n", F.sum("n").over(chrom)).crossJoin(F.broadcast(every))  # one row
    rows = rows.withColumn("expected", F.col("cell_n") * F.col("chrom_n") / F.col("total"))
    return rows.select("cell_id", "chrom1", "n", "expected", ((F.col("n") - F.col("expected")) / F.sqrt("expected")).alias("z"), F.log2((F.col("n") + 1) / (F.col("expected") + 1)).alias("enr"))


def repeated_fends(contacts: DataFrame, size: int = 1) -> DataFrame:
    """Share of every cell's and chromosome's first ends (in bins of ``size``) with more than one contact within it."""
    ends = contacts.where(D.is_cis()).groupBy("cell_id", "chrom1", F.floor(F.col("start1") / size).alias("fend")).agg(F.count("*").alias("n"))
    return ends.groupBy("cell_id", "chrom1").agg(F.count("*").alias("n_fends"), F.count_if(F.col("n") > 1).alias("n_dup")).withColumn("f_dup", F.col("n_dup") / F.col("n_fends"))


def shared_trans(contacts: DataFrame, size: int = 1) -> DataFrame:
    """How many contacts between chromosomes (ends in bins of ``size``) occur in how many cells."""
    ends = contacts.where(~D.is_cis()).groupBy("chrom1", F.floor(F.col("start1") / size).alias("b1"), "chrom2", F.floor(F.col("start2") / size).alias("b2")).agg(F.count_distinct("cell_id").alias("cells"))
    return ends.groupBy("cells").agg(F.count("*").alias("n"))


def reads_per_contact(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("cell_id", D.is_cis().alias("cis"), "cnt").agg(F.count("*").alias("n"))


def mean_reads(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("cell_id").agg(F.avg(F.when(D.is_cis(), F.col("cnt"))).alias("cis_mean"), F.avg(F.when(~D.is_cis(), F.col("cnt"))).alias("trans_mean"))


def chromosome_pairs(contacts: DataFrame) -> DataFrame:
    """Contacts of every pair of different chromosomes of every cell, with zeros for pairs that any cell has."""
    n = contacts.where(~D.is_cis()).select("cell_id", F.least("chrom1", "chrom2").alias("a"), F.greatest("chrom1", "chrom2").alias("b")).groupBy("cell_id", "a", "b").agg(F.count("*").alias("n"))
    pairs = n.select("a", "b").distinct()
    grid = n.select("cell_id").distinct().crossJoin(F.broadcast(pairs))  # cells x pairs of a few chromosomes
    return grid.join(n, ["cell_id", "a", "b"], "left").na.fill(0, ["n"])


def orientations(contacts: DataFrame, low: int = 100, high: int = 10_000) -> DataFrame:
    """Contacts by the direction of their two ends (parity of the end) and bin of log2 distance."""
    rows = with_distance(contacts).where((F.col("d") >= low) & (F.col("d") < high))
    return rows.groupBy(F.concat(F.lit("f"), (F.col("start1") % 2).cast("string"), (F.col("start2") % 2).cast("string")).alias("orientation"), D.log_step(F.col("d")).alias("bin")).agg(F.count("*").alias("n"))


def unique_ends(contacts: DataFrame, size: int = 1) -> DataFrame:
    sides = contacts.select("cell_id", F.explode(F.array(F.struct(F.col("chrom1").alias("chrom"), F.floor(F.col("start1") / size).alias("at")), F.struct(F.col("chrom2").alias("chrom"), F.floor(F.col("start2") / size).alias("at")))).alias("e"))
    return sides.groupBy("cell_id").agg(F.count_distinct("e").alias("n_ends"))


def normalised_decay(contacts: DataFrame) -> DataFrame:
    """Share of contacts a base for half decades of distance from 10^3 on."""
    rows = with_distance(contacts).where("d >= 1000").groupBy(D.half_decade(F.col("d")).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a few bins
    return rows.withColumn("density", F.col("n") / total / (F.pow(F.lit(10.0), F.col("bin") + 3) * (F.sqrt(F.lit(10.0)) - 1)))


def octave_decay(contacts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of contacts in [1, 2^10) and octaves from there to 2^28."""
    octave = F.when(F.col("d") < 1024, 9).otherwise(F.floor(F.log2(F.col("d").cast("double"))).cast("int"))
    rows = with_distance(contacts).where("d >= 1 and d < 536870912").groupBy(*by, octave.alias("octave")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or (F.lit(1),)))))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of the pairs without a null; null where either does not vary."""
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pair_correlations(contacts: DataFrame, least: int = 30) -> DataFrame:
    """Correlation of the ends' places for pairs of chromosomes with at least ``least`` contacts."""
    rows = contacts.where(~D.is_cis()).groupBy("chrom1", "chrom2").agg(F.count("*").alias("n"), correlation(F.col("start1"), F.col("start2")).alias("r"))
    return rows.where(F.col("n") >= least)


def alignment(contacts: DataFrame, chrom_len: int, least: int = 10) -> DataFrame:
    """n, contacts between chromosomes, correlation of relative places, share of chromosome pairs (over ``least`` contacts) whose correlation is positive."""
    rel = lambda c: F.col(c) / chrom_len
    trans = contacts.where(~D.is_cis())
    whole = contacts.groupBy("cell_id").agg(F.count("*").alias("n"), F.count_if(~D.is_cis()).alias("ntrans"), correlation(F.when(~D.is_cis(), rel("start1")), F.when(~D.is_cis(), rel("start2"))).alias("c_align"))
    pairs = trans.groupBy("cell_id", "chrom1", "chrom2").agg(F.count("*").alias("n"), correlation(rel("start1"), rel("start2")).alias("r")).where(F.col("n") > least)
    share = pairs.groupBy("cell_id").agg(F.avg((F.col("r") > 0).cast("int")).alias("frac_pos"))
    return whole.join(share, "cell_id", "left")


def marginal(contacts: DataFrame, width: int) -> DataFrame:
    """Contacts and summed counts of every strip of a chromosome."""
    return symmetrize(contacts).groupBy(F.col("chrom1").alias("chrom"), (F.floor(F.col("start1") / width) * width).alias("start")).agg(F.count("*").alias("area"), F.sum("cnt").alias("weighted"))


def peaks_ratio(decay: DataFrame) -> DataFrame:
    """Contacts in bins of 2^11.25 to 2^21.75 over those in 2^23 to 2^27.25."""
    near, far = (F.sum(F.when(F.col("bin").between(a, b), F.col("n"))) for a, b in ((10, 94), (104, 138)))
    return decay.groupBy("cell_id").agg((F.try_divide(near.cast("double"), far.cast("double"))).alias("ratio"))


def band_summary(contacts: DataFrame, low: int, high: int) -> DataFrame:
    return with_distance(contacts).where((F.col("d") >= low) & (F.col("d") < high)).agg(F.count("*").alias("n"), F.sum("cnt").alias("total"), F.min("cnt").alias("least"), F.max("cnt").alias("most"), F.avg("cnt").alias("mean"), F.stddev_samp("cnt").alias("sd"))


def track_stats(contacts: DataFrame) -> DataFrame:
    """Contacts (half the rows of the symmetric track) and share within chromosomes of every cell."""
    return symmetrize(contacts).groupBy("cell_id").agg((F.count("*") / 2).alias("n_adj"), F.avg(D.is_cis().cast("int")).alias("cis_frac"))


def merged(contacts: DataFrame, mode: str, size: int, sources: int = 64) -> DataFrame:
    """Contacts of all cells merged on bins of ``size``: raw_sum, binary_per_adj (cells that have it) or to_imp (log mean in hundredths)."""
    rows = canonical(contacts.withColumns({"start1": F.floor(F.col("start1") / size), "start2": F.floor(F.col("start2") / size)}))
    agg = {"raw_sum": F.sum("cnt"), "binary_per_adj": F.count_distinct("cell_id"), "to_imp": F.floor(100 * F.lit(sources) * (F.exp(F.sum(F.ln(1 + F.col("cnt"))) / sources) - 1)) / 100}[mode]
    return rows.groupBy("chrom1", "start1", "chrom2", "start2").agg(agg.alias("value"))


def replication_counts(contacts: DataFrame, tor: DataFrame, reach: int = 10_000, size: int = 100_000) -> DataFrame:
    """Contacts within chromosomes by cell and replication class of side 1 (self below 1 kb, good from there)."""
    from strandmap.operators.intervals import window_average

    rows = with_distance(contacts.where(D.is_cis()))
    places = rows.select("chrom1", "start1").distinct().withColumn("place", F.struct("chrom1", "start1"))
    mean = window_average(places, tor, "chrom1", "start1", reach, size, "tor", "place").select(F.col("place.chrom1").alias("chrom1"), F.col("place.start1").alias("start1"), "tor")
    return rows.join(mean, ["chrom1", "start1"]).groupBy("cell_id", D.tor_class(F.col("tor"), F.col("d")).alias("kind")).agg(F.count("*").alias("n"))


def replication_shares(counts: DataFrame) -> DataFrame:
    """tor1 to tor4 of every cell as shares, and early_f (tor3 and tor4)."""
    n = [F.sum(F.when(F.col("kind").endswith(f"tor{i}"), F.col("n")).otherwise(0)) for i in range(1, 5)]
    total = F.sum("n")
    return counts.groupBy("cell_id").agg(*((x / total).alias(f"tor{i}") for i, x in enumerate(n, 1)), ((n[2] + n[3]) / total).alias("early_f"))


def quality(contacts: DataFrame, max_nodig: float, max_trans: float, low: int, high: int, max_enr: float) -> DataFrame:
    """Cells with their coverage, share of undigested (below 1 kb) and trans contacts, largest chromosome enrichment, and whether they pass."""
    rows = with_distance(contacts).groupBy("cell_id").agg(F.count("*").alias("total"), F.avg((F.coalesce(F.col("d"), F.lit(10**9)) < 1000).cast("int")).alias("f_nodig"), F.avg(F.col("d").isNull().cast("int")).alias("f_trans"))
    karyo = marginal_z(contacts).groupBy("cell_id").agg(F.max(F.abs("enr")).alias("max_enr"))
    ok = (F.col("f_nodig") <= max_nodig) & (F.col("f_trans") <= max_trans) & F.col("total").between(low, high) & (F.col("max_enr") <= max_enr)
    return rows.join(karyo, "cell_id").withColumn("passed", ok)
