"""Reads, digests, chains, configuration and the statistics that SQL does not check."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from strandmap.functions import sequence as S
from strandmap.operators import chains as H
from strandmap.operators import digest as G
from strandmap.operators import phasing as P
from strandmap.operators import statistics as K
from strandmap.plans.config import arguments, option, option_list, read_config
from strandmap.sources import files


def split(spark, seq, **kw):
    df = spark.createDataFrame([(seq,)], "q string")
    return [(r["from"], r["to"]) for r in df.select(S.split_at_site(F.col("q"), **kw).alias("s")).first().s]


def test_split_keeps_sites_and_drops_short_segments(spark):
    seq = "A" * 20 + "GATC" + "C" * 5 + "GATC" + "T" * 30
    assert split(spark, seq) == [(0, 24), (33, 63)]
    assert split(spark, "GATC" + "A" * 20) == [(4, 24)]
    assert split(spark, "GATC" + "A" * 20, strict=True) == [(0, 24)]
    assert split(spark, "ACGT") == []


def test_reverse_complement_twice_is_the_text(spark):
    df = spark.createDataFrame([("GATCCAgatc",), ("",), (None,)], "q string")
    assert [r.x for r in df.select(S.reverse_complement(S.reverse_complement(F.col("q"))).alias("x")).collect()] == ["GATCCAgatc", "", None]


def test_soft_clips(spark):
    df = spark.createDataFrame([(100, "5S30M", False), (100, "30M7S", True), (100, "35M", False)], "pos long, cigar string, rev boolean")
    assert [r.x for r in df.select(S.clipped_position(F.col("pos"), F.col("cigar"), F.col("rev")).alias("x")).collect()] == [105, 93, 100]


def test_fastq_fasta_and_sam(spark, tmp_path):
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\nIIII\n@r2\nAANT\n+\n!III\n@r3\nAC\n")
    got = files.read_fastq(spark, str(tmp_path / "a.fastq.gz")).orderBy("ord").collect()
    assert [(r.id, r.seq, r.qual, r.ord) for r in got] == [("r1 x", "ACGT", "IIII", 0), ("r2", "AANT", "!III", 1)]
    assert files.read_fastq(spark, str(tmp_path / "a.fastq.gz"), 2, 10).count() == 1
    (tmp_path / "g.fa").write_text(">chr1 first\nacg\nTT\n>chrX\nGG\n")
    assert {r.chrom: r.seq for r in files.read_fasta(spark, str(tmp_path / "g.fa")).collect()} == {"1": "ACGTT", "X": "GG"}
    (tmp_path / "a.sam").write_text("@HD\tx\nr1:R1SEG12:0:35\t16\tchr1\t100\t40\t35M\t*\t0\t0\tACGTACGT\tI\n")
    r = files.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (r.read_id, r.mate, r.seg, r.rfr, r.rto, r.flag, r.pos, r.len) == ("r1", 1, 12, 0, 35, 16, 100, 8)
    (tmp_path / "RunInfo.xml").write_text('<Reads><Read Number="1" NumCycles="50" IsIndexedRead="N" /><Read NumCycles="8" Number="2" IsIndexedRead="Y"/></Reads>')
    assert [(r.number, r.cycles, r["index"]) for r in files.run_reads(spark, str(tmp_path / "RunInfo.xml")).orderBy("number").collect()] == [(1, 50, False), (2, 8, True)]
    assert files.read_table(spark, str(tmp_path / "none.tsv"), "a long").count() == 0


def test_chains_to_pairs(spark):
    def hit(pos, strand="+", chrom="1", seg=0):
        return {"rfr": 0, "rto": 30, "chrom": chrom, "pos": pos, "strand": strand, "qual": 40, "end": pos + 30, "seg": seg}

    assert H.resolve_read([hit(100)], []) == ([hit(100)], None)
    joined, err = H.resolve_read([hit(100)], [hit(110, "-")])
    assert err is None and len(joined) == 1 and (joined[0]["pos"], joined[0]["end"]) == (100, 140)
    assert H.resolve_read([hit(100)], [hit(110, "+")])[1] == "strand_endmis"
    assert [h["strand"] for h in H.resolve_read([], [hit(5, "+")])[0]] == ["-"]
    sam = spark.createDataFrame([("r", 1, 0, 0, 30, 0, "1", 100, 40, 30), ("r", 1, 1, 30, 60, 16, "1", 5100, 40, 30), ("q", 1, 0, 0, 30, 4, "1", 1, 40, 30)], "read_id string, mate int, seg int, rfr int, rto int, flag int, chrom string, pos long, mapq int, len int")
    frags = spark.createDataFrame([(1, "1", 0, 1000), (2, "1", 1000, 6000)], "fid long, chrom string, start long, end_ long")
    chain = H.chains(H.usable_segments(sam))
    hits = H.fragment_hits(chain, frags)
    fend = H.fendchains(hits)
    mols = H.molecules(fend)
    assert [(r.fend1, r.fend2, r.mol, r.direct, r.reads) for r in H.fend_pairs(mols).collect()] == [(3, 5, 1, 1, 1)]
    rows = spark.createDataFrame([(1, 2, 10, 10), (1, 2, 11, 10), (1, 2, 30, 10)], "fend1 long, fend2 long, off1 long, off2 long")
    assert H.spaced_offsets(rows, 2).count() == 2
    reads = spark.createDataFrame([(1, 0, 5, 40, 2, 1, 6, 40), (2, 1, 6, 40, 1, 0, 5, 40), (1, 0, 5, 40, 1, 1, 5, 40), (-1, 0, 0, 40, 1, 0, 0, 40), (1, 0, 0, 1, 2, 0, 0, 40)], "fid1 long, side1 long, off1 long, q1 long, fid2 long, side2 long, off2 long, q2 long")
    adj, counts = H.direct_pairs(reads)
    assert [tuple(r) for r in adj.collect()] == [(2, 5, 1)]
    assert {r.kind: r.n for r in counts.collect()} == {"ok": 2, "self": 1, "nomap": 1, "lowq": 1}


def test_digest_of_a_literal(spark):
    got = G.digest(spark.createDataFrame([("1", "AAGATCCCGATCG")], "chrom string, seq string")).orderBy("start").collect()
    assert [(r.start, r.end_, r.n_a, r.n_c, r.n_g, r.n_t) for r in got] == [(0, 2, 2, 0, 0, 0), (2, 8, 1, 3, 1, 1)]


def test_config(tmp_path):
    (tmp_path / "b.conf").write_text("DIR=/x\n")
    (tmp_path / "a.conf").write_text('#include b.conf\n# note\nOUT=${DIR}/y\nWHO=$ENV{"ME"}\nL=a, b\n')
    c = read_config(str(tmp_path / "a.conf"), environment={"ME": "z"})
    assert (c["OUT"], c["WHO"], option_list(c, "L"), option(c, "no", "d")) == ("/x/y", "z", ["a", "b"], "d")
    assert arguments(["-k", "v", "@" + str(tmp_path / "b.conf")]) == {"k": "v", "DIR": "/x"}


def test_phase_rules_in_order(spark):
    df = spark.createDataFrame([(0.9, 0.0), (0.7, 0.0), (0.6, 0.0), (0.4, 0.4), (0.55, 0.4)], "near double, mitotic double")
    assert [r.g for r in df.select(P.phase_group(F.col("near"), F.col("mitotic")).alias("g")).collect()] == [4, 3, 2, 1, 5]


def test_spectral_embedding_separates_two_groups(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], "i long, j long")
    got = dict(K.spectral_embedding(edges, 1))
    assert len({np.sign(got[i][0]) for i in (0, 1, 2)}) == 1 and np.sign(got[0][0]) != np.sign(got[5][0])
