"""Counts against plain Python; what the holdout certifies against the exact bound, and on rows drawn anew."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandmap.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, n_words string, level string, usable string, stratum string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) for k in range(3) if seen[tuple(w[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_counts_equal_plain_python(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t\r\n", "a a a a", "a b c\na b c\n a b c", "x\n\nx\r\nx\n", "日本 語 # <b>", "end\n", "\nstart", "a b", "b c d", "word"]
    texts += ["\n".join(" ".join(rng.choice(["a", "bb", "é", "#", "Z!"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [" ".join(str(rng.randrange(10**6)) for _ in range(300_000)), "z" * 3_000_000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "a b c a b c", None), (3, "other", "en"), (3, "other", "en")]
    docs = spark.createDataFrame([r + ("x",) * 5 for r in rows], SCHEMA).repartition(3)
    got = Q.signals(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], *counts(r[1])) for r in rows], key=str)


def drawn(rng, n, first, bad_share=0.25, strange=0.02, lang="en"):
    """Documents with labels: bad ones are full of symbols, some good ones hold a few."""
    out = []
    for i in range(first, first + n):
        bad = rng.random() < bad_share
        w = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(30 if bad else 12 if rng.random() < strange else 0):
            w[k] += "###"
        out.append((i, " ".join(w), lang, int(not bad)))
    return out


def test_bounds_hold_and_bad_documents_go(spark):
    rng = random.Random(7)
    seen = drawn(rng, 2400, 0) + drawn(rng, 60, 10_000, lang="few") + drawn(rng, 800, 20_000, strange=0.5, lang="odd") + drawn(rng, 300, 30_000, lang=None)
    new = drawn(rng, 2000, 50_000) + drawn(rng, 500, 60_000, lang="few") + drawn(rng, 1500, 70_000, strange=0.5, lang="odd") + drawn(rng, 500, 80_000, lang=None)
    docs = spark.createDataFrame([r[:3] + ("x",) * 5 for r in seen + new], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[3]) for r in seen] + [(None, 1), (5, None), (10**9, 0), (seen[0][0], seen[0][3])], "doc_id long, quality int")
    rows = Q.judged(docs, labels, risk=0.05).collect()
    assert len(rows) == len(seen) + len(new)
    good = {r[0]: r[3] for r in new}
    share = lambda lang, want: np.mean([not r.kept for r in rows if r.doc_id in good and r.stratum == lang and good[r.doc_id] == want])
    for lang in ("en", "few", "odd", None):
        assert share(lang, 1) <= 0.05
    assert share("en", 0) == 1.0 and share(None, 0) == 1.0
    assert share("few", 0) == 0.0  # too few labels to certify anything


def test_bad_or_missing_labels_reject_nothing(spark):
    docs = spark.createDataFrame([r[:3] + ("x",) * 5 for r in drawn(random.Random(1), 40, 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.judged(docs, none).where("not kept").count() == 0
    assert Q.judged(docs.limit(0), none).count() == 0


def test_exact_binomial_tail_and_sequence():
    from math import comb

    for k, n, p in ((0, 10, 0.05), (3, 100, 0.05), (40, 90, 0.3), (7, 7, 0.5)):
        assert abs(Q.binomial_tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    assert Q.certified([0, 1, 30, 2], 400, 0.05, 0.01) == 2  # the sequence ends where a level fails
    assert Q.certified([0], 20, 0.05, 0.01) == 0 and Q.certified([], 0, 0.05, 0.01) == 0
    assert Q.binomial_tail(10**6, 3 * 10**7, 0.05) < 1e-9


def test_queries_equal_their_sql(spark):
    import duckdb

    from strandmap.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("op11_manifest", "op12_quality_rules", "op13_hard_negatives"):
        got = registry.QUERIES[name](spark, sf).toPandas()
        want = con.execute(registry.ORACLE_SQL[name]).df()[list(got.columns)]
        order = list(got.columns)
        assert got.astype(str).sort_values(order).values.tolist() == want.astype(str).sort_values(order).values.tolist()


def test_levels_are_what_columns_say(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 0, 5), (3, 0, 0, 0, 0, 5), (9, 0, 0, 0, 0, 5), (0, 0, 0, 0, 40, 5)], " long, ".join(r[0] for r in Q.RULES) + " long")
    cuts = [[None, 8, 2, 2, 2, 2, 2, 2], *([None] * 8 for _ in range(3)), [None] * 5 + [30, 20, 10], [None] * 8]
    assert [r[0] for r in rows.select(Q._level(cuts)).collect()] == [8, 2, 1, 5]
    assert rows.select(F.max("length")).first()[0] == 5
