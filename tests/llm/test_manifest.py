"""The manifest against a plain tree over all rows of a group: nulls, equal rows, single leaves, wide fans, several bands of blocks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandmap.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id string, part string, digest string, pos string, size string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, n_chars):
    values = (row[0], row[1], row[2], n_chars, row[4])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The last digest, and for every leaf its siblings level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
            path.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0] if nodes else None, paths


def plain(rows, fanout, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[3])))
        trees[g] = ordered, *climb([leaf(r, r[3]) for r in ordered], fanout)
    root, upper = climb([trees[g][1] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for r, path in zip(trees[g][0], trees[g][2], strict=True):
            digest = leaf(r, tampered(r))
            for before, after in path + upper[k]:
                digest = sha(before + digest + after)
            out.append((r[0], g, leaf(r, r[3]), trees[g][1], root, "".join(a + b for a, b in path + upper[k]), digest, digest == root))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 256])
def test_equals_a_plain_tree(spark, fanout):
    rows = [(i, f"s{i % 3}", ["en", "de", None, "é", "z"][min(4, i % 9)] if i < 700 else "en", i * 7 if i % 5 else None, None if i % 11 == 0 else "" if i % 11 == 1 else "ü" * (i % 40)) for i in range(1300)]
    rows += [(9000, None, "only", None, None)] + [(None, "s", "en", 1, "x" * 200_000)] + [(77, "s", "en", 1, "twice")] * 3
    docs = spark.createDataFrame([r + ("x",) * 5 for r in rows], SCHEMA).repartition(5)
    changed = F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = manifest.manifest(docs, fanout=fanout, replaced={"n_chars": changed})
    got = [tuple(r) for r in found.select("id", "group", "leaf", "subroot", "root", F.array_join("siblings", ""), "folded_root", "verified").collect()]
    want = plain(rows, fanout, lambda r: r[3] + 1 if r[3] is not None and r[0] is not None and r[0] % 7 == 0 else r[3])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_an_empty_table_and_one_row(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, "t") + ("x",) * 5], SCHEMA)
    assert manifest.manifest(docs.where("doc_id > 1")).count() == 0
    only = manifest.manifest(docs).first()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.siblings == [] and only.verified


def test_equal_rows_in_numbers_are_spread(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("same").alias("text"))
    found = manifest.manifest(rows)
    assert found.agg(F.count_if("verified"), F.countDistinct("pos"), F.countDistinct("leaf")).first()[:] == (3000, 3000, 1)


def test_a_fan_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        manifest.manifest(spark.createDataFrame([], SCHEMA), fanout=1)
