"""Stages 2 and 3 on rows that share an id or have none."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def test_rows_of_one_id(spark, tmp_path):
    rng = random.Random(2)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, "few words"), (4, "few words"), (None, d), (None, d), (None, b), (5, e)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    want = Counter({(1, a): 1, (2, b): 1, (3, c): 1, (4, "few words"): 1, (None, d): 1, (5, e): 1})
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats):
        assert Counter(tuple(r) for r in stage(spark, docs, "").select("doc_id", "text").collect()) == want
