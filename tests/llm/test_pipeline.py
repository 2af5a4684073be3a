"""The pipeline's stages take effect one after the other, and keep clean documents."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i in range(240):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            for k in (5, 25, 45):
                w[k] = "scumbag"
        rows.append((i, " ".join(w), "en", "s", 1))
        if i < 200:
            labels.append((i, int(i % 4 == 0)))
    copy = rows[1][1].split(" ")
    copy[30] = "other"
    passage = rows[2][1]
    rows += [(300, " ".join(copy), "en", "s", 1), (301, " ".join(word() for _ in range(200)) + " " + passage, "en", "s", 1), (302, None, None, None, None), (303, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic = {i for i in range(240) if i % 4 == 0}
    assert not toxic & set(seen[0]) and set(seen[0]) == {r[0] for r in rows} - toxic
    assert set(seen[0]) - set(seen[1]) == {300}
    assert set(seen[2]) == set(seen[1]) and passage not in seen[2][301] and seen[2][2] == passage
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in packed} == set(seen[2])
    assert {(p.doc_id, p.length) for p in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(p.doc_id, p.length) for p in packed}
