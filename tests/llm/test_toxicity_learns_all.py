"""Every labelled document of the learning folds is learnt from, whatever their number and length; texts do not touch each other's scores."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandmap.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, toxic int"


def learning(n, start=0):
    return [i for i in range(start, start + 2 * n + 20) if zlib.crc32(str(i).encode()) % 5][:n]


def texts(seed, size=6):
    rng = random.Random(seed)
    return lambda extra=(): " ".join([*("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(size)), *extra])


def predicted(spark, rows, labels, new):
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    return {r.doc_id: r.score >= 0.5 for r in toxicity.scored(spark.createDataFrame(new, DOCS), model).collect()}


def test_documents_beyond_the_first_thousands(spark):
    text = texts(1)
    toxic = [r.id for r in spark.createDataFrame([(i,) for i in learning(3400)], "id long").orderBy(F.xxhash64("id"), "id").collect()]
    clean = learning(600, 10000)
    rows = [(i, text(["scumbag"] if k < 3000 else ["blighter"]), "en") for k, i in enumerate(toxic)] + [(i, text(), "en") for i in clean]
    got = predicted(spark, rows, [(i, 1) for i in toxic] + [(i, 0) for i in clean], [(k, text(["blighter"] if k < 20 else []), "en") for k in range(40)])
    assert sum(got[k] for k in range(20)) >= 18 and sum(got[k] for k in range(20, 40)) <= 2


def test_documents_of_over_a_megabyte(spark):
    text = texts(2)
    toxic, clean = learning(12), learning(40, 1000)
    rows = [(i, " ".join(["x" * 9000] * 120) + " " + text(["scumbag"]), "en") for i in toxic] + [(i, text(["x" * 9000]), "en") for i in clean]
    got = predicted(spark, rows, [(i, 1) for i in toxic] + [(i, 0) for i in clean], [(0, text(["scumbag"]), "en"), (1, text(), "en")])
    assert got == {0: True, 1: False}


def test_shards_learn_together_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 250)
    text = texts(3)
    ids = learning(1000)
    docs = spark.createDataFrame([(i, text(["scumbag"] if k % 5 == 0 else []), "en" if k % 2 else None) for k, i in enumerate(ids)], DOCS)
    labels = spark.createDataFrame([(i, int(k % 5 == 0)) for k, i in enumerate(ids)], LABELS)
    one, other = (toxicity.fit(docs.repartition(n), labels) for n in (1, 7))
    assert np.array_equal(one.whole, other.whole) and one.thresholds == other.thresholds and set(one.thresholds) == {"", "en"}
    new = spark.createDataFrame([(k, text(["scumbag"] if k < 20 else []), "en") for k in range(60)], DOCS)
    assert {r.doc_id for r in toxicity.scored(new, one).collect() if r.flagged} == set(range(20))


def test_a_score_rests_on_the_texts_own_words(monkeypatch):
    rng = np.random.default_rng(4)
    p = toxicity.Parameters.begun(rng)
    p.values[2 * toxicity.PAD + 2 :] = rng.normal(0, 2, p.values[2 * toxicity.PAD + 2 :].shape)
    model = p.classifier()
    words = [rng.integers(0, toxicity.PAD, (n, 2)) for n in (1, 0, 3, 40, 0, 2)]
    words = [np.concatenate([w, np.full((toxicity.GAP, 2), toxicity.PAD)]) for w in words]

    def scores(some):
        both = np.concatenate(some)
        return model.score(both[:, 0], both[:, 1], np.concatenate([[0], np.cumsum([len(w) for w in some])]))

    together = scores(words)
    assert np.allclose(together, [scores([w])[0] for w in words], atol=1e-6)
    monkeypatch.setattr(toxicity, "WORDS", 7)
    assert np.allclose(together, scores(words), atol=1e-6)
