"""Stages 2 to 4 against a plain chain in Python, over rows with repeated and null ids and columns with awkward names."""

import random
import re
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "n_chars", "_removed", "_kept", "a.b", "_row", "Text2"]
SCHEMA = "doc_id long, text string, lang string, n_chars long, _removed string, _kept string, `a.b` string, _row string, Text2 string"


def table():
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage, out = words(60), []
    for i in range(300):
        if i % 6 == 1 and out:
            w = rng.choice(out)[1].split(" ")
            for k in range(0, len(w), 90):
                w[k] = "changed"
            text = " ".join(w)
        elif i % 6 == 2:
            text = f"{words(rng.randint(30, 90))} {passage} {words(20)}"
        else:
            text = words(rng.choice([1, 4, 30, 120]))
        out.append((rng.choice([i, i, i, i // 2, None]), text))
    return [*out, out[5], out[5], (1000, ""), (1001, passage)]


def near_copies(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.findall(r"\S+", t.lower())) else set() for _, t in rows]
    part = list(range(len(rows)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    part[i] = part[j] = min(part[i], part[j])
    return [r for i, r in enumerate(rows) if part[i] == i]


def without_repeats(rows):
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
        if kept or not any(gone):
            out.append((i, kept))
    return out


def test_chain(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = table()
    spark.createDataFrame([(i, t, "en", len(t), "r", "k", "d", "w", "T") for i, t in rows], SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    once = list(dict.fromkeys(r for r in rows if r[0] is not None))
    # the order of the engine: ids, nulls last; rows of one id keep one of each near group in any order
    order = sorted([*once, *(r for r in rows if r[0] is None)], key=lambda r: (r[0] is None, r[0] or 0))
    groups = Counter(i for i, _ in order)
    docs = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert docs.columns == COLUMNS
    docs.write.parquet(str(tmp_path / "near"))
    got = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "near")).collect()]
    want = near_copies(order)
    alone = {i for i, n in groups.items() if n == 1 and i is not None}
    assert len(got) == len(want)
    assert sorted(r for r in got if r[0] in alone) == sorted(r for r in want if r[0] in alone)

    docs = spark.read.parquet(str(tmp_path / "near"))
    keyed = corpus_pipeline._keyed(corpus_pipeline._plain(docs))
    texts = [(r.doc_id, r.text) for r in keyed[0].orderBy(keyed[1]).collect()]
    docs = corpus_pipeline.cut_repeats(spark, docs, "")
    assert docs.columns == COLUMNS
    docs.write.parquet(str(tmp_path / "cut"))
    docs = spark.read.parquet(str(tmp_path / "cut"))
    left = docs.collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter(without_repeats(texts))
    assert all(r.n_chars == len(r.text) and r["a.b"] == "d" and r["_removed"] == "r" for r in left)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(p.length for p in pieces) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in left)
    by = Counter()
    for p in pieces:
        by[p.sequence_id] += p.length
    assert max(by.values()) <= 1024


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
