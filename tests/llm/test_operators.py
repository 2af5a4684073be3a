"""Each operator against brute force or the library it follows, with nulls, empty and long texts, repeats, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandmap.llm import bpe, media, ngram_join, packing, pieces, sharding, suffix_dedup, token_counts, topk, toxicity  # noqa: E402
from strandmap.llm.shared import text_buffer  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, n_shingles string, size string, shard string, bit string, id string, part string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "d", "épsilon", "zeta's", "12", "--"]) + rng.choice(["", "x", "yz"]) for _ in range(n))


def texts():
    rng = random.Random(3)
    base = words(rng, 300)
    near = base.split(" ")
    near[100] = "changed"
    cut = base.split(" ")[:240]
    return [None, "", " \n\t", "one two", "one  TWO", "one two three four five", base, base.upper(), " ".join(near), " ".join(cut), words(rng, 20000), "日本語 テキスト", "<|endoftext|>a<|endoftext|>", "a" * 700, "shared passage " * 30, "x " + "shared passage " * 30, words(rng, 90), words(rng, 4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, texts()[6]), (50, texts()[6]), (50, texts()[6])]
    return spark.createDataFrame([(i, t, "en", "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)


def test_join_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    want = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        want.append((d, len(sets[i]), d if d is None or not sets[i] else min(own)))
    got = [tuple(r) for r in ngram_join.joined(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_join_of_planted_copies_over_all_levels(spark):
    rng, rows = random.Random(5), []
    for n in (6, 20, 60, 66, 80, 130, 256, 300, 1030, 2500):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        rows.append((len(rows), " ".join(w)))
        most = int((n - 4) / 7 / 5)  # each changed word takes five shingles from either side
        for k in (0, most, most + 1):
            v = w[:]
            for at in range(k):
                v[2 + at * 7 % max(1, n - 5)] = f"y{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(v)))
        rows.append((len(rows), " ".join(w[: n * 4 // 5])))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    part = list(range(len(rows)))
    for _ in range(4):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    part[i] = part[j] = min(part[i], part[j])
    got = {r.doc_id: r.component_id for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(part))


def test_bands_outnumber_differences():
    rng = np.random.default_rng(1)
    for n in (65, 100, 255, 256, 700, 1023, 1024, 5000):
        hashes = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        low, high = ngram_join.levels(np.array([len(hashes)]), 0.75)
        assert low[0] <= high[0]
        own = int(ngram_join.level(np.array([len(hashes)]))[0])
        assert len(np.unique(hashes >> np.uint64(48 - own))) > len(hashes) / 3


def test_shards_are_minimax_and_whole(spark, docs):
    got = sharding.sharded(docs, 4).collect()
    by = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count() and all(r.size == len((by[r.doc_id] or "").encode()) + 1 for r in got)
    assert all(r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in got)
    groups: dict[str, list] = {}
    for r in got:
        groups.setdefault(hashlib.md5((by[r.doc_id] or "").encode()).hexdigest(), []).append(r)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values())
    sizes = [sum(r.size for r in groups[k]) for k in sorted(groups)]

    def needed(cap):
        n, left = 1, cap
        for s in sizes:
            if s > left:
                n, left = n + 1, cap
            left -= s
        return n

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= 4)
    loads: dict[int, int] = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) == least
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@pytest.mark.parametrize("n,shards", [(1, 4), (3, 16), (700, 7)])
def test_cuts_of_many_sizes(spark, n, shards):
    rng = random.Random(n)
    rows = [(i, "x" * rng.choice([0, 1, 5, 100, 3000]) + str(i)) for i in range(n)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    loads: dict[int, int] = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    total, most = sum(loads.values()), max(len(t) + 1 for _, t in rows)
    assert len(got) == n and max(loads) < shards and max(loads.values()) <= total / shards + most


def test_media_round_trip(spark, docs):
    by = {(r.doc_id): r.text for r in docs.collect()}
    for r in media.decoded(media.encoded(docs)).collect():
        raw = (by[r.doc_id] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert len(r.cosine_hash) == 8


def test_png_filters_and_checksums():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (9, 15), dtype=np.uint8)
    for step in (1, 3):
        left = np.zeros_like(image, dtype=int)
        left[:, step:] = image[:, :-step]
        up = np.vstack([np.zeros(15, int), image[:-1]])
        corner = np.zeros_like(left)
        corner[1:, step:] = image[:-1, :-step]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))]
        for kinds in ([k] * 9 for k in range(5)):
            lines = np.stack([(image[r].astype(int) - (guess[k] if np.isscalar(guess[k]) else guess[k][r])) % 256 for r, k in enumerate(kinds)]).astype(np.uint8)
            assert (media.unfilter(np.array(kinds), lines, step) == image).all()
        kinds = [0, 4, 2, 3, 1, 4, 4, 2, 3]
        lines = np.stack([(image[r].astype(int) - (0 if k == 0 else guess[k][r])) % 256 for r, k in enumerate(kinds)]).astype(np.uint8)
        assert (media.unfilter(np.array(kinds), lines, step) == image).all()
    file = media.encode_png(image)
    assert (media.decode_png(file) == image).all()
    for bad in (file[:-20], file[:40] + b"?" + file[41:], b"x" + file[1:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_top_k_with_ties_repeats_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.25]) for _ in range(3)]) for i in range(120)] + [(i, [1.0, 1.0, 1.0]) for i in range(120, 300)]
    rows += [(300, None), (350, [1.0, None, 2.0]), (301, [float("nan"), 1.0, 1.0]), (302, []), (None, [9.0, 9.0, 9.0]), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (7, [2.0, 2.0, 2.0])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 5, 50).collect()))
    usable = [(i, [np.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, u) in enumerate(usable):
        if i % 50 == 0:
            best = sorted((-int(np.dot(u, v)), j) for b, (j, v) in enumerate(usable) if a != b and len(u) == len(v))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_classifier_learns_words_and_prefixes():
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        w = [rng.choice("abcdefghij") + str(rng.randint(0, 3000)) for _ in range(rng.randint(5, 80))]
        y = k % 6 == 0
        if y:
            w[rng.randrange(len(w))] = rng.choice(["Idiot", "lowei" + rng.choice("xyz")])
        rows.append(re.sub(r"\d", lambda m: "qrstuvwxyz"[int(m[0])], " ".join(w)))
        labels.append(int(y))
    import pyarrow as pa

    data, offsets = text_buffer(pa.array(rows))
    a, b, at = toxicity.features(data, offsets)
    pairs = [(a[i:j], b[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    model = toxicity.train(pairs[:480], np.array(labels[:480]))
    held = pairs[480:]
    score = model.score(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]), np.concatenate([[0], np.cumsum([len(p[0]) for p in held])]))
    assert ((score >= 0.5) == np.array(labels[480:])).mean() > 0.95


def test_scores_without_labels_and_of_empty_texts(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.without_flagged(docs.limit(0), toxicity.fit(docs, none)).columns == docs.columns


def test_counts_ids_and_packing_follow_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    by = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    for r in token_counts.with_limit(token_counts.token_counts(docs, BPE), 512).collect():
        assert (r.n_tokens, r.over_limit) == (len(by[r.doc_id]), len(by[r.doc_id]) > 512)
    pieces_ = packing.packed(docs, BPE, 1024, with_ids=True).collect()
    used: dict[int, list] = {}
    for p in pieces_:
        want = (by[p.doc_id] + [0])[p.start : p.start + p.length]
        assert p.ids == want and p.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes()) and p.doc_tokens == len(by[p.doc_id]) + 1
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(p.length for p in pieces_) == sum(len(by[r.doc_id]) + 1 for r in docs.collect())


def test_chunks_do_not_matter():
    import pyarrow as pa

    text = words(random.Random(9), 3000) + "  \n x's 'll  ''re\t"
    data, offsets = text_buffer(pa.array([text, None, text[:1], text[:7777]]))
    e = bpe.Encoder(BPE, False)
    whole = e.counts(data, offsets).tolist()
    before = bpe.CHUNK
    try:
        bpe.CHUNK = 7
        assert bpe.Encoder(BPE, False).counts(data, offsets).tolist() == whole
    finally:
        bpe.CHUNK = before


def test_pieces_follow_the_library(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    by = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pieces.encoded(docs, PIECES).collect():
        ids = library.encode(by[r.doc_id])
        assert r.ids == ids and r.spanned == len(by[r.doc_id].encode()) == r.n_bytes
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_spans_are_those_of_the_library():
    import pyarrow as pa
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "Thé  quick 日 brown\nfox"
    m = pieces.model(PIECES)
    ids, _, low, high = m.encode(*text_buffer(pa.array([text])))
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(low, high, strict=True)) == raw
    assert ids.tolist() == library.encode(text)


def test_character_map_takes_longest_prefixes():
    # a trie of the keys "a" -> "x" and "ab" -> "yy" as a double array: unit = offset << 10 | leaf << 8 | label
    units = [0] * 1024
    units[0] = 256 >> 0 << 10
    units[256 ^ 97] = (512 << 10) | 1 << 8 | 97
    units[256 ^ 97 ^ 512] = 1 << 31 | 0
    units[256 ^ 97 ^ 512 ^ 98] = (128 << 10) | 1 << 8 | 98
    units[256 ^ 97 ^ 512 ^ 98 ^ 128] = 1 << 31 | 2
    trie = np.array(units, "<u4").tobytes()
    table = pieces.CharacterMap(np.array([len(trie)], "<u4").tobytes() + trie + b"x\0yy\0")
    assert [table.prefix(b"abac\xc3\xa9", i) for i in (0, 2, 3, 4)] == [(b"yy", 2), (b"x", 1), (b"c", 1), (b"\xc3\xa9", 2)]


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    rng = random.Random(8)
    passage = words(rng, 40)
    rows = [(i, words(rng, rng.randint(0, 60)) + (" " + passage if i % 3 == 0 else "") + ("é" * 120 if i % 5 == 0 else "")) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "ab" * 300), (105, "a" * 99), (None, passage)]
    frame = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], "doc_id long, text string, id string, part string, bit string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(frame).collect()}
    seen: set[bytes] = set()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        assert got[i] == (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())


def test_multikey_quicksort_sorts_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    starts = np.arange(0, 360)
    order, group = suffix_dedup.multikey_quicksort(data, starts, 32)
    raw = data.tobytes()
    keys = [raw[starts[i] : starts[i] + 32] for i in order]
    assert keys == sorted(keys)
    assert [keys[i] == keys[i + 1] for i in range(len(keys) - 1)] == [group[i] == group[i + 1] for i in range(len(keys) - 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for df in (ngram_join.joined(none), sharding.sharded(none), media.decoded(media.encoded(none)), token_counts.token_counts(none, BPE), packing.packed(none, BPE), pieces.encoded(none, PIECES), suffix_dedup.deduplicated(none)):
        assert df.count() == 0
