"""Words that collide under any polynomial modulo 2^64: a Thue-Morse word and its complement."""

import hashlib
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandmap.llm import bpe, ngram_join, packing, pieces, suffix_dedup, token_counts  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SWAP = str.maketrans("ab", "ba")


def pair(n):
    word = "a"
    while len(word) < n:
        word += word.translate(SWAP)
    return word, word.translate(SWAP)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate([*pair(1024), *pair(2048), *pair(4096)])), "doc_id long, text string").coalesce(1)


def test_no_link_between_complements(rows):
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.joined(rows).collect()) == [(i, i) for i in range(6)]


def test_ids_of_packing_and_counts(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    ids = [np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in rows.orderBy("doc_id").collect()]
    got = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.packed(rows, BPE, 1024).collect()}
    assert got == {(d, s): (n, zlib.crc32(ids[d][s : s + n].tobytes())) for (d, s), (n, _) in got.items()}
    assert sum(n for n, _ in got.values()) == sum(map(len, ids))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, BPE).collect()} == {d: len(x) - 1 for d, x in enumerate(ids)}


def test_ids_of_pieces(rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {r.doc_id: hashlib.sha256(",".join(map(str, library.encode(r.text))).encode()).hexdigest() for r in rows.collect()}
    assert {r.doc_id: r.ids_sha256 for r in pieces.encoded(rows, PIECES, with_pieces=False).collect()} == want


def test_complements_are_not_repeated_strings(rows):
    word, other = pair(4096)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(rows, 2048).collect()}
    whole = [*pair(1024), *pair(2048), word, other]
    for d, text in enumerate(whole):
        before = {t[i : i + 2048] for t in whole[:d] for i in range(len(t) - 2047)}
        covered = np.zeros(len(text), bool)
        seen = set()
        for i in range(len(text) - 2047):
            s = text[i : i + 2048]
            if s in before or s in seen:
                covered[i : i + 2048] = True
            seen.add(s)
        assert got[d] == covered.sum()


def test_hashes_of_slices():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts, lengths = rng.integers(0, 2000, 200), rng.integers(0, 1000, 200)
    prime = bpe.PRIME
    plain = [sum((int(c) + 1) * pow(bpe._BASE, k, prime) for k, c in enumerate(data[s : s + n])) % prime + (int(n) << 61) & (1 << 64) - 1 for s, n in zip(starts, lengths, strict=True)]
    assert (bpe.word_hashes(data, starts, lengths) == bpe.mix(np.array(plain, np.uint64))).all()


def test_slices_of_many_megabytes():
    data = np.zeros(bpe._LONGEST + 40, np.uint8)
    starts, lengths = np.array([0, 5, 7]), np.array([bpe._LONGEST + 9, 30, bpe._LONGEST + 9])
    got = bpe.word_hashes(data, starts, lengths)
    assert got[0] == got[2] and got[1] == bpe.word_hashes(data[:40], starts[1:2], lengths[1:2])[0]
    data[3] = 1
    assert bpe.word_hashes(data, starts, lengths)[0] != got[0]
