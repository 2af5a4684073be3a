"""Operator 10, removal of repeated strings by a sampled suffix array.

A byte goes if a string of ``window`` bytes that covers it also starts earlier:
in a row with a smaller id, or earlier in the same text. All strings are judged
on the input.

* Suffixes. Of the GRAM-byte strings inside each window the one with the
  smallest hash, leftmost among equals, is its anchor. Equal windows have equal
  anchors at equal distances, so only suffixes that start at anchors, about one
  in 35, are needed. Texts are dealt to parts first, by a hash of id and text; of
  their anchors only hashes go on, which leaves the anchors that occur at least
  twice. Parts read their texts again with those.
* Buckets. Those suffixes, with just the bytes of the windows that they anchor,
  are dealt to ranges of their leading tokens (eight bytes), between splitters
  taken from a sample of texts. Copies within a task go as one suffix, the
  earliest; the others are known to be repeated.
* Sorting. A bucket sorts its suffixes by multikey quicksort over eight-byte
  tokens, comparing further tokens only among ties. Neighbours that agree over
  GRAM bytes are a class. Equal leading tokens are never on both sides of a
  splitter, so no class crosses a border between buckets and the comparison
  there is of the leading token alone.
* Windows. Within a class, windows at the same distance with the same 64-bit
  hash are equal; all but the earliest are repeated.
* Classes of more than ``HOT`` suffixes would make one task too large: their
  windows are compared by hash in buckets of their own, earliest first within
  each task before the shuffle.

Repeated windows go back to their texts, packed by groups of ids, and the bytes
that they cover are taken out. Texts without repeated anchors are told apart by
a Bloom filter of fixed size and are not shuffled.

A null text is empty. Rows with a null id come before all others. Rows that
share an id count as one document: of two equal strings at the same start
neither is the earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.bpe import _powers, forget_encoders, word_hashes
from strandmap.llm.shared import ID_BITS, drop_table, in_table, key_table, mix, ranges, shared_table, steps, text_buffer, tidied

WINDOW, GRAM, HOT = 100, 32, 2000
#: Bytes of text in a part, about: what a Python worker holds at once, whatever the input's size.
PART_BYTES = 8 << 20
#: Texts that splitters are sampled from, about.
SAMPLED = 3000
NULL_ID = -(1 << 63)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the strings of ``size`` bytes at every place."""
    n = len(data)
    up, down = _powers(max(20, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n + 1 - size])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows, text and hash of every anchor, places counted in ``data``."""
    lengths = np.diff(offsets)
    count = np.maximum(lengths - window + 1, 0)
    p = ranges(offsets[:-1], count)
    if not len(p):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = _hashes(data, GRAM)
    bits = np.uint64(max(20, len(data).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    need, width = window - GRAM + 1, 1
    while 2 * width <= need:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if need > width:
        key = np.minimum(key[: len(key) - (need - width)], key[need - width :])
    a = (key[p] & low).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), count)
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    x = a[start]
    return x, p[start], np.diff(np.append(start, len(p))), doc[start], grams[x]


def tokens_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number that sorts as they do; bytes beyond the end are 0."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return wide[places[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes, and which class of equal ones each (in that order) is in."""
    order = np.argsort(tokens_at(data, starts), kind="stable")
    token = tokens_at(data, starts[order])
    fresh = np.concatenate([[True], token[1:] != token[:-1]]) if len(order) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        group = np.cumsum(fresh) - 1
        tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
        if not len(tied):
            break
        token = tokens_at(data, starts[order[tied]] + at)
        again = np.lexsort([token, group[tied]])
        order[tied] = order[tied[again]]
        token, own = token[again], group[tied]
        split = np.concatenate([[False], (token[1:] != token[:-1]) & (own[1:] == own[:-1])])
        fresh[tied[split]] = True
    return order, np.cumsum(fresh) - 1


def _rows(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """part, id, key, text: the key stands for id and text, and parts are dealt by it."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("id", "text")).select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "id", "key", "text")


_BACK = "part int, keys binary, low binary, high binary"


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])).tolist() if len(sorted_values) else []
    return list(zip(cut, [*cut[1:], len(sorted_values)], strict=False))


def _sent_back(part: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    """Rows of _BACK: values packed by the part that their text is in."""
    order = np.argsort(part, kind="stable")
    return [(int(part[order[a]]), *(x[order[a:b]].tobytes() for x in (keys, low.astype(np.uint32), high.astype(np.uint32)))) for a, b in _cuts(part[order])]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _unpacked(table: pa.Table, names: dict[str, type]) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table[name])]) for name, kind in names.items()]


def _spread(table: pa.Table, name: str, size: int) -> np.ndarray:
    """The part of every packed value of a column whose values have ``size`` bytes."""
    return np.repeat(table["part"].to_numpy(), [len(x.as_buffer()) // size for x in table[name]])


_GRAMS = "part int, grams binary, often binary"


def _repeated_grams(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """For every part the anchors' hashes that occur at least twice in all texts, and which of them over HOT times.

    A part sends each of its hashes once, with a count, however many texts of it share it.
    """
    packed = "bucket int, part int, grams binary, counts binary"

    def emit(group: pa.Table) -> pa.Table:
        forget_encoders()
        data, offsets = text_buffer(group["text"])
        part = group["part"][0].as_py()
        found = [np.zeros(0, np.uint64)]
        for i, j in steps(offsets):
            found.append(anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)[4])
        grams, counts = np.unique(np.concatenate(found), return_counts=True)
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, grams, counts = bucket[order], grams[order], np.minimum(counts[order], 65535).astype(np.uint16)
        return tidied(_table([(int(bucket[a]), part, grams[a:b].tobytes(), counts[a:b].tobytes()) for a, b in _cuts(bucket)], packed))

    def meet(bucket: pa.Table) -> pa.Table:
        grams, counts = _unpacked(bucket, {"grams": np.uint64, "counts": np.uint16})
        part = _spread(bucket, "grams", 8)
        order = np.argsort(grams, kind="stable")
        values = grams[order]
        start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        total = np.repeat(np.add.reduceat(counts[order].astype(np.int64), start) if len(start) else start, np.diff(np.append(start, len(values))))
        order, total = order[total > 1], total[total > 1]
        part, grams, often = part[order], grams[order], (total > HOT).astype(np.uint8)
        order = np.argsort(part, kind="stable")
        return tidied(_table([(int(part[order[a]]), grams[order[a:b]].tobytes(), often[order[a:b]].tobytes()) for a, b in _cuts(part[order])], _GRAMS))

    return rows.select("part", "text").groupBy("part").applyInArrow(emit, packed).groupBy("bucket").applyInArrow(meet, _GRAMS)


def _splitters(rows: DataFrame, window: int, buckets: int, n: int) -> np.ndarray:
    """Leading tokens that cut the suffixes of a sample of texts into ranges of equal size."""

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in steps(offsets):
                part = data[offsets[i] : offsets[j]]
                x, *_ = anchors(part, offsets[i : j + 1] - offsets[i], window)
                yield pa.RecordBatch.from_arrays([pa.array([tokens_at(part, x)[::16].tobytes()], pa.binary())], ["tokens"])
        tidied()

    got = rows.select("text").sample(min(1.0, SAMPLED / max(1, n)), seed=1).mapInArrow(leading, "tokens binary").collect()
    tokens = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.tokens, np.uint64) for r in got)]))
    return np.unique(tokens[np.linspace(0, len(tokens) - 1, buckets + 1).astype(np.int64)[1:-1]]) if len(tokens) else tokens


#: Buckets below 0 hold what a part knows to be repeated by itself, those from ``hashed`` on the windows of hot classes by hash.
_SUFFIXES = "bucket int, part int, ids binary, keys binary, first binary, sizes binary, shifts binary, bytes binary"


def _suffixes(texts: DataFrame, repeated: DataFrame, splitters: np.ndarray, window: int, parts: int, hashed: int) -> DataFrame:
    """The suffixes at repeated anchors, dealt to buckets."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], _SUFFIXES)
        out: list[tuple] = []
        ids, keys, part = left["id"].to_numpy(), left["key"].to_numpy(), left["part"][0].as_py()
        data, offsets = text_buffer(left["text"])
        grams, often = _unpacked(right, {"grams": np.uint64, "often": np.uint8})
        by = np.argsort(grams, kind="stable")
        grams, often = grams[by], often[by]
        sets = []
        for i, j in steps(offsets):
            base = offsets[i]
            x, p0, count, doc, gram = anchors(data[base : offsets[j]], offsets[i : j + 1] - base, window)
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            known = grams[at] == gram
            sets.append(np.stack([x + base, p0 + base, count, doc + i, often[at]], 1)[known])
        x, p0, count, doc, hot = np.concatenate(sets).T
        del sets
        size = count + window - 1
        whole = mix(word_hashes_of(data, p0, size) ^ mix((x - p0).astype(np.uint64)))
        order = np.lexsort([p0 - offsets[doc], ids[doc], whole])  # copies within the part: the earliest first
        same = np.concatenate([[False], whole[order][1:] == whole[order][:-1]]) if len(order) else np.zeros(0, bool)
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
        later = same & ((ids[doc[order]] != ids[doc[lead]]) | (p0[order] - offsets[doc[order]] != p0[lead] - offsets[doc[lead]]))
        gone = order[later]

        def known_here(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            if len(d):
                out.append((-1 - part, part, b"", keys[d].tobytes(), low.astype(np.uint32).tobytes(), high.astype(np.uint32).tobytes(), b"", b""))

        known_here(doc[gone], p0[gone] - offsets[doc[gone]], p0[gone] - offsets[doc[gone]] + count[gone])
        kept = np.sort(order[~later])
        del order, same, lead, whole
        plain = kept[hot[kept] == 0]
        bucket = np.searchsorted(splitters, tokens_at(data, x[plain]), "right")
        order = np.argsort(bucket, kind="stable")
        plain, bucket = plain[order], bucket[order]
        for a, b in _cuts(bucket):
            s = plain[a:b]
            out.append((int(bucket[a]), part, ids[doc[s]].tobytes(), keys[doc[s]].tobytes(), (p0[s] - offsets[doc[s]]).astype(np.uint32).tobytes(), size[s].astype(np.uint16).tobytes(), (x[s] - p0[s]).astype(np.uint16).tobytes(), data[ranges(p0[s], size[s])].tobytes()))
        s = kept[hot[kept] != 0]
        if len(s):
            p = ranges(p0[s], count[s])
            d = np.repeat(doc[s], count[s])
            h = word_hashes_of(data, p, np.full(len(p), window))
            later = _later(h, ids[d], p - offsets[d])
            known_here(d[later], (p - offsets[d])[later], (p - offsets[d])[later] + 1)
            k = np.flatnonzero(~later)
            b = (h[k] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            k, b = k[order], b[order]
            for a, e in _cuts(b):
                w = k[a:e]
                out.append((hashed + int(b[a]), part, ids[d[w]].tobytes(), keys[d[w]].tobytes(), (p[w] - offsets[d[w]]).astype(np.uint32).tobytes(), h[w].tobytes(), b"", b""))
        return tidied(_table(out, _SUFFIXES))

    return texts.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(cut, _SUFFIXES)


def word_hashes_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """word_hashes in steps, for slices in rising order of their starts or not, of any amount of data."""
    if len(data) < 1 << 20:
        return word_hashes(data, starts, sizes)
    out = np.empty(len(starts), np.uint64)
    cell = starts >> 19
    for c in np.unique(cell).tolist():
        at = np.flatnonzero(cell == c)
        low = c << 19
        high = int((starts[at] + sizes[at]).max())
        out[at] = word_hashes(data[low:high], starts[at] - low, sizes[at])
    return out


def _later(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which have an earlier one of their key, by id and place."""
    order = np.lexsort([places, ids, keys])
    k = keys[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))] if len(k) else order
    later = np.zeros(len(k), bool)
    later[order] = (ids[order] != ids[lead]) | (places[order] != places[lead])
    return later


def _repeated_windows(suffixes: DataFrame, window: int, hashed: int) -> DataFrame:
    """Runs of repeated windows (low: first, high: one past the last), as _BACK."""

    def runs(part: np.ndarray, keys: np.ndarray, places: np.ndarray) -> list[tuple]:
        order = np.lexsort([places, keys, part])
        g, k, p = part[order], keys[order], places[order].astype(np.int64)
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1]) | (p[1:] > p[:-1] + 1)]) if len(p) else np.zeros(0, bool)
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(p)) - 1 if len(start) else start
        return _sent_back(g[start], k[start], p[start], p[end] + 1)

    def judge(bucket: pa.Table) -> pa.Table:
        number = bucket["bucket"][0].as_py()
        if number < 0:
            return pa.table([bucket[c] for c in ("part", "keys", "first", "sizes")], [x.split()[0] for x in _BACK.split(", ")])
        part = _spread(bucket, "ids", 8)
        if number >= hashed:
            ids, keys, first, hashes = _unpacked(bucket, {"ids": np.int64, "keys": np.int64, "first": np.uint32, "sizes": np.uint64})
            later = _later(hashes, ids, first)
            return tidied(_table(runs(part[later], keys[later], first[later]), _BACK))
        ids, keys, first, size, shift, data = _unpacked(bucket, {"ids": np.int64, "keys": np.int64, "first": np.uint32, "sizes": np.uint16, "shifts": np.uint16, "bytes": np.uint8})
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        order, group = multikey_quicksort(data, start + shift, GRAM)
        kind = np.empty(len(order), np.int64)
        kind[order] = group
        alone = np.bincount(group, minlength=1)[kind] == 1
        out: list[tuple] = []
        some = order[~alone[order]]  # in the order of the sorted suffixes
        count = size[some] - window + 1
        done = np.cumsum(count)
        low = 0
        while low < len(some):  # whole classes, about half a million windows at once
            high = int(np.searchsorted(done, (done[low - 1] if low else 0) + (1 << 19), "right"))
            high = max(low + 1, high)
            while high < len(some) and kind[some[high]] == kind[some[high - 1]]:
                high += 1
            s = some[low:high]
            c = count[low:high]
            p = ranges(start[s], c)
            own = np.repeat(s, c)
            inside = p - start[own]
            h = word_hashes_of(data, p, np.full(len(p), window))
            later = _later(mix(h ^ mix((kind[own] * 65536 + shift[own] - inside).astype(np.uint64))), ids[own], first[own] + inside)
            out += runs(part[own][later], keys[own][later], (first[own] + inside)[later])
            low = high
        return tidied(_table(out, _BACK))

    return suffixes.groupBy("bucket").applyInArrow(judge, _BACK)


def _digest(data: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, keep_text: bool) -> tuple:
    """n_bytes, n_removed, n_spans, kept_sha256 (or the kept bytes) of one text, windows low to high - 1 repeated."""
    if not len(low):
        whole = data.tobytes()
        return len(data), 0, 0, whole.decode() if keep_text else hashlib.sha256(whole).hexdigest()
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, low.astype(np.int64), 1)
    np.add.at(edge, high.astype(np.int64) - 1 + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = data[~gone].tobytes()
    return len(data), int(gone.sum()), spans, kept.decode("utf-8", "ignore") if keep_text else hashlib.sha256(kept).hexdigest()


def deduplicated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row a row of ``docs``: id_col, n_bytes, n_removed, n_spans and kept_sha256, or kept_text with ``keep_text`` (without the bytes of characters that were cut in two)."""
    if not 2 * GRAM <= window < 1 << 15:
        raise ValueError(f"windows of {2 * GRAM} to {(1 << 15) - 1} bytes")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()
    parts, grams, buckets = (min(1 << 30, 1 + size // x) for x in (PART_BYTES, 4 * PART_BYTES, PART_BYTES))
    rows = _rows(docs, id_col, text_col, parts)
    repeated = shared_table(_repeated_grams(rows, window, grams), "grams")
    splitters = _splitters(rows, window, buckets, n)
    hashed = len(splitters) + 1
    windows = shared_table(_repeated_windows(_suffixes(rows, repeated, splitters, window, parts, hashed), window, hashed), "windows")
    drop_table(repeated)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(x.as_buffer(), np.int64)))], ["key"])

    shipped = key_table(windows.select("keys").mapInArrow(each, "key long"), "key")
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept string"

    def inside(batch: pa.RecordBatch) -> np.ndarray:
        return in_table(shipped.value, batch.column(2).to_numpy().astype(np.int64) & (ID_BITS - 1))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(inside(batch)))
        tidied()

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint32)
        for batch in batches:
            own = batch.filter(pa.array(~inside(batch)))
            data, offsets = text_buffer(own.column(3))
            for i, j in steps(offsets):
                got = [_digest(data[a:b], none, none, window, keep_text) for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                columns = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([own.column(1).slice(i, j - i), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["id", *names])
        tidied()

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, keys = left["id"].to_numpy(), left["key"].to_numpy()
        data, offsets = text_buffer(left["text"])
        own, low, high = _unpacked(right, {"keys": np.int64, "low": np.uint32, "high": np.uint32})
        order = np.argsort(own, kind="stable")
        own, low, high = own[order], low[order], high[order]
        first, last = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
        got = [(int(ids[d]), *_digest(data[offsets[d] : offsets[d + 1]], low[first[d] : last[d]], high[first[d] : last[d]], window, keep_text)) for d in range(len(ids))]
        return tidied(_table(got, schema))

    some = rows.mapInArrow(chosen, "part int, id long, key long, text string").groupBy("part").cogroup(windows.groupBy("part")).applyInArrow(removed, schema)
    out = some.unionByName(rows.mapInArrow(untouched, schema))
    last = "kept_text" if keep_text else "kept_sha256"
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").alias(last))
