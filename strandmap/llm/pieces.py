"""Operator 9, SentencePiece encoding that keeps byte offsets, and decoding.

A text is normalised by longest prefixes through the model's compiled character
map (a double-array trie and its strings), and every byte of the normalised
text remembers the byte of the original at which its prefix began. White space
becomes U+2581 with one in front of the text. Pieces are merged best score
first, leftmost among equals, in units that begin at white space (no piece of
the model goes on past the letters before white space, so units do not
interact). Every piece's span of normalised bytes, looked up in the alignment,
is its span of original bytes; the bytes of a character that is no piece share
the span of their character.

Only BPE models with byte fallback are taken. A null text is an empty text:
no pieces, an empty decoding. Repeated rows are encoded each for itself.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.bpe import POOL, SLOT_BITS, word_hashes
from strandmap.llm.shared import ranges, steps, text_buffer

SPACE = "▁".encode()
NONE = np.int32(2**31 - 1)
#: Units of more characters are merged one by one with a heap.
LONG = 64


class CharacterMap:
    """A compiled character map: u32 size of the trie in bytes, the trie's u32 units, zero-ended strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """Bytes of the longest key at ``at`` and where its string lies; 0 if there is none."""
        found, node = (0, 0), 0
        if not self.units:
            return found
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        return found

    def prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the longest prefix at ``at``, and its length; a character stands for itself."""
        n, place = self.longest(text, at)
        if n:
            return self.strings[place : self.strings.index(b"\0", place)], n
        b = text[at]
        n = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return text[at : at + n], n


class Model:
    """Encodes and decodes as the library does for one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and white space in front of words")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        kinds = [p.type for p in proto.pieces]
        if {4, 5} & {*kinds}:
            raise ValueError("models with user-defined or unused pieces are not taken")
        texts = [p.piece.encode() for p in proto.pieces]
        self.byte_ids = np.zeros(256, np.int64)
        shown = []
        for i, (kind, text) in enumerate(zip(kinds, texts, strict=True)):
            if kind == 6:
                self.byte_ids[int(text[3:5], 16)] = i
                shown.append(bytes([int(text[3:5], 16)]))
            else:
                shown.append({1: text.replace(SPACE, b" "), 2: trainer.unk_surface.encode()}.get(kind, b""))
        self.is_byte = np.array([k == 6 for k in kinds])
        self.size = np.array([1 if k == 6 else len(t) for k, t in zip(kinds, texts, strict=True)], np.int64)
        self.shown, self.shown_at, self.shown_size = _flat(shown)
        self.digits, self.digits_at, self.digits_size = _flat([b"%d," % i for i in range(len(texts))])
        # symbols: pieces, then characters of pieces that are no pieces themselves
        self.symbol = {t.decode(): i for i, (k, t) in enumerate(zip(kinds, texts, strict=True)) if k == 1}
        self.pieces = len(texts)
        if any("▁" in t.lstrip("▁") for t in self.symbol):
            raise ValueError("a piece goes on past white space")
        for t in [t for t in self.symbol if len(t) > 1]:
            for c in t:
                self.symbol.setdefault(c, len(self.symbol) + self.pieces)
        score = np.array([p.score for p in proto.pieces])
        _, rank = np.unique(-score, return_inverse=True)
        self.rank = rank.astype(np.int32)
        pairs = {}
        for t, i in self.symbol.items():
            for k in range(1, len(t)):
                a, b = self.symbol.get(t[:k]), self.symbol.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key, self.pair_made = np.append(keys, 2**62), np.append([pairs[k] for k in keys.tolist()], 0).astype(np.int32)
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.number, self.place = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int64)
        self.pool, self.filled = np.zeros(1 << 18, np.int32), 0

    # normalising

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the original byte."""
        out, aligned, at = bytearray(), [], 0

        def put(piece: bytes, origin: int) -> None:
            piece = piece.replace(b" ", SPACE)
            out.extend(piece)
            aligned.extend([origin] * len(piece))

        if self.squeeze:
            while at < len(text) and self.map.prefix(text, at)[0] == b" ":
                at += self.map.prefix(text, at)[1]
        if at == len(text):
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            put(b" ", at)
        blank = self.squeeze
        while at < len(text):
            piece, n = self.map.prefix(text, at)
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece, at)
                blank = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(SPACE):
                del out[-3:]
                at = aligned[-3]
                del aligned[-3:]
        return bytes(out), np.array([*aligned, at], np.int64)

    def _normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of all texts, their offsets, and the original byte (within its text) of each."""
        n = len(offsets) - 1
        if self.map.units or self.squeeze or not self.prefix:
            both = [self.normalise(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            out = np.frombuffer(b"".join(x for x, _ in both), np.uint8)
            return out, np.concatenate([[0], np.cumsum([len(x) for x, _ in both])]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(a[:-1] for _, a in both)])
        lengths = np.diff(offsets)
        first = offsets[:-1][lengths > 0]
        wide = np.where(data == 32, 3, 1)
        wide[first] += 3  # the white space in front
        ends = np.cumsum(wide)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = data
        blank = ends[data == 32] - 3
        for i, b in enumerate(SPACE):
            out[blank + i] = b
            out[ends[first] - wide[first] + i] = b
        begin = offsets[:-1].repeat(lengths)
        lead = (data & 0xC0) != 0x80
        origin = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0)) - begin
        return out, np.concatenate([[0], ends])[offsets], np.repeat(origin, wide)

    # merging

    def _symbols(self, text: str) -> list[int]:
        return [self.symbol.get(c, -1) for c in text]

    def _merge_one(self, symbols: list[int]) -> list[int]:
        """Symbol numbers after all merges, -1 for characters that are no pieces; for long units."""
        n = len(symbols)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], symbols[:]
        heap: list[tuple[int, int, int, int]] = []
        gone = [False] * n

        def offer(i: int, j: int) -> None:
            made = self.pairs.get(alive[i] << 20 | alive[j]) if i >= 0 and j >= 0 and alive[i] >= 0 and alive[j] >= 0 else None
            if made is not None:
                heapq.heappush(heap, (int(self.rank[made]), i, alive[i], alive[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or alive[i] != a or alive[j] != b:
                continue
            alive[i] = self.pairs[a << 20 | b]
            gone[j], after[i] = True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [k for k in range(n) if not gone[k]], alive  # type: ignore[return-value]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols made of pairs and their ranks; NONE where there is none."""
        key = (a.astype(np.int64) << 20) | b
        key[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.pair_key, key)
        made = self.pair_made[at]
        return made, np.where(self.pair_key[at] == key, self.rank[np.minimum(made, self.pieces - 1)], NONE)

    def _merge_many(self, symbols: np.ndarray) -> np.ndarray:
        """Merge the rows of a matrix (filled up with -2) until no pair of any row is a piece."""
        symbols = symbols.copy()
        width = symbols.shape[1]
        made, rank = self._pair(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(symbols))
        column = np.arange(width)
        while len(rows) and width > 1:
            best = rank[rows].argmin(1)
            more = rank[rows, best] < NONE
            rows, best = rows[more], best[more]
            if not len(rows):
                break
            joined = made[rows, best]
            keep = column[None, :] <= best[:, None]
            s = symbols[rows]
            shifted = np.concatenate([s[:, 1:], np.full((len(rows), 1), -2, s.dtype)], 1)
            s = np.where(keep, s, shifted)
            at = np.arange(len(rows))
            s[at, best] = joined
            symbols[rows] = s
            for name, fill in ((made, 0), (rank, NONE)):
                x = name[rows]
                moved = np.concatenate([x[:, 1:], np.full((len(rows), 1), fill, x.dtype)], 1)
                name[rows] = np.where(keep[:, :-1], x, moved)
            for side in (0, -1):
                k = best + side
                ok = (k >= 0) & (k < width - 1)
                m, r = self._pair(s[at[ok], k[ok]], s[at[ok], k[ok] + 1])
                made[rows[ok], k[ok]], rank[rows[ok], k[ok]] = m, r
        return symbols

    def _unit_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has."""
        texts = [u.decode() for u in units]
        found: list[list[int]] = [[]] * len(texts)
        size = np.array([len(t) for t in texts])
        plain = [self._symbols(t) for t in texts]
        low = 0
        for high in (4, 8, 16, 32, LONG):
            some = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(some):
                matrix = np.full((len(some), high), -2, np.int32)
                lengths = size[some]
                matrix[np.repeat(np.arange(len(some)), lengths), ranges(np.zeros(len(some), np.int64), lengths)] = np.fromiter((s for i in some for s in plain[i]), np.int32, int(lengths.sum()))
                for i, row in zip(some.tolist(), self._merge_many(matrix).tolist(), strict=True):
                    found[i] = row
        for i in np.flatnonzero(size > LONG).tolist():
            left, alive = self._merge_one(plain[i])
            found[i] = [alive[k] for k in left]
        ids: list[int] = []
        number = np.zeros(len(texts), np.int64)
        for i, row in enumerate(found):
            before, at = len(ids), 0
            for s in row:
                if s == -2:
                    break
                if 0 <= s < self.pieces:
                    ids.append(s)
                    at += self._chars[s]
                else:
                    ids.extend(self.byte_ids[b] for b in texts[i][at].encode())
                    at += 1
            number[i] = len(ids) - before
        return np.array(ids, np.int32), number

    @property
    def _chars(self) -> list[int]:
        if not hasattr(self, "_char_counts"):
            self._char_counts = [0] * self.pieces
            for t, i in self.symbol.items():
                if i < self.pieces:
                    self._char_counts[i] = len(t)
        return self._char_counts

    # whole texts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their n + 1 offsets, and each piece's span of bytes in its text."""
        text, at, origin = self._normalised(data, offsets)
        n = len(text)
        blank = np.zeros(n + 3, bool)
        if n:
            blank[: n - 2] = (text[:-2] == SPACE[0]) & (text[1:-1] == SPACE[1]) & (text[2:] == SPACE[2])
        start = blank[:n].copy()
        start[3:] &= ~blank[: max(0, n - 3)]
        start[at[:-1][np.diff(at) > 0]] = True
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, n))
        number, place = self._known(text, begin, size)
        ids = self.pool[ranges(place, number)]
        bounds = np.concatenate([[0], np.cumsum(number)])[np.searchsorted(begin, at)]
        ends = np.cumsum(self.size[ids])
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        reach = np.append(origin, 0)
        low = reach[ends - self.size[ids]]
        high = np.where(ends == at[doc + 1], np.diff(offsets)[doc], reach[ends])
        return ids, bounds, low, high

    def _known(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each unit has and where in the pool they start; units seen before come from a table."""
        if self.filled > POOL:
            self.forget()
        hashes = word_hashes(text, begin, size)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        number, place = self.number[slot].astype(np.int64), self.place[slot]
        miss = np.flatnonzero(self.key[slot] != hashes)
        if len(miss):
            _, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            own = miss[first]
            raw = text.tobytes()
            ids, n = self._unit_ids([raw[b : b + s] for b, s in zip(begin[own].tolist(), size[own].tolist(), strict=True)])
            if self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.int32)])
            self.pool[self.filled : self.filled + len(ids)] = ids
            at = self.filled + np.cumsum(n) - n
            self.filled += len(ids)
            self.key[slot[own]], self.number[slot[own]], self.place[slot[own]] = hashes[own], n, at
            number[miss], place[miss] = n[inverse], at[inverse]
        return number, place

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of runs of ids, in UTF-8."""
        size = self.shown_size[ids]
        raw = self.shown[ranges(self.shown_at[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[bounds]
        whole = raw.tobytes()
        out = []
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            text = whole[a:b]
            if self.prefix and text[:1] == b" " and not self.is_byte[ids[bounds[k]]]:
                text = text[1:]
            out.append(text)
        try:
            whole.decode()
        except UnicodeDecodeError:
            out = [self._repaired(x) for x in out]
        return out

    @staticmethod
    def _repaired(text: bytes) -> bytes:
        """Each byte that is part of no character becomes U+FFFD."""
        try:
            text.decode()
            return text
        except UnicodeDecodeError:
            out, i = bytearray(), 0
            while i < len(text):
                for n in (1, 2, 3, 4):
                    try:
                        text[i : i + n].decode()
                    except UnicodeDecodeError:
                        continue
                    break
                else:
                    out += "�".encode()
                    i += 1
                    continue
                out += text[i : i + n]
                i += n
            return bytes(out)


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model a worker process and file."""
    return Model(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_pieces: bool = True) -> DataFrame:
    """One row a row of ``docs``: id_col, n_bytes, n_tokens, ids_sha256, decoded_sha256, spanned (bytes of the text that the pieces' spans cover), and with ``with_pieces`` ids, starts and ends as arrays."""
    names = ["n_bytes", "n_tokens", "ids_sha256", "decoded_sha256", "spanned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in steps(offsets):
                own = offsets[i : j + 1] - offsets[i]
                ids, bounds, low, high = m.encode(data[offsets[i] : offsets[j]], own)
                size = m.digits_size[ids]
                digits = memoryview(m.digits[ranges(m.digits_at[ids], size)])
                at = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
                listed = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                shown = [hashlib.sha256(x).hexdigest() for x in m.decode(ids, bounds)]
                covered = np.concatenate([[0], np.cumsum(high - low)])
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(own)), pa.array(np.diff(bounds)), pa.array(listed), pa.array(shown), pa.array(covered[bounds[1:]] - covered[bounds[:-1]])]
                if with_pieces:
                    columns += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, low, high)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *names, *["ids", "starts", "ends"] * with_pieces])

    schema = f"`{id_col}` long, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned long" + ", ids array<int>, starts array<int>, ends array<int>" * with_pieces
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, schema)
