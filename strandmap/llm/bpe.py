"""Byte-level BPE as compiled finite-state transducers over numpy arrays.

Two machines take a text apart:

* ``Pretokenizer`` has ten states and reads one symbol a character: its class
  (letter, number, white space, other, apostrophe of a contraction) joined with
  what the one or three characters after it are. A transition says whether a
  pre-token starts. A text is cut into chunks of equal length; each chunk yields
  a map from every possible entry state to its exit state, the maps compose by a
  parallel prefix scan, and with the entry states known all chunks emit their
  boundaries in lockstep.
* ``Transducer`` reads the bytes of a pre-token. Its state is the longest suffix
  read that may still grow into a token, with the last token and the relative
  token count of the best encoding at each of its positions; a transition
  carries the change in the number of tokens. States and transitions are
  compiled when first met and the tables start anew beyond ``max_states``.

The encoding of a prefix ends in the one token that is compatible with the
token before it; two tokens are compatible if no merge across their border
comes before the merges that consume either side.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from strandmap.llm.shared import STEP_BYTES, mix, ranges, segment_sums, steps

CHUNK = 256
#: Up to so many tokens are compared one by one to tell states apart.
FEW = 16
#: Remembered comparisons.
MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        to_byte = byte_alphabet()
        self.ids = {bytes(to_byte[c] for c in t): i for t, i in file["model"]["vocab"].items()}
        self.size = 1 + max(self.ids.values())
        self.specials = {t["content"].encode(): t["id"] for t in file["added_tokens"] if t["special"]}
        self.token_of = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            left, right = (self.ids[bytes(to_byte[c] for c in x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = self.ids[self.token_of[left] + self.token_of[right]]
            self.rank.setdefault((left, right), rank)
            parts.setdefault(made, (left, right, self.rank[left, right]))
        self.parts = parts
        self.lengths = np.zeros(max([self.size, *(i + 1 for i in self.specials.values())]), np.int64)
        for t, i in self.ids.items():
            self.lengths[i] = len(t)
        self.growing: dict[bytes, list[int] | None] = {}  # what begins tokens: those tokens, or None if they are many
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                longer = self.growing.setdefault(t[:k], [])
                if longer is not None:
                    longer.append(i)
                    if len(longer) > FEW:
                        self.growing[t[:k]] = None
        self.lefts = {left for left, _ in self.rank}
        self.forget()

    def forget(self) -> None:
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def right_edge(self, token: int) -> list[tuple[int, float]]:
        return self._edge(token, 1, self._right)

    def _edge(self, token: int, side: int, kept: dict[int, list]) -> list[tuple[int, float]]:
        """The symbols at one edge of a token while it is being merged, each with the rank of the merge that ends it."""
        if token not in kept:
            out, end, t = [], float("inf"), token
            while True:
                out.append((t, end))
                if t not in self.parts:
                    break
                end, t = self.parts[t][2], self.parts[t][side]
            kept[token] = out
        return kept[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of token a's text followed by token b's is a, b."""
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            known = True
            for x, x_end in self.right_edge(a):
                for y, y_end in self._edge(b, 0, self._left):
                    q = self.rank.get((x, y))
                    if q is not None and q < x_end and q <= y_end:
                        known = False
                        break
                if not known:
                    break
            self._fits[key] = known
        return known


class Transducer:
    """Token counts and token ids of pre-tokens, a byte a step for all pre-tokens at once.

    Few of the possible transitions occur, so they lie in an open-addressing hash table of arrays.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = 120_000):
        self.v, self.max_states = vocabulary, max_states
        self.alike: dict[tuple, int] = {}
        self.stand_in: dict[int, int] = {}
        self.reset()

    def reset(self) -> None:
        self.v.forget()
        self.likes: dict[tuple[int, bytes], int] = {}
        self.used = 0
        self._table(1 << 16)
        self.states = [(b"", (-1,), (0,))]
        self.index = {self.states[0]: 0}

    def _table(self, slots: int) -> None:
        self.key = np.full(slots, -1, np.int64)
        self.to, self.token, self.emit = np.zeros(slots, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int8)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or of the free slot where it would be."""
        mask = len(self.key) - 1
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
        at = self.key[slot]
        open_ = np.flatnonzero((at != keys) & (at >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            at = self.key[slot[open_]]
            open_ = open_[(at != keys[open_]) & (at >= 0)]
        return slot

    def _stand_in(self, token: int) -> int:
        """One token for all those that are compatible with the same tokens after them."""
        if token not in self.stand_in:
            edge = tuple((x, end) for x, end in self.v.right_edge(token) if x in self.v.lefts)
            self.stand_in[token] = self.alike.setdefault(edge, token)
        return self.stand_in[token]

    def _like(self, last: int, begun: bytes) -> int:
        """A stand-in for ``last`` before the tokens that begin with ``begun``; -2 if none of them may follow it."""
        longer = self.v.growing[begun]
        if longer is None:
            return last
        key = (last, begun)
        known = self.likes.get(key)
        if known is None:
            bits = tuple(last < 0 or self.v.fits(last, t) for t in longer)
            known = self.likes[key] = self.alike.setdefault((begun, bits), last) if any(bits) else -2
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int, int]:
        """Next state, last token and change in the number of tokens."""
        suffix, lasts, counts = self.states[state]
        grown, ids, fits = suffix + bytes([byte]), self.v.ids, self.v.fits
        for i in range(len(grown)):
            token = ids.get(grown[i:])
            if token is not None and lasts[i] > -2 and (lasts[i] < 0 or fits(lasts[i], token)):
                break
        else:
            raise ValueError(f"byte {byte} is no token")
        delta, growing = counts[i] + 1, self.v.growing
        # of the positions only those from which a token may still grow matter
        alive = [(k, like) for k in range(len(grown)) if lasts[k] > -2 and grown[k:] in growing and (like := self._like(lasts[k], grown[k:])) > -2]
        cut = alive[0][0] if alive else len(grown)
        after, number = [-2] * (len(grown) - cut) + [self._stand_in(token)], [0] * (len(grown) - cut + 1)
        for k, like in alive:
            after[k - cut], number[k - cut] = like, counts[k] - delta
        key = (grown[cut:], tuple(after), tuple(number))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        return to, token, delta

    def _add(self, keys: np.ndarray) -> None:
        """Compile the transitions of these keys (state * 256 + byte), all new and different."""
        made = [self._compile(k >> 8, k & 255) for k in keys.tolist()]
        self.used += len(keys)
        if 2 * self.used > len(self.key):
            kept = np.flatnonzero(self.key >= 0)
            old = [x[kept] for x in (self.key, self.to, self.token, self.emit)]
            self._table(4 * len(self.key))
            self._put(*old)
        self._put(keys, *np.array(made, np.int64).T)

    def _put(self, keys: np.ndarray, to: np.ndarray, token: np.ndarray, emit: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):  # keys that meet in a free slot take turns
            slot = self._slots(keys[left])
            _, first = np.unique(slot, return_index=True)
            at, own = slot[first], left[first]
            self.key[at], self.to[at], self.token[at], self.emit[at] = keys[own], to[own], token[own], emit[own]
            left = np.delete(left, first)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each pre-token, and the last token at each byte if ``ids``."""
        if len(self.states) > self.max_states:
            self.reset()
        elif len(self.v._fits) > MEMO:
            self.v.forget()
        lasts = np.zeros(len(data), np.int32) if ids else None
        order = np.argsort(-lengths, kind="stable")
        starts, counts = starts[order], np.zeros(len(order), np.int32)
        live = len(order) - np.cumsum(np.bincount(lengths, minlength=1))  # longer than t
        state = np.zeros(len(order), np.int64)
        for t in range(int(lengths.max(initial=0))):
            n = int(live[t])
            at = starts[:n] + t
            keys = (state[:n] << 8) | data[at]
            slot = self._slots(keys)
            missing = self.key[slot] < 0
            if missing.any():
                self._add(np.unique(keys[missing]))
                slot = self._slots(keys)
            counts[:n] += self.emit[slot]
            state = self.to[slot].astype(np.int64)
            if ids:
                lasts[at] = self.token[slot]
        out = np.empty(len(order), np.int32)
        out[order] = counts
        return out, lasts


# Symbols of the pre-tokenizer: letter, number, other, a space before a visible character, other
# white space before one, white space before white space or the end, apostrophe of a contraction of
# one or two letters, and the filling of the last chunk.
LETTER, NUMBER, OTHER, SPACE, BLANK, BLANKS, SHORT, LONG, FILL = range(9)
# States: the start, inside letters, numbers, others, after a space that joins what follows, inside white
# space, after its last character, two letters and one letter before the end of a contraction, after it.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_BLANKS, S_BLANK, S_TWO, S_ONE, S_DONE = range(10)
STATES, SYMBOLS = 10, 9


def _pretokenizer_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token starts, by state and symbol."""
    to = np.zeros((STATES, SYMBOLS), np.uint8)
    starts = np.ones((STATES, SYMBOLS), bool)
    to[:, LETTER], to[:, NUMBER], to[:, OTHER] = S_LETTER, S_NUMBER, S_OTHER
    to[:, SPACE], to[:, BLANK], to[:, BLANKS] = S_SPACE, S_BLANK, S_BLANKS
    to[:, SHORT], to[:, LONG] = S_ONE, S_TWO
    for state, symbol in ((S_LETTER, LETTER), (S_NUMBER, NUMBER), (S_OTHER, OTHER)):
        starts[state, symbol] = starts[S_SPACE, symbol] = False
    for symbol in (SHORT, LONG):  # after a space or inside others an apostrophe is like any other sign
        for state in (S_OTHER, S_SPACE):
            to[state, symbol], starts[state, symbol] = S_OTHER, False
    starts[S_BLANKS, BLANKS] = False
    to[S_TWO, :], starts[S_TWO, :] = S_ONE, False
    to[S_ONE, :], starts[S_ONE, :] = S_DONE, False
    to[:, FILL], starts[:, FILL] = np.arange(STATES), False
    return to, starts


class Pretokenizer:
    """Where pre-tokens start. ``probe`` splits a short string as the library does and classes unknown characters."""

    def __init__(self, probe):
        self.probe = probe
        self.kind = np.full(0x110000, 255, np.uint8)
        self.to, self.starts = _pretokenizer_tables()

    def _class(self, c: int) -> int:
        for kind, sign in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.probe(sign + chr(c))) == 1:
                return kind
        return BLANKS

    def symbols(self, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """ends: one past each segment's last character."""
        kind = self.kind[chars]
        if (kind == 255).any():
            for c in np.unique(chars[kind == 255]).tolist():
                self.kind[c] = self._class(c)
            kind = self.kind[chars]
        n = len(chars)
        after = np.full(n, BLANKS, np.uint8)
        after[:-1] = kind[1:]
        after[ends - 1] = BLANKS
        out = kind.copy()
        single = (kind == BLANKS) & (after != BLANKS)
        out[single] = np.where(chars[single] == 32, SPACE, BLANK)
        last = np.zeros(n + 3, np.int64)
        last[ends - 1] = 1
        for i in np.flatnonzero(chars == 39):
            if not last[i]:
                one = chars[i + 1]
                if one in (115, 116, 109, 100):  # s t m d
                    out[i] = SHORT
                elif not last[i + 1] and (one, chars[i + 2]) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
                    out[i] = LONG
        return out

    def at_once(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """What ``boundaries`` returns, from each symbol and the one before it: the transducer forgets all else."""
        before = np.empty_like(symbols)
        before[1:] = symbols[:-1]
        before[offsets[:-1]] = FILL
        apostrophe = (symbols == SHORT) | (symbols == LONG)
        joined = apostrophe & ((before == OTHER) | (before == SPACE))
        plain = np.where(joined, OTHER, symbols)
        start = (plain != before) | (plain == SPACE) | (plain == BLANK) | (plain == SHORT) | (plain == LONG)
        start &= (before != SPACE) | (plain >= SPACE)
        start[1:] |= joined[:-1]  # what follows such an apostrophe is a letter
        for kind, size in ((SHORT, 1), (LONG, 2)):
            at = np.flatnonzero(plain == kind)
            for k in range(1, size + 1):
                start[at + k] = False
            after = at + size + 1
            start[after[after < len(start)]] = True
        start[offsets[:-1]] = True
        return np.flatnonzero(start)

    def boundaries(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Indexes of the characters at which pre-tokens start; segments are non-empty."""
        lengths = np.diff(offsets)
        chunks = -(-lengths // CHUNK)
        first = np.concatenate([[0], np.cumsum(chunks)])
        n = int(first[-1])
        segment = np.repeat(np.arange(len(lengths)), chunks)
        inside = np.arange(n) - first[segment]
        begin = offsets[segment] + inside * CHUNK
        size = np.minimum(CHUNK, offsets[segment + 1] - begin)
        at = begin[None, :] + np.arange(CHUNK)[:, None]
        grid = np.where(np.arange(CHUNK)[:, None] < size[None, :], symbols[np.minimum(at, len(symbols) - 1)], FILL).astype(np.intp)
        flat = self.to.ravel()
        maps = np.repeat(np.arange(STATES, dtype=np.uint8)[None, :], n, axis=0)
        for t in range(CHUNK):
            maps = flat[maps * np.intp(SYMBOLS) + grid[t][:, None]]
        step = 1
        while step < int(chunks.max(initial=0)):  # inclusive scan by composition
            joined = np.flatnonzero(inside >= step)
            maps_new = maps.copy()
            maps_new[joined] = np.take_along_axis(maps[joined], maps[joined - step].astype(np.intp), 1)
            maps = maps_new
            step *= 2
        state = np.full(n, S_START, np.intp)
        later = np.flatnonzero(inside > 0)
        state[later] = maps[later - 1, S_START]
        starts, found = self.starts.ravel(), np.zeros((CHUNK, n), bool)
        for t in range(CHUNK):
            key = state * SYMBOLS + grid[t]
            found[t] = starts[key]
            state = flat[key].astype(np.intp)
        t, c = np.nonzero(found)
        return np.sort(begin[c] + t)


class Encoder:
    """Counts and ids of whole texts, equal to those of the tokenizers library for the same file."""

    def __init__(self, path: str, ids: bool):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.vocabulary = Vocabulary(path)
        self.pretokenizer = Pretokenizer(library.pre_tokenizer.pre_tokenize_str)
        self.transducer = Transducer(self.vocabulary)
        self.ids = ids
        self._forget()

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and special ids (or -1) of the parts of all texts, special tokens apart, none empty."""
        cuts = []
        raw = None
        for text, token in self.vocabulary.specials.items():
            if raw is None:
                raw = data.tobytes()
            i = raw.find(text)
            while i >= 0:
                if offsets[np.searchsorted(offsets, i, "right")] >= i + len(text):
                    cuts.append((i, i + len(text), token))
                    i = raw.find(text, i + len(text))
                else:
                    i = raw.find(text, i + 1)
        starts = np.concatenate([offsets[:-1], *[[a, b] for a, b, _ in cuts]]).astype(np.int64)
        starts = np.unique(starts[starts < len(data)])
        ends = np.append(starts[1:], len(data))
        special = np.full(len(starts), -1, np.int64)
        for a, _, token in cuts:
            special[np.searchsorted(starts, a)] = token
        return starts, ends, special

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and special ids (or -1) of all pre-tokens, in bytes."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends, special = self._segments(data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        b = data[lead].astype(np.int64)
        chars = b.copy()
        for low, size, keep in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
            at = np.flatnonzero(b >= low) if low == 0xF0 else np.flatnonzero((b >= low) & (b < {0xC0: 0xE0, 0xE0: 0xF0}[low]))
            c = b[at] & keep
            for k in range(1, size):
                c = (c << 6) | (data[lead[at] + k] & 0x3F)
            chars[at] = c
        plain = special < 0
        s, e = np.searchsorted(lead, starts[plain]), np.searchsorted(lead, ends[plain])
        words = starts[~plain]
        if len(s):
            taken = ranges(s, e - s)
            inner = np.concatenate([[0], np.cumsum(e - s)])
            part = chars if len(taken) == len(chars) else chars[taken]
            symbols = self.pretokenizer.symbols(part, inner[1:])
            found = self.pretokenizer.at_once(symbols, inner) if self.ids else self.pretokenizer.boundaries(symbols, inner)
            words = np.sort(np.concatenate([words, lead[taken[found]]]))
        size = np.append(words[1:], len(data)) - words
        token = np.full(len(words), -1, np.int64)
        token[np.searchsorted(words, starts[~plain])] = special[~plain]
        return words, size, token

    def _known(self, data: np.ndarray, words: np.ndarray, size: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each pre-token and, if ids are kept, where in the pool they start.

        A direct-mapped table remembers what the transducer gave for a pre-token (by 64-bit hash and
        length), so that the transducer reads each pre-token of a step at most once.
        """
        if self.filled > POOL:
            self._forget()
        hashes = word_hashes(data, words, size)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        number, place = self.number[slot].astype(np.int64), self.place[slot]
        miss = np.flatnonzero((self.key[slot] != hashes) & (token < 0))
        if len(miss):
            _, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            own = miss[first]
            n, lasts = self.transducer.run(data, words[own], size[own], self.ids)
            ends = np.cumsum(n.astype(np.int64))
            at = self.filled + ends - n
            if self.ids:
                self._room(int(ends[-1]))
                self._walk(lasts, words[own] + size[own] - 1, self.filled + ends - 1, n)
                self.filled += int(ends[-1])
            else:
                self.filled += len(own)
            self.key[slot[own]], self.number[slot[own]], self.place[slot[own]] = hashes[own], n, at
            number[miss], place[miss] = n[inverse], at[inverse]
        for i in np.flatnonzero(token >= 0):
            number[i] = 1
            if self.ids:
                self._room(1)
                self.pool[self.filled] = token[i]
                place[i] = self.filled
                self.filled += 1
        return number, place

    def _room(self, n: int) -> None:
        if self.filled + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(n, len(self.pool)), np.uint32)])

    def _walk(self, lasts: np.ndarray, at: np.ndarray, place: np.ndarray, left: np.ndarray) -> None:
        """Write the ids of pre-tokens into the pool, from each one's end back to its start."""
        lengths = self.vocabulary.lengths
        while len(at):
            ids = lasts[at]
            self.pool[place] = ids
            more = left > 1
            at, place, left = at[more] - lengths[ids[more]], place[more] - 1, left[more] - 1

    def _forget(self) -> None:
        self.key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.number, self.place = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int64)
        self.pool, self.filled = np.zeros(1 << 18, np.uint32), 0

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        words, size, token = self._words(data, offsets)
        number, _ = self._known(data, words, size, token)
        return segment_sums(number, np.searchsorted(words, offsets))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and n + 1 offsets into them."""
        words, size, token = self._words(data, offsets)
        number, place = self._known(data, words, size, token)
        bounds = np.concatenate([[0], np.cumsum(number)])[np.searchsorted(words, offsets)]
        return self.pool[ranges(place, number)], bounds


#: Slots of the table of pre-tokens, and ids (or counts) after which it starts anew.
SLOT_BITS, POOL = 18, 1 << 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
    out = []
    for base in (_FACTOR, inverse):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


#: The prime 2^61 - 1, by which words are hashed, a base, and the longest slice whose sums stay below 2^64.
PRIME, _BASE, _LONGEST = (1 << 61) - 1, 0x1B873593CC9E2D51, 1 << 24
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it, from halves of 31 bits."""
    s = np.uint64(31)
    a1, a0, b1, b0 = a >> s, a & _LOW31, b >> s, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(_reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << s)) + _reduced(a0 * b0))


@lru_cache(maxsize=2)
def _prime_powers(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base modulo the prime in halves of 31 bits, and of its inverse."""
    found = []
    for base in (_BASE, pow(_BASE, -1, PRIME)):
        x = np.ones(1, np.uint64)
        for k in range(bits):
            x = np.concatenate([x, _times(x, np.full(len(x), pow(base, 1 << k, PRIME), np.uint64))])
        found.append(x)
    return found[0] & _LOW31, found[0] >> np.uint64(31), found[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of ``data``: their bytes as a polynomial modulo 2^61 - 1, from prefix sums of bytes times powers.

    Two different slices of n bytes have one hash for at most n of the 2^61 bases. (Modulo a power of two
    there are short slices that collide whatever the base.)
    """
    if len(lengths) and int(lengths.max()) > _LONGEST:
        return _long_hashes(data, starts, lengths)
    low, high, down = _prime_powers(max(20, len(data).bit_length()))
    wide = data.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    sums = []
    for half in (low, high):
        np.cumsum(wide * half[: len(data)], out=total[1:])
        sums.append(total[starts + lengths] - total[starts])  # exact: below 2^63, though the prefix sums may wrap
    value = _reduced(_reduced(sums[0]) + (sums[1] >> np.uint64(30)) + ((sums[1] & _LOW30) << np.uint64(31)))
    return mix(_times(value, down[starts]) + (lengths.astype(np.uint64) << np.uint64(61)))


def _long_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``word_hashes`` where some slices are long: such a slice's hash is that of its pieces' hashes, the others' are as ever."""
    out = np.empty(len(starts), np.uint64)
    short = lengths <= _LONGEST
    for i in np.flatnonzero(~short).tolist():
        cut = np.arange(0, int(lengths[i]), _LONGEST)
        piece = data[starts[i] : starts[i] + lengths[i]]
        each = np.concatenate([word_hashes(piece[c : c + _LONGEST], np.zeros(1, np.int64), np.array([min(_LONGEST, len(piece) - c)])) for c in cut.tolist()])
        out[i] = word_hashes(each.view(np.uint8), np.zeros(1, np.int64), np.array([8 * len(each)]))[0] ^ np.uint64(len(piece))
    out[short] = word_hashes(data, starts[short], lengths[short])
    return out


@lru_cache(maxsize=2)
def encoder(path: str, ids: bool = False) -> Encoder:
    """One encoder a worker process, file and purpose."""
    return Encoder(path, ids)


def forget_encoders() -> None:
    """Give up what a reused worker keeps from a stage of encoding before work that needs the room."""
    encoder.cache_clear()


def counted(path: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Token counts of any number of texts, in steps of bounded memory."""
    e = encoder(path)
    return np.concatenate([np.zeros(0, np.int64), *(e.counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets, STEP_BYTES))])
