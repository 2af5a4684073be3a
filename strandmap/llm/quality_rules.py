"""Operator 12, quality rules whose cutoffs carry a bound on false rejections.

Signals of whole texts are counted once (a pass of Arrow batches); every rule is
a share in thousandths, higher is worse. Labelled documents are split by a hash
of their id. A quarter, the fit part, gives each rule its cutoffs: for every
level of ``LEVELS`` the most rejecting value that at most so large a share of
good documents exceeds, if bad documents exceed it at least ``GAIN`` times as
often; and the last level worth using: the first of those at which the share of
bad documents caught is most above that of good ones lost. The other labelled documents, the holdout, decide per stratum how many
levels may be used: levels are tested from the most careful on, and the first
whose false rejections among good documents cannot be bounded by ``risk`` ends
the sequence. The bound is the exact binomial one: level passes if
P(Binomial(n, risk) <= k) <= error / strata. A fixed sequence spends its error
once, and the division by the number of strata (Bonferroni) makes all strata's
bounds hold together with probability 1 - error. A level is judged as the union
of all rules, so no rule needs a share of the risk. Strata without a passing
level reject nothing beyond the base rules.

Null texts have no words; null strata are a stratum of their own. Labels that are
null or name no document are left out; of several labels of one id the worst
counts. Documents that share an id are judged one by one. Copies among the
labelled documents count as they are; the bound is for documents drawn like the
holdout. Texts of any length are read whole, one numpy step at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmap.llm.shared import ranges, segment_sums, shared_table, steps, text_buffer

#: Shares of good fit documents that the levels' cutoffs may exceed, most careful first.
LEVELS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06)
#: A cutoff is of use if bad documents exceed it so many times as often as good ones.
GAIN = 3.0
#: Shares are compared up to this many thousandths; beyond, all are as bad.
MOST = 4000
#: Rules: name, what is counted, and of what it is a share.
RULES = (("symbols", "n_symbols", "n_words"), ("marks", "n_marks", "n_words"), ("capitals", "n_capitals", "word_chars"), ("copied_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"), ("length", "word_chars", "n_words"))
#: Strata whose cutoffs are sent to all tasks; with more, the join shuffles.
BROADCAST_STRATA = 1 << 16

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")


def _marked(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


_SPACE, _SYMBOL, _MARK, _CAPITAL = _marked("\t\n\x0b\x0c\r "), _marked("#*$%&|<>"), _marked("!"), _marked("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end."""
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _numbers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each slice of ``data``, equal for equal bytes and only for those."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    body = np.ascontiguousarray(data[ranges(starts, sizes)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs and only for those."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64) if len(a) else a


def _signals(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """``_COUNTS`` of each text. No word or line crosses texts, whatever their last bytes are."""
    n = len(offsets) - 1
    wordy = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True  # a text starts here, or the data end
    fresh = wordy & ~(np.concatenate([[False], wordy[:-1]]) & ~begins[:-1]) if len(data) else wordy
    start = np.flatnonzero(fresh)
    stop = np.zeros(0, np.int64)
    if len(data):
        last = wordy & ~(np.concatenate([wordy[1:], [False]]) & ~np.concatenate([begins[1:-1], [True]]))
        stop = np.flatnonzero(last) + 1
    of = np.searchsorted(offsets, start, "right") - 1  # the text of each word
    words = np.bincount(of, minlength=n)
    # words in windows of three that occur twice or more in their text
    number = _numbers(data, start, stop - start)
    repeated = np.zeros(len(start), bool)
    if len(start) > 2:
        at = np.flatnonzero(of[:-2] == of[2:])
        window = _paired(_paired(_paired(number[at], number[at + 1]), number[at + 2]), of[at])
        many = at[np.bincount(window)[window] > 1]
        for k in range(3):
            repeated[many + k] = True
    # lines: the bytes between line feeds of one text
    feed = data == 10
    first = np.flatnonzero(begins[:-1] | np.concatenate([[False], feed[:-1]])) if len(data) else np.zeros(0, np.int64)
    end = np.concatenate([first[1:], [len(data)]])[: len(first)]
    end = end - (feed[end - 1] if len(first) else 0)
    holds = segment_sums(wordy, np.stack([first, end], 1).ravel())[::2] > 0 if len(first) else np.zeros(0, bool)
    first, end = first[holds], end[holds]
    line_of = np.searchsorted(offsets, first, "right") - 1
    line = _paired(_numbers(data, first, end - first), line_of)
    again = np.ones(len(line), bool)
    again[np.unique(line, return_index=True)[1]] = False
    count = lambda flags: segment_sums(flags, offsets)
    return [words, count(wordy & ((data & 0xC0) != 0x80)), count(_SYMBOL[data]), np.bincount(line_of[again], minlength=n), np.bincount(of[repeated], minlength=n), np.bincount(line_of, minlength=n), count(_MARK[data]), count(_CAPITAL[data])]


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The id, ``stratum``, counts of words, symbols, lines and repeats, and base_failed of every text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            parts = [_signals(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)]
            found = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x.astype(np.int64)) for x in found)], ["id", "stratum", *_COUNTS])

    out = rows.mapInArrow(count, f"id {kind}, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _share(rule: tuple[str, str, str]) -> Column:
    _, part, whole = rule
    return F.least(F.expr(f"{part} * 1000 div greatest({whole}, 1)"), F.lit(MOST))


def _cutoffs(fit: DataFrame) -> list[list[int | None]]:
    """For each rule and level the value beyond which it rejects; None if it does not. fit: shares by rule name, good.

    What reaches the driver is one count for each rule, value up to ``MOST`` and label.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(r[0]).alias("value")) for i, r in enumerate(RULES)))).alias("s")
    rows = fit.select("good", sides).groupBy("good", "s.rule", "s.value").count().collect()
    seen = np.zeros((2, len(RULES), MOST + 1), np.int64)
    for r in rows:
        seen[int(r.good), r.rule, r.value] += r["count"]
    total = seen.sum(2, keepdims=True)
    beyond = total - seen.cumsum(2)  # rows with a larger value
    out: list[list[int | None]] = []
    for i in range(len(RULES)):
        good = (beyond[1, i] + 1) / (total[1, i] + 1)
        bad = beyond[0, i] / max(1, int(total[0, i, 0]))
        found = [np.flatnonzero((beyond[1, i] <= level * total[1, i]) & (bad >= GAIN * good)) for level in LEVELS]
        out.append([int(x[0]) if len(x) else None for x in found])
    return out


def _level(cutoffs: Sequence[Sequence[int | None]]) -> Column:
    """The first level (from 0) at which some rule rejects the row; the number of levels if none does."""
    return F.least(*(reduce(lambda rest, k: F.when(F.col(RULES[i][0]) > cuts[k], k).otherwise(rest) if cuts[k] is not None else rest, reversed(range(len(LEVELS))), F.lit(len(LEVELS))) for i, cuts in enumerate(cutoffs)))


def _useful(fit: DataFrame, cutoffs: Sequence[Sequence[int | None]]) -> int:
    """How many levels are worth using: up to the first at which the share of bad documents caught is most above that of good ones lost."""
    lost = np.zeros((2, len(LEVELS) + 1), np.int64)
    for r in fit.groupBy("good", _level(cutoffs).alias("level")).count().collect():  # two rows a level
        lost[int(r.good), r.level] += r["count"]
    share = lost.cumsum(1)[:, :-1] / np.maximum(1, lost.sum(1, keepdims=True))
    gain = share[0] - share[1]
    return int(gain.argmax()) + 1 if gain.max() > 0 else 0


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), its terms added up from the kth down until they no longer count."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(min(0.0, log + math.log(total))))


def certified(rejected: Sequence[int], n: int, risk: float, error: float) -> int:
    """How many levels of a fixed sequence pass in a row: with ``rejected`` of n good documents each, the risk is bounded."""
    for passed, k in enumerate(rejected):
        if n == 0 or binomial_tail(int(k), n, risk) > error:
            return passed
    return len(rejected)


def fit(found: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, label_col: str = "quality", id_col: str = "doc_id") -> tuple[list[list[int | None]], DataFrame]:
    """Cutoffs of rules by level, and per stratum (stratum, n, rejected, usable): good holdout documents, those that levels reject, levels that pass.

    found: rows of ``signals``. The split follows the first hexadecimal digit of the id's sha256.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).alias("good"))
    rows = found.where("not base_failed").join(known, "id").select("stratum", "good", *(_share(r).alias(r[0]) for r in RULES), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 1).isin(*"0123").alias("fit"))
    rows = shared_table(rows, "labelled")
    cutoffs = _cutoffs(rows.where("fit"))
    levels = range(_useful(rows.where("fit"), cutoffs))
    held = rows.where("not fit and good").withColumn("level", _level(cutoffs)).groupBy("stratum").agg(F.count("*").alias("n"), F.array(*(F.count_if(F.col("level") <= k) for k in levels)).cast("array<long>").alias("rejected"))
    held = shared_table(held, "strata")  # a row a stratum
    share = error / max(1, held.count())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable = [certified(r, n, risk, share) for r, n in zip(batch.column("rejected").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("stratum", "n", "rejected")), pa.array(usable, pa.int32())], ["stratum", "n", "rejected", "usable"])

    return cutoffs, held.mapInArrow(choose, "stratum string, n long, rejected array<long>, usable int")


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Every document with its counts, base_failed, level (the first that rejects it), usable (levels of its stratum that hold) and kept."""
    found = shared_table(signals(docs, id_col, text_col, stratum_col), "signals")
    cutoffs, strata = fit(found, labels.select(F.col(id_col), F.col(label_col)), risk, error, label_col, id_col)
    strata = shared_table(strata.where("usable > 0").select(F.col("stratum").alias("_stratum"), "usable"), "usable")
    if strata.count() <= BROADCAST_STRATA:
        strata = F.broadcast(strata)
    rows = found.withColumns({r[0]: _share(r) for r in RULES}).withColumn("level", _level(cutoffs)).drop(*(r[0] for r in RULES))
    rows = rows.join(strata, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").withColumn("usable", F.coalesce("usable", F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("level") >= F.col("usable"))
    return rows.select(F.col("id").alias(id_col), "stratum", *_COUNTS, "base_failed", "level", "usable", kept.alias("kept"))
