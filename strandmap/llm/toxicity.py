"""Operator 6, a convolutional text classifier in numpy.

Every word of a text has two hashed embeddings, of the whole word and of its
first four bytes, which are added. Filters of widths 1, 2 and 3 run over the
words, each filter's largest value over the text is kept (max pooling), and a
logistic layer makes the score of those. All labelled documents of the learning
folds are learnt from, whatever their number and length. Their word hashes are
dealt to shards by a hash of their ids and stay with the executors. In a round
every shard goes once over its documents from the parameters of the round before;
Spark sums the changes of each row of parameters over the shards that moved it,
as integers, so the order of sums plays no part, and the driver adds their means.
A single shard makes all its rounds in one. One document in ``CALIBRATION`` is
left out of training. On all of these, scores counted on a grid of ``GRID`` steps,
the threshold with the fewest errors is found over all languages and for each
language; a language uses a mean of the two, weighted by how many examples of its
rarer label there are. The column ``flagged`` uses it. Only the words of a text
make its score, whatever texts it is scored with. Of rows that share an id one is
learnt from, the one with the smallest text; all are scored. Equal scores are
flagged alike.

Labels null, or neither 0 nor 1, are left out; several labels of one document
count as the largest. A null or empty text has no words and scores as the bias
gives. Without labels of both kinds every score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmap.llm.bpe import forget_encoders, word_hashes
from strandmap.llm.shared import drop_table, id_bit, id_table, in_table, shared_table, steps, text_buffer, tidied

#: Labelled documents, and bytes of their texts, that a shard has on average at most.
SHARD, SHARD_BYTES = 4096, 1 << 26
#: One in so many is left out of training; so many of each label make a language's own threshold count half.
CALIBRATION, TRUSTED = 5, 30
BITS, SIZE, FILTERS, WIDTHS, PREFIX = 15, 12, 8, (1, 2, 3), 4
PAD = 1 << BITS
GAP = len(WIDTHS) - 1
#: Values of the filters at all places of a word; filters of all widths; rows of all parameters, SIZE numbers each.
PLACES, POOLED = sum(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS
ROWS = 2 * (PAD + 1) + PLACES + -(-(2 * POOLED + 1) // SIZE)
#: Words that filters run over at once; steps of the grid of scores; what changes are multiplied by to be summed as integers.
WORDS, GRID, SCALE = 1 << 16, 1 << 16, 2.0**40


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of their beginnings, and n + 1 offsets; each text ends in GAP empty places."""
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    if len(low):
        latin = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97))
        low[latin + 1] += 32
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    before = np.zeros(len(low), bool)
    before[1:] = letter[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    start = np.flatnonzero(letter & ~before)
    after = np.zeros(len(low), bool)
    after[:-1] = letter[1:]
    after[first[1:] - 1] = False
    if len(low):
        after[-1] = False
    size = np.flatnonzero(letter & ~after) + 1 - start
    whole = (word_hashes(low, start, size) >> np.uint64(64 - BITS)).astype(np.int32)
    begun = (word_hashes(low, start, np.minimum(size, PREFIX)) >> np.uint64(64 - BITS)).astype(np.int32)
    at = np.searchsorted(start, offsets)
    n = len(offsets) - 1
    place = np.arange(len(start)) + GAP * np.repeat(np.arange(n), np.diff(at))
    out = np.full((2, len(start) + GAP * n), PAD, np.int32)
    out[0, place], out[1, place] = whole, begun
    return out[0], out[1], at + GAP * np.arange(n + 1)


@dataclass
class Classifier:
    """Tables of what each hashed word adds to each filter at each place of it, the filters' biases and the last layer."""

    whole: np.ndarray
    begun: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    constant: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(offsets) - 1:
            return np.zeros(0)
        pooled, _ = _pool(lambda i, j: self.whole[a[i:j]] + self.begun[b[i:j]], self.bias, offsets)
        return 1 / (1 + np.exp(-(pooled @ self.weights + self.constant)))


def _pool(values: Callable[[int, int], np.ndarray], bias: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Largest filter values of each text, not below 0, and with ``places`` the first place of each. values(i, j): words i to j x (width, place, filter).

    A window has no words of another text, and about WORDS words are held at once, also of one long text.
    """
    n = len(offsets) - 1
    out, at = np.full((n, POOLED), -np.inf, np.float32), np.zeros((n, POOLED if places else 0), np.int64)
    for i, j in steps(offsets, WORDS):
        for low in range(int(offsets[i]), int(offsets[j]), WORDS):
            high = min(low + WORDS, int(offsets[j]))
            z = values(low, min(high + GAP, int(offsets[j])))
            edges = np.clip(offsets[i : j + 1] - low, 0, high - low)
            empty = (offsets[i + 1 : j + 1, None] - low - np.arange(1, GAP + 1)).ravel()
            empty = empty[(empty >= 0) & (empty < high - low)]
            column = 0
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                y = z[: high - low, column : column + FILTERS].copy()
                for m in range(1, width):
                    part = z[m : high - low + m, column + m * FILTERS : column + (m + 1) * FILTERS]
                    y[: len(part)] += part
                column += width * FILTERS
                y[empty] = 0
                y += bias[own]
                top = np.maximum.reduceat(y, edges[:-1], axis=0)
                if places:
                    first = np.stack([y[s:e].argmax(0) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]) + low + edges[:-1, None]
                    at[i:j, own] = np.where(top > out[i:j, own], first, at[i:j, own])
                out[i:j, own] = np.maximum(out[i:j, own], top)
    return np.maximum(out, 0), at


class Parameters:
    """Rows of SIZE numbers: both tables of embeddings, the filters, and biases, weights and constant; and the squares of all their gradients."""

    def __init__(self, values: np.ndarray, squares: np.ndarray) -> None:
        self.values, self.squares = values, squares
        self.moved = np.zeros(ROWS, bool)

    @staticmethod
    def begun(rng: np.random.Generator) -> Parameters:
        made = Parameters(np.zeros((ROWS, SIZE), np.float32), np.full((ROWS, SIZE), 1e-3, np.float32))
        whole, begun, filters, rest = Parameters.parts(made.values)
        for t in (whole, begun):
            t[:] = rng.normal(0, 0.1, t.shape)
            t[PAD] = 0
        filters[:] = rng.normal(0, 0.4, (SIZE, PLACES)).T
        rest[POOLED : 2 * POOLED] = np.abs(rng.normal(0, 0.3, POOLED))
        rest[POOLED + 1 : 2 * POOLED : 4] *= -1
        rest[2 * POOLED] = -1
        return made

    @staticmethod
    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of both tables, the filters (a row each place) and the biases, weights and constant."""
        return x[: PAD + 1], x[PAD + 1 : 2 * PAD + 2], x[2 * PAD + 2 : 2 * PAD + 2 + PLACES], x[2 * PAD + 2 + PLACES :].reshape(-1)

    def copy(self) -> Parameters:
        return Parameters(self.values.copy(), self.squares.copy())

    def classifier(self) -> Classifier:
        whole, begun, filters, rest = self.parts(self.values)
        return Classifier(whole @ filters.T, begun @ filters.T, rest[:POOLED].copy(), rest[POOLED : 2 * POOLED].astype(np.float64), float(rest[2 * POOLED]))


def improve(p: Parameters, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, epochs: range, of: int, rng: np.random.Generator, rate: float = 0.08) -> None:
    """Adagrad on the weighted logistic loss, 64 texts a step, over these of ``of`` epochs; the embeddings of words that matter least shrink. share: of label 1 among all documents."""
    whole, begun, filters, rest = p.parts(p.values)
    *squares, filter_squares, rest_squares = p.parts(p.squares)
    moved = p.moved[: PAD + 1], p.moved[PAD + 1 : 2 * PAD + 2]
    p.moved[2 * PAD + 2 :] = True
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in epochs:
        step_rate = rate * (1 - epoch / (of + 1))
        order = rng.permutation(len(docs))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            a = np.concatenate([docs[d][0] for d in some])
            b = np.concatenate([docs[d][1] for d in some])
            offsets = np.concatenate([[0], np.cumsum([len(docs[d][0]) for d in some])])
            weights = rest[POOLED : 2 * POOLED]
            pooled, places = _pool(lambda s, e: (whole[a[s:e]] + begun[b[s:e]]) @ filters.T, rest[:POOLED], offsets, places=True)  # noqa: B023
            score = 1 / (1 + np.exp(-(pooled @ weights + rest[2 * POOLED])))
            g = ((score - labels[some]) * weight[some] / len(some)).astype(np.float32)
            gp = g[:, None] * weights[None, :] * (pooled > 0)
            gf, gr = np.zeros_like(filters), np.zeros_like(rest)
            gr[:POOLED], gr[POOLED : 2 * POOLED], gr[2 * POOLED] = gp.sum(0), pooled.T @ g + 1e-4 * weights, g.sum()
            got: list[tuple[np.ndarray, np.ndarray]] = []
            at = 0
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                doc, column = np.nonzero(gp[:, own])
                amount, best = gp[:, own][doc, column], places[:, own][doc, column]
                for j in range(width):
                    ok = best + j < offsets[doc + 1]
                    spot, f = best[ok] + j, at + j * FILTERS + column[ok]
                    np.add.at(gf, f, (whole[a[spot]] + begun[b[spot]]) * amount[ok, None])
                    got.append((spot, filters[f] * amount[ok, None]))
                at += width * FILTERS
            spots, moves = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
            for table, total, seen, words in zip((whole, begun), squares, moved, (a, b), strict=True):
                rows, inverse = np.unique(words[spots], return_inverse=True)
                change = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(change, inverse, moves)
                change[rows == PAD] = 0
                total[rows] += change**2
                table[rows] -= step_rate * (change / np.sqrt(total[rows]))
                table[rows] *= 0.999
                seen[rows] = True
            gf += 1e-4 * filters
            for x, total, grad in ((filters, filter_squares, gf), (rest, rest_squares, gr)):
                total += grad**2
                x -= step_rate * grad / np.sqrt(total)


def rounds(n: int) -> int:
    """Times that n documents are gone over."""
    return int(np.clip(1000 * 64 // max(1, n), 8, 30))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int | None = None, rate: float = 0.08, seed: int = 7) -> Classifier:
    """A classifier of documents at hand."""
    rng = np.random.default_rng(seed)
    p = Parameters.begun(rng)
    epochs = epochs or rounds(len(docs))
    improve(p, docs, labels, float(labels.mean()), range(epochs), epochs, rng, rate)
    return p.classifier()


def best_threshold(scores: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """Middle of the widest range of thresholds with the fewest errors, where ``bad`` and ``good`` examples have each score; 0.5 without both labels."""
    if not bad.sum() or not good.sum():
        return 0.5
    s, inverse = np.unique(scores, return_inverse=True)
    bad, good = np.bincount(inverse, bad), np.bincount(inverse, good)
    errors = np.concatenate([[0], np.cumsum(bad)]) + good.sum() - np.concatenate([[0], np.cumsum(good)])
    edges = np.concatenate([[0.0], s, [1.0]])
    width = np.diff(edges)
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(width[best])]
    return float(np.clip((edges[k] + edges[k + 1]) / 2, 0.05, 0.95))


def thresholds_by_language(scores: np.ndarray, bad: np.ndarray, good: np.ndarray, langs: np.ndarray) -> dict[str, float]:
    """Each language's best threshold, drawn to the one of all languages the more the fewer examples it has."""
    common = best_threshold(scores, bad, good)
    found = {}
    for lang in np.unique(langs):
        own = langs == lang
        rarer = int(min(bad[own].sum(), good[own].sum()))
        share = rarer / (rarer + TRUSTED)
        found[str(lang)] = common + share * (best_threshold(scores[own], bad[own], good[own]) - common) if rarer else common
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """Train on the folds of ids whose crc32 (as text) is not 0 modulo 5."""
    return tidied(_fitted(docs, labels, id_col, text_col, lang_col))  # what it learnt from has gone by then


def _fold() -> Column:
    return F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)


def _learnt(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, toxic, lang and text of every labelled document of the learning folds, once an id."""
    bits = id_table(known, "id")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["id", "lang", "text"]).filter(pa.array(in_table(bits.value, batch.column("bit").to_numpy())))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(_fold())
    rows = rows.withColumn("bit", id_bit("id")).mapInArrow(labelled, "id long, lang string, text string")
    return rows.join(known, "id").groupBy("id").agg(F.first("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("row")).select("id", "toxic", "row.lang", "row.text")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for i, j in steps(offsets):
            a, b, at = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            both = np.stack([a, b], 1).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("id", "lang", "toxic")] + [pa.array([both[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["id", "lang", "toxic", "words"])


def _words(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(cell.as_buffer(), "<u2").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _round(table: DataFrame, p: Parameters, share: float, epochs: range, of: int, seed: int = 7) -> Parameters:
    """Parameters after these epochs of every shard: each row plus the mean of its changes over the shards that moved it."""
    shipped = table.sparkSession.sparkContext.broadcast((p.values, p.squares))
    names = [f"v{k}" for k in range(2 * SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((ROWS, 2 * SIZE), np.int64), np.zeros(ROWS, np.int64)

        def learn(shard: int, docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> None:
            before = Parameters(*shipped.value)
            own = before.copy()
            improve(own, docs, np.array(labels), share, epochs, of, np.random.default_rng((seed, epochs.start, shard)))
            at = np.flatnonzero(own.moved)
            change = np.concatenate([own.values[at].astype(np.float64) - before.values[at], own.squares[at].astype(np.float64) - before.squares[at]], 1)
            total[at] += np.rint(change * SCALE).astype(np.int64)
            count[at] += 1

        shard, docs, labels = -1, [], []
        for batch in batches:
            for s, y, w in zip(batch.column("shard").to_pylist(), batch.column("toxic").to_pylist(), batch.column("words"), strict=True):
                if s != shard and docs:
                    learn(shard, docs, labels)
                    docs, labels = [], []
                shard = s
                docs.append(_words(w))
                labels.append(y)
        if docs:
            learn(shard, docs, labels)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at])] + [pa.array(total[at, k]) for k in range(2 * SIZE)], ["row", "n", *names])
        tidied()

    moved = table.where("not aside").select("shard", "toxic", "words").mapInArrow(run, "row long, n long, " + ", ".join(f"{c} long" for c in names))
    got = moved.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).toArrow()  # ROWS rows at most
    shipped.destroy()
    row = got["row"].to_numpy()
    mean = np.stack([got[c].to_numpy() for c in names], 1) / (SCALE * got["n"].to_numpy()[:, None])
    new = p.copy()
    new.values[row] += mean[:, :SIZE].astype(np.float32)
    new.squares[row] += mean[:, SIZE:].astype(np.float32)
    return new


def _graded(table: DataFrame, classifier: Classifier) -> pa.Table:
    """Counts of both labels by language and step of the grid of scores, of the documents left out of training."""
    shipped = table.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(w) for w in batch.column("words")]
            offsets = np.concatenate([[0], np.cumsum([len(a) for a, _ in words])]).astype(np.int64)
            parts = [shipped.value.score(*(np.concatenate([w[k] for w in words[i:j]]) for k in (0, 1)), offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets, WORDS)]
            score = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(np.minimum((score * GRID).astype(np.int64), GRID - 1))], ["lang", "toxic", "step"])

    rows = table.where("aside").select("lang", "toxic", "words").mapInArrow(run, "lang string, toxic int, step long")
    return rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "step").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).toArrow()


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> Classifier:
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(_fold() & F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    size = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(F.col(text_col).cast("string")).alias("size")).join(known, "id").groupBy("id").agg(F.max("size").alias("size")).agg(F.count("id"), F.sum("size")).first()
    shards = max(1, -(-int(size[0]) // SHARD), -(-int(size[1] or 0) // SHARD_BYTES))
    rows = _learnt(docs, known, id_col, text_col, lang_col).mapInArrow(_hashed, "id long, lang string, toxic int, words binary")
    rows = rows.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "aside": F.crc32(F.concat(F.lit("aside "), F.col("id").cast("string")).cast("binary")) % CALIBRATION == 0})
    table = shared_table(rows.repartition(shards, "shard").sortWithinPartitions("shard", "id"), "learnt")
    try:
        n = {(r.aside, r.toxic): r["count"] for r in table.groupBy("aside", "toxic").count().collect()}
        bad, good = n.get((False, 1), 0), n.get((False, 0), 0)
        if not bad or not good:
            share = (bad + n.get((True, 1), 0)) / sum(n.values()) if n else 0.5
            logit = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
            zero = np.zeros((PAD + 1, PLACES), np.float32)
            return Classifier(zero, zero, np.zeros(POOLED, np.float32), np.zeros(POOLED), float(logit))
        p, of = Parameters.begun(np.random.default_rng(7)), rounds(bad + good)
        for epochs in [range(of)] if shards == 1 else [range(e, e + 1) for e in range(of)]:
            p = _round(table, p, bad / (bad + good), epochs, of)
        found = p.classifier()
        held = _graded(table, found)
        if len(held):
            found.thresholds = thresholds_by_language((held["step"].to_numpy() + 0.5) / GRID, held["bad"].to_numpy(), held["good"].to_numpy(), np.array(held["lang"].to_pylist()))
        return found
    finally:
        drop_table(table)


def scored(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a row of ``docs``: id_col, score, threshold of its language, flagged (score not below it)."""
    shipped = docs.sparkSession.sparkContext.broadcast((classifier.whole, classifier.begun, classifier.bias, classifier.weights, classifier.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        model = Classifier(*shipped.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            scores = [model.score(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in steps(offsets, 1 << 19)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate([np.zeros(0), *scores]))], [id_col, "_lang", "score"])
        tidied()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    threshold = F.lit(0.5)
    for lang, value in sorted(classifier.thresholds.items()):
        threshold = F.when(F.coalesce("_lang", F.lit("")) == lang, F.lit(value)).otherwise(threshold)
    out = rows.mapInArrow(run, f"`{id_col}` long, _lang string, score double").withColumn("threshold", threshold)
    return out.select(id_col, "score", "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def without_flagged(docs: DataFrame, classifier: Classifier, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below their language's threshold; nothing is shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast((classifier.whole, classifier.begun, classifier.bias, classifier.weights, classifier.constant))
    thresholds = dict(classifier.thresholds)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        model = Classifier(*shipped.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            scores = [model.score(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in steps(offsets, 1 << 19)]
            limits = np.array([thresholds.get(x or "", 0.5) for x in batch.column(lang_at).to_pylist()])
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < limits))
        tidied()

    return docs.mapInArrow(run, docs.schema)
