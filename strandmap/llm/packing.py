"""Operator 8, cost-balanced packing of documents into sequences of tokens.

A document costs ``linear * tokens + quadratic * tokens ** 2``, as attention
does. Within a block of neighbouring documents (about a million tokens of one
input partition) the documents are taken from the dearest to the cheapest, and
each goes to the cheapest sequence that has room for it; where none has, it is
cut to fill the cheapest sequence that has any room. A document as long as a
sequence or longer first fills whole sequences of its own. A block has as many
sequences as its tokens need, so only its last one is short, and blocks are
packed where they lie: nothing is shuffled, and a task that runs again yields
the same sequences.

A null text is an empty text: it has only the closing id. A row with a null id
is packed like any other. Equal costs: the earlier row, the lower sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.bpe import encoder
from strandmap.llm.shared import steps, text_buffer, tidied

BLOCK_TOKENS = 1 << 20
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(tokens: np.ndarray | float, linear: float, quadratic: float) -> np.ndarray | float:
    return linear * tokens + quadratic * tokens * tokens


def pack(tokens: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """Pieces (document, start, length, sequence, offset) of one block; sequences count from 0."""
    whole = tokens // capacity
    full = np.repeat(np.arange(len(tokens)), whole)
    number = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    n_full = len(full)
    pieces = [np.stack([full, number * capacity, np.full(n_full, capacity), np.arange(n_full), np.zeros(n_full, np.int64)], 1)] if n_full else []
    rest = tokens % capacity
    left = np.flatnonzero(rest)
    n = -(-int(rest.sum()) // capacity)
    room, load = np.full(n, capacity), np.zeros(n)
    out = []
    for d in left[np.lexsort([left, -rest[left]])].tolist():  # costs grow with tokens
        start, size = int(whole[d]) * capacity, int(rest[d])
        while size:
            fits = np.flatnonzero(room >= size)
            open_ = fits if len(fits) else np.flatnonzero(room > 0)
            s = int(open_[np.argmin(load[open_])])
            part = min(size, int(room[s]))
            out.append((d, start, part, n_full + s, capacity - int(room[s])))
            room[s] -= part
            load[s] += cost(part, linear, quadratic)
            start, size = start + part, size - part
    if out:
        pieces.append(np.array(out, np.int64))
    return np.concatenate(pieces) if pieces else np.zeros((0, 5), np.int64)


def packed(docs: DataFrame, tokenizer: str, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 4096, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True).encode
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            tokens, flat, key = np.concatenate(sizes), np.concatenate(ids), pa.concat_arrays(keys)
            pieces = pack(tokens, capacity, linear, quadratic)
            base = np.cumsum(tokens) - tokens
            doc, start, length, seq, at = pieces.T
            raw, begin = memoryview(flat.astype("<u4").view(np.uint8)), (base[doc] + start) * 4
            slices = [raw[b : b + 4 * n] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [key.take(pa.array(doc)), start, length, np.array([zlib.crc32(x) for x in slices], np.int64), tokens[doc], sequence + seq, at]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in slices], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)
            sequence += int(seq.max()) + 1 if len(seq) else 0
            held = 0
            for x in (keys, ids, sizes):
                x.clear()

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in steps(offsets):
                got, bounds = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids.append(np.insert(got, bounds[1:], closing_id).astype(np.uint32))
                sizes.append(np.diff(bounds) + 1)
                keys.append(batch.column(0).slice(i, j - i))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield from flush()
        if held:
            yield from flush()
        tidied()

    schema = f"`{id_col}` long, {SCHEMA}" + ", ids array<int>" * with_ids
    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", ")), *["ids"] * with_ids]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, schema)
