"""Operator 7, token counts by a compiled finite-state tokenizer (see ``bpe``).

A null text is an empty text with no tokens. Ties and repeated rows: every row
is counted for itself. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.bpe import counted
from strandmap.llm.shared import text_buffer


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id_col, n_bytes (UTF-8) and n_tokens, as the tokenizers library counts them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counted(tokenizer, data, offsets), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(count, f"`{id_col}` long, n_bytes long, n_tokens long")


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Adds over_limit: more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
