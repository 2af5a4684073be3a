"""Toxic documents go, one of each group of near copies stays, repeated strings are cut out, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every one but the
last returns the columns of ``documents``. Stages are written as Parquet and
read again before the next. Columns beyond doc_id and text pass through as
they are, whatever their names; n_chars follows the text where it changes.
Rows are judged one by one, also those that share an id or have none: of rows
with the same id and text one stays, and a null id comes after all others. An
empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.llm import ngram_join, packing, suffix_dedup, toxicity
from strandmap.llm.registry import tokenizer_file
from strandmap.llm.shared import drop_table, shared_table, table

#: Columns of ``documents`` that stages read.
USED = ("doc_id", "text", "lang", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with plain names: those the stages use as they are, any other by its place, so none clashes or needs quotes."""
    return docs.toDF(*(c if c in USED else f"_{i}" for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not flag; it learns from the labels of what it is given."""
    rows = _plain(docs)
    return toxicity.without_flagged(rows, toxicity.fit(rows, table(spark, sf_dir, "labels"))).toDF(*docs.columns)


def _keyed(rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a column that no two share, in order of ids, and its name: doc_id where it is one. Of rows with the same id and text, one."""
    if rows.groupBy("doc_id").count().where("`count` > 1 or doc_id is null").isEmpty():
        return rows, "doc_id"
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    keyed = shared_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_key", F.monotonically_increasing_id()), "keyed")
    one = keyed.groupBy("doc_id", F.sha2("text", 256)).agg(F.min("_key").alias("_key")).select("_key")
    return keyed.where("doc_id is null").unionByName(keyed.where("doc_id is not null").join(one, "_key", "left_semi")), "_key"


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component of near copies."""
    plain = _plain(docs)
    rows, key = _keyed(plain)
    joined = ngram_join.joined(rows, 0.75, 5, id_col=key)
    gone = joined.where(F.col("component_id") != F.col(key)).select(key).distinct()
    return rows.join(gone, key, "left_anti").select(plain.columns).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier; a document of which nothing is left goes."""
    plain = _plain(docs)
    rows, key = _keyed(plain)
    kept = suffix_dedup.deduplicated(rows, 100, id_col=key, keep_text=True).where("n_removed > 0")
    kept = kept.select(F.col(key).alias("_row"), (F.col("n_removed") < F.col("n_bytes")).alias("_some"), F.col("kept_text").alias("_kept"))
    both = rows.join(kept, rows[key] == kept["_row"], "left").where("_some is null or _some")
    cut = F.col("_some").isNotNull()
    new = {"text": F.when(cut, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in plain.columns:
        new["n_chars"] = F.when(cut, F.char_length("_kept").cast(plain.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.select(*(new.get(c, F.col(c)).alias(c) for c in plain.columns)).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.packed(_plain(docs), tokenizer_file("byte_bpe_50k.json"), 1024)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("suffix_dedup", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written into the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
        drop_table(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: the classifier, the components and the packing are beyond it.
ORACLE_SQL = None
