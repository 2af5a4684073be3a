"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.llm import hard_negatives, manifest, media, ngram_join, packing, pieces, quality_rules, sharding, suffix_dedup, token_counts, tool_calls, topk, toxicity
from strandmap.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more."""
    return ngram_join.joined(table(spark, sf_dir, "documents"), 0.75, 5)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near equal bytes in shards 0 to 15, equal texts together."""
    return sharding.sharded(table(spark, sf_dir, "documents"), 16).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as PNG, read back and hashed."""
    return media.decoded(media.encoded(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("cosine_hash")).alias("feature"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users ask linked to what the assistant answers, as canonical JSON; a row each message that is no first answer."""
    return tool_calls.linked(*tool_calls.of_conversations(table(spark, sf_dir, "conversations")), tool_calls.REPLY, further=True)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, 50, 256.0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a classifier fitted on the learning folds of ``labels``."""
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether there are over 512."""
    return token_counts.with_limit(token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")), 512)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 1024)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    return pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_pieces=False)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 100-byte strings that start earlier."""
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), 100)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all documents in a tree of pairs, and where tampered ones lead."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest.manifest(table(spark, sf_dir, "documents"), replaced={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    proof = F.sha2(F.array_join("siblings", ""), 256)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs that a stratum's labels certify: false rejections of at most 5 in 100."""
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), risk=0.05, error=0.05)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "level", "usable", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score 30 to 90 % of a positive, for every 100th vector and its 5 positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), 5, 10, 100, 30, 90, 256.0, label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_sharding": op2_sharding,
    "op3_media_columns": op3_media_columns,
    "op4_tool_calls": op4_tool_calls,
    "op5_top_k": op5_top_k,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_pieces": op9_pieces,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_manifest": op11_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Rows whose vectors all have finite components; equal lengths, as in the tables.
ORACLE_SQL: dict[str, str] = {
    "op5_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_manifest": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(list_concat([4294967295], list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
f AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END, n_chars) AS other, coalesce(strlen(text) || ':' || text, '-') AS tail FROM d),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(other AS VARCHAR)) || ':' || other, '-') || tail) AS new FROM f),
low AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM low WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, level AS height FROM low WHERE len(nodes) = 1),
up AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM up WHERE len(nodes) > 1),
path AS (
  SELECT doc_id, new, level, CASE WHEN (pos >> level) % 2 = 1 THEN nodes[pos >> level] ELSE coalesce(nodes[(pos >> level) + 2], '') END AS other, (pos >> level) % 2 AS slot
  FROM leaves JOIN low ON leaves.lang IS NOT DISTINCT FROM low.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, new, height + up.level, CASE WHEN (place >> up.level) % 2 = 1 THEN nodes[place >> up.level] ELSE coalesce(nodes[(place >> up.level) + 2], '') END, (place >> up.level) % 2
  FROM leaves JOIN sub ON leaves.lang IS NOT DISTINCT FROM sub.lang CROSS JOIN up WHERE len(nodes) > 1),
steps AS (SELECT doc_id, list(other ORDER BY level) AS others, list(slot ORDER BY level) AS slots FROM path GROUP BY doc_id),
fold AS (
  SELECT leaves.doc_id, new AS digest, 1 AS k, coalesce(others, []) AS others, coalesce(slots, []) AS slots FROM leaves LEFT JOIN steps USING (doc_id)
  UNION ALL
  SELECT doc_id, sha256(CASE WHEN slots[k] = 1 THEN others[k] || digest ELSE digest || others[k] END), k + 1, others, slots FROM fold WHERE k <= len(others))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(others, '')) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM leaves JOIN fold USING (doc_id) JOIN sub ON leaves.lang IS NOT DISTINCT FROM sub.lang CROSS JOIN (SELECT nodes[1] AS root FROM up WHERE len(nodes) = 1)
WHERE k = len(others) + 1
""",
    "op12_quality_rules": """
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM m, (VALUES (0), (1), (2)) AS ks(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s0 AS (SELECT d.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [least(n_symbols * 1000 // greatest(n_words, 1), 4000), least(n_marks * 1000 // greatest(n_words, 1), 4000), least(n_capitals * 1000 // greatest(word_chars, 1), 4000),
  least(n_dup_lines * 1000 // greatest(n_lines, 1), 4000), least(n_repeat_words * 1000 // greatest(n_words, 1), 4000), least(word_chars * 1000 // greatest(n_words, 1), 4000)] AS shares FROM s0),
known AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT doc_id, lang, good, shares, sha256(CAST(doc_id AS VARCHAR))[1] IN ('0', '1', '2', '3') AS fit FROM s JOIN known USING (doc_id) WHERE NOT base_failed),
tot AS (SELECT count(*) FILTER (good) AS tg, count(*) FILTER (NOT good) AS tb FROM lab WHERE fit),
h AS (SELECT good, rule, value, count(*) AS n FROM (SELECT good, unnest(shares) AS value, generate_subscripts(shares, 1) AS rule FROM lab WHERE fit) GROUP BY ALL),
grid AS (SELECT rule, v FROM (SELECT unnest(range(1, 7)) AS rule), (SELECT unnest(range(0, 4001)) AS v)),
b AS (SELECT grid.rule, v, tg, tb, tg - coalesce(sum(a.n) OVER p, 0) AS bg, tb - coalesce(sum(c.n) OVER p, 0) AS bb FROM grid CROSS JOIN tot LEFT JOIN h a ON a.rule = grid.rule AND a.value = v AND a.good LEFT JOIN h c ON c.rule = grid.rule AND c.value = v AND NOT c.good
  WINDOW p AS (PARTITION BY grid.rule ORDER BY v ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([0.001::DOUBLE, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06]) AS share),
cut AS (SELECT rule, k, min(v) AS cut FROM b CROSS JOIN lv WHERE bg <= share * tg AND bb::DOUBLE / greatest(tb, 1) >= 3.0::DOUBLE * ((bg + 1)::DOUBLE / (tg + 1)) GROUP BY rule, k),
fired AS (SELECT doc_id, min(k) AS level FROM (SELECT doc_id, unnest(shares) AS value, generate_subscripts(shares, 1) AS rule FROM s) JOIN cut USING (rule) WHERE value > cut GROUP BY doc_id),
lev AS (SELECT s.*, coalesce(level, 8) AS level FROM s LEFT JOIN fired USING (doc_id)),
fitted AS (SELECT good, level FROM lab JOIN (SELECT doc_id, level FROM lev) USING (doc_id) WHERE fit),
gain AS (SELECT k, (count(*) FILTER (NOT good AND level <= k))::DOUBLE / greatest(count(*) FILTER (NOT good), 1) - (count(*) FILTER (good AND level <= k))::DOUBLE / greatest(count(*) FILTER (good), 1) AS g FROM lv LEFT JOIN fitted ON true GROUP BY k),
useful AS (SELECT coalesce(min(k) FILTER (g > 0 AND g = (SELECT max(g) FROM gain)), -1) + 1 AS most FROM gain),
held AS (SELECT lang, k, count(*) AS n, count(*) FILTER (level <= k) AS lost FROM lab JOIN (SELECT doc_id, level FROM lev) USING (doc_id) CROSS JOIN lv WHERE NOT fit AND good GROUP BY lang, k),
tail AS (SELECT lang, k, lost >= n OR list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln(0.05) + (n - i) * ln(0.95)))) > 0.05 / (SELECT count(DISTINCT coalesce(lang, '-')) FROM held) AS fails FROM held),
use AS (SELECT lang, least(coalesce(min(k) FILTER (fails), 8), (SELECT most FROM useful)) AS usable FROM tail GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, level::INTEGER AS level, coalesce(usable, 0)::INTEGER AS usable, NOT base_failed AND level >= coalesce(usable, 0) AS kept
FROM lev LEFT JOIN use ON lev.lang IS NOT DISTINCT FROM use.lang
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
}
