"""Queries over documents: each document is read as an attempt whose notes are its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.bpe import encode_notes
from paceline.llm.importance import sample_usable_notes
from paceline.llm.jaccard import near_duplicate_notes
from paceline.llm.leaks import find_leaked_items
from paceline.llm.passages import remove_repeated_passages
from paceline.llm.registry import query


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return as_attempts(spark.read.parquet(f"{sf}/documents.parquet"))


def as_attempts(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(F.col("doc_id").alias("attempt_id"), F.col("text").alias("notes"), F.col("lang").alias("location"), F.col("source").alias("attempt_type"), *more)


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id FROM sets
"""


@query("op2_ngram_jaccard_join", JACCARD_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicate_notes(attempts(spark, sf), shingle_words=4, percent=85)
    return found.select(F.col("attempt_id").alias("doc_id"), "n_shingles", "component_id")


PASSAGES_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, list(i) AS s FROM windows WHERE h IN (SELECT h FROM repeated) GROUP BY doc_id),
covered AS (SELECT doc_id, list_distinct(flatten(list_transform(s, lambda i: range(i, i + 35)))) AS c FROM starts)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(c), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN c IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(c, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN covered USING (doc_id)
"""


@query("op10_substring_dedup", PASSAGES_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = remove_repeated_passages(attempts(spark, sf), window_words=35)
    return found.select(F.col("attempt_id").alias("doc_id"), "n_words", "n_removed", F.sha2("notes", 256).alias("kept_sha256"))


def usable_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of good quality without toxicity are usable."""
    return spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("attempt_id"), (F.coalesce("quality", F.lit(0)) == 1).cast("int").alias("q"), "toxic").selectExpr("attempt_id", "if(q = 1 and coalesce(toxic, 0) = 0, 1, 0) as usable")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = sample_usable_notes(attempts(spark, sf), usable_labels(spark, sf))
    return found.select(F.col("attempt_id").alias("doc_id"), "log_weight", "sample_key", "kept")


LEAKS_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
held AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM words),
wanted AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM items),
sizes AS (SELECT item_id, count(*) AS n FROM wanted GROUP BY 1)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, count(*)::BIGINT AS n_found
FROM held JOIN wanted USING (t) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
"""


def benchmark_items(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("case_id"), F.col("text").alias("evidence"))


@query("op3_benchmark_decontamination", LEAKS_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = find_leaked_items(attempts(spark, sf), benchmark_items(spark, sf))
    return found.select(F.col("attempt_id").alias("doc_id"), F.col("case_id").alias("item_id"), "n_shingles", "n_found")


def vocabulary() -> str:
    """Where the public word-level BPE vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_bpe_encoding_decoding")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = encode_notes(attempts(spark, sf), vocabulary(), decoded=True)
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return found.select(F.col("attempt_id").alias("doc_id"), "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("notes", 256).alias("decoded_sha256"))
