"""Named queries of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.llm import (
    alignment,
    chat,
    exact_dedup,
    html_extract,
    lm_scoring,
    near_dedup,
    packing,
    resampling,
    sentencepiece_bpe,
    simhash,
    token_files,
    top_k,
    toxicity,
)
from loresift.llm.common import read_table, settle
from loresift.session import scratch_path


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    return scored.select(
        "doc_id", "held_out", "score", "predicted", "n_words", F.size("passages").alias("n_passages")
    )


def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.label_copies(read_table(spark, folder, "documents"), exact_dedup.new_index(spark))


def near_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return near_dedup.near_duplicates(docs, width=2, similarity=80).select(
        "doc_id", "n_shingles", "component_id", "kept", "class_id"
    )


def lm_scoring_query(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def sentencepiece_query(spark: SparkSession, folder: str) -> DataFrame:
    """What each text encodes to, and what its ids decode to, read back from the written ids."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = settle(sentencepiece_bpe.encode(read_table(spark, folder, "documents"), path), "piece-ids")
    return sentencepiece_bpe.round_trip(encoded, path)


def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, "words", keep_ids=False).drop("ids")


def token_files_query(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "token-files")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(read_table(spark, folder, "documents"), target, path, "spaced")
    return token_files.document_spans(spark, target)


def html_query(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(read_table(spark, folder, "pages"))


def top_k_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    return top_k.top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


def chat_query(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_conversations(settle(chat.format_conversations(rows), "conversations"))


def alignment_query(spark: SparkSession, folder: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(read_table(spark, folder, "documents"), a, b)


def resampling_query(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    return resampling.resample(docs, target, longest=1, buckets=10_000, seed=2024, least_words=20, percent=10)


def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"), width=4, distance=4, seed=42)


QUERIES = {
    "op1_toxicity": toxicity_query,
    "op2_minhash_near_dedup": near_dedup_query,
    "op3_lm_scoring": lm_scoring_query,
    "op4_packing": packing_query,
    "op5_sentencepiece": sentencepiece_query,
    "op6_exact_dedup": exact_dedup_query,
    "op7_token_files": token_files_query,
    "op8_html_extraction": html_query,
    "op9_exact_top_k": top_k_query,
    "op10_chat_formatting": chat_query,
    "op11_tokenizer_alignment": alignment_query,
    "op12_importance_resampling": resampling_query,
    "op13_simhash_near_dedup": simhash_query,
}

ORACLE = {
    "op6_exact_dedup": r"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
""",
    "op9_exact_top_k": """
WITH parts AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings
), good AS (
  SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts
  WHERE vec_id NOT IN (SELECT vec_id FROM parts WHERE x IS NULL OR isnan(x) OR isinf(x))
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
""",
    "op12_importance_resampling": r"""
WITH steps AS (
  SELECT i, list_reduce(list_prepend(i, range(8)),
                        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS step
  FROM range(256) AS numbers(i)
), crc AS (
  SELECT list(step ORDER BY i) AS steps FROM steps
), said AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), spelt AS (
  SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM said)
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(len(digits) // 2),
                                                   lambda i: CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256))) % 10000 AS bucket
  FROM spelt, crc
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM said JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT CAST(count(*) FILTER (side = 'd') AS DOUBLE) AS s_all, CAST(count(*) FILTER (side = 'b') AS DOUBLE) AS t_all FROM said
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, totals
), weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM said JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                     / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
""",
}
