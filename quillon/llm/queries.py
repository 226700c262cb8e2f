"""The queries of this subpackage's operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_convert, byte_bpe, chat_format, decontaminate, language_id, licenses, simhash, token_counts, toxicity, vector_graph
from .storage import fresh_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _ranks() -> dict[bytes, int]:
    return byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_counts.zipf_scores(_ranks())
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", scores, public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), "doc_id", "text", _ranks(), public_tokenizers.PATTERN)


def op3_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vector_graph.nearest(vectors, "vec_id", "embedding", vectors.filter(F.col("vec_id") % 20 == 0))


def op4_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arc_convert.archive_pages(_table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, _table(spark, sf_dir, "labels")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.train(documents))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: here each lies at source/fold/folder, 64 to a folder and 16 folders to a fold, and
    those with the first id of a folder or fold are its licence file."""
    number = F.col("doc_id").cast("long")
    folder, fold = F.floor(number / 64), F.floor(number / 1024)
    top = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), fold.cast("string"))
    inner = F.concat_ws("/", top, folder.cast("string"))
    path = F.when(number % 1024 == 0, F.concat(top, F.lit("/LICENSE"))).when(number % 64 == 0, F.concat(inner, F.lit("/LICENSE")))
    documents = _table(spark, sf_dir, "documents").withColumn("path", path.otherwise(F.concat(inner, F.lit("/"), number.cast("string"), F.lit(".txt"))))
    return licenses.scan(documents, "doc_id", "path", "text")


#: The conversation that every run formats besides those of the table.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return chat_format.summarize(chat_format.format_conversations(rows.union(probe)))


OP8_SQL = r"""
WITH rows_ AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, contains(text, '<|') OR contains(role, '<|') OR contains(role, chr(10)) AS esc FROM rows_
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(24 + CASE WHEN esc
    THEN 7 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
    ELSE length(role) + length(text) END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_vector_graph": op3_vector_graph,
    "op4_arc_convert": op4_arc_convert,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_licenses": op10_licenses,
}
OP4_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
  SELECT payload_digest, max(page_id) AS kept FROM sized WHERE payload_bytes >= 1000 AND page_id IS NOT NULL GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN kept IS NOT NULL AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM sized LEFT JOIN kept USING (payload_digest)
"""

ORACLE_SQL = {"op4_arc_convert": OP4_SQL, "op8_chat_format": OP8_SQL}
