"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import chat, html_main, language, licenses, mixing, near_duplicates, oracles, pieces, quality, simhash, token_io
from veilspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.class_rows(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat.digest(chat.format_conversations(turns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
f AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS fill FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY fill, source NULLS LAST) AS rk FROM f),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps,
             sum(weight) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
             sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, (total - caps) / weights AS lv FROM c),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(lv, rk) FROM l WHERE fill >= lv) * weight) AS target FROM l),
x AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * least(whole + CASE WHEN middle < target - whole * source_size THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM x
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).drop("spans")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_documents(docs, language.fit(docs))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids' digest and the round trip of every whole text."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).drop("ids")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(table(spark, sf_dir, "pages"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.token_file_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Query]:
    return {"op1_quality": op1_quality, "op2_jaccard_join": op2_jaccard_join, "op3_chat": op3_chat, "op4_mixing": op4_mixing, "op5_licenses": op5_licenses, "op6_simhash": op6_simhash, "op7_language": op7_language, "op8_pieces": op8_pieces, "op9_html": op9_html, "op10_token_ids": op10_token_ids}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": oracles.OP1_SQL, "op2_jaccard_join": oracles.OP2_SQL, "op3_chat": oracles.OP3_SQL, "op4_mixing": OP4_SQL}
