"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Each query reads its whole table.  Tokenizer files are found by ``tokenizer_path``: the folder in
``GRIDLAKE_TOKENIZERS`` if set, else the installed ``public_tokenizers``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import bpe, counts, exact, langid, media, neardup, packing, pii, quality, warc


def tokenizer_path(name: str) -> str:
    folder = os.environ.get("GRIDLAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, whose markup declares the language and whose addresses have a suffix: all evidence acts."""
    return langid.identify_pages(_pages(spark, sf_dir)).select(F.col("key").alias("page_id"), "lang", "posterior", "declared", "accepted")


def language_id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(_docs(spark, sf_dir)).select(F.col("key").alias("doc_id"), "lang", "posterior", "declared", "accepted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_pages(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_docs(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_docs(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_docs(spark, sf_dir)).drop("tile")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.edit_counts(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "language_id_documents": language_id_documents,
        "op2_warc": op2_warc,
        "op3_quality": op3_quality,
        "op4_bpe": op4_bpe,
        "op5_near_dedup": op5_near_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_packing": op7_packing,
        "op8_media": op8_media,
        "op9_token_counts": op9_token_counts,
        "op10_pii": op10_pii,
    }


#: Base32 of a SHA-1: eight groups of 20 bits, four letters each.
_BASE32 = """list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((CAST('0x' || substr(h, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) & 31) + 1), 1)), 'string_agg', '')), 'string_agg', '')"""

OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN p.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = m.top THEN NULL ELSE m.top END AS refers_to
FROM p JOIN m USING (body)
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op6_exact_dedup": OP6_SQL}
