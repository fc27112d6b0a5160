"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept and returns the columns of documents; the last returns the
packed pieces.  ``run`` writes each stage's result as Parquet in the shared folder and reads it back for the next.

Every stage takes an empty table (and gives one), more columns than those of documents (and returns them unchanged),
repeated rows and ids, null ids, null texts (as empty ones) and texts of any length, which it works on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlake.llm import exact, langid, neardup, packing, pii
from gridlake.llm.queries import tokenizer_path
from gridlake.llm.shared import cut


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the fused evidence accepts; those without letters, null texts too, go."""
    return langid.keep_accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that differ in the case of A-Z at most: that with the largest id, nulls lowest."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least id, nulls last; those without words all stay."""
    return neardup.drop_near(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked, disclosing terms generalised or removed; null texts stay null."""
    return pii.sanitise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens placed in sequences; a null or empty text is one piece of one token."""
    return packing.best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: SQL expresses none of the learned, sketched or tokenised stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
