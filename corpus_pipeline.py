"""The corpus pipeline: each stage works on all that the stage before it kept.

A stage is a function (spark, docs, sf_dir) that returns a DataFrame; each result is written as
Parquet and read back as the next stage's docs. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.llm import jaccard, langid, packing, quality, scratch, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is none of the known ones."""
    return langid.keep_known(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of similar ones."""
    return jaccard.keep_one(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; all documents stay."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)


STAGES: list[tuple[str, Stage]] = [("language", language), ("rules", rules), ("near_duplicates", near_duplicates), ("no_secrets", no_secrets), ("pack", pack)]

#: Trigram models, tokenizers and joins of shingles are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        mark = scratch.mark()
        docs, at = scratch.written(stage(spark, docs, sf_dir), name)
        # What the stage wrote for itself goes, and the stage before it.
        scratch.drop_since(spark, mark, at)
        scratch.drop(spark, *before)
        before = [at]
    return STAGES[-1][1](spark, docs, sf_dir)
