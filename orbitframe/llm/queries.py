"""The queries op1 to op10 and pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_ids

    return token_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op3_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectors

    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.measure(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classifier

    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_ids, op2_lpt_shards, op3_vector_graph, op4_secret_scan, op5_quality_rules, op6_quality_classifier, op7_shingle_join, op8_language_fusion, op9_order_packing, op10_byte_bpe, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
