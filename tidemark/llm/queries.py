"""Queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, licenses, media_shards, mixing, neardup, passages, pii, quality, sharding, token_orc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("copy")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=4)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(documents, labels)
    scored = quality.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: each document gets one by rule, in folders up to four deep, every
    fiftieth named as a licence file is."""
    documents = _table(spark, sf_dir, "documents")
    digit = lambda at: F.concat(F.lit("d"), F.floor(F.col("doc_id") / at) % 10)
    folders = F.array("source", "lang", digit(50), digit(500))
    file = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.slice(folders, 1, (F.col("doc_id") % 4 + 1).cast("int")), file)
    return licenses.scan_licenses(documents, path)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media_shards.store_and_read_back(_table(spark, sf_dir, "documents"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "offset", "length", "width", "height")


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_orc.encode_and_read_back(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(_table(spark, sf_dir, "documents")).drop("kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "place", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_neardup, op4_quality, op5_licenses, op6_media, op7_orc_tokens, op8_passages, op9_mixing, op10_sharding, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {}
