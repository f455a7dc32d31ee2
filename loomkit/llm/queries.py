"""The queries of the corpus operators over the synthetic tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from loomkit.llm import binary, decontaminate, licenses, neardup, packing, quality, repeats, secrets, tokens, toxicity
from loomkit.llm.common import documents, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return tokens.over_limit(tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))).drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_digest(packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.digest(quality.judge(docs, weights))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_passages(docs, benchmark))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.digest(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(documents(spark, sf_dir).select("doc_id", "text")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(documents(spark, sf_dir)))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary.stored(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict:
    found = (op1_token_counts, op2_packing, op3_quality, op4_near_duplicates, op5_secrets, op6_decontamination, op7_toxicity, op8_licenses, op9_repeats, op10_token_store)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": decontaminate.SQL}
