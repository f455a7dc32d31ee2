"""A corpus pipeline over documents: quality rules, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. The first four return the columns of docs:
documents that the quality rules reject go, one document of each near-duplicate class stays, documents with benchmark
passages go, and secrets are replaced in the texts. The last returns the packed pieces.

A null text is an empty one: the quality rules reject it, as any text of under 50 words; the later stages take it too, as a
text without words, benchmark passages or secrets, and pack its end mark. Very long texts are handled whole. Of repeated rows
one stays, and of ties the row with the least id; rows with a null id are judged like others. Empty tables give empty
results; further columns, whatever their names, are passed on up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.llm import decontaminate, neardup, packing, quality, secrets
from loomkit.llm.common import cut, documents, forget, table, whole_row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select("doc_id", "text", whole_row(docs).alias("row")), weights)
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(docs.select("text", whole_row(docs).alias("row")), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces_digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("packing", pack)]

#: No SQL: line labels, sketches and tokenizers are beyond it. tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last keeps is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)  # the stage after it has been written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
