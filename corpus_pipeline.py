"""From raw documents to packed training sequences, as stages of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwise.llm import runtime, stages

#: (name, function); each function takes (spark, docs, sf_dir) and returns the next one's docs.
STAGES = [
    ("language_id", stages.by_language),
    ("line_dedup", stages.without_boilerplate),
    ("simhash", stages.without_near_copies),
    ("decontamination", stages.without_benchmark),
    ("packing", stages.packed),
]

#: SQL can express neither the classifier nor the tokeniser; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
