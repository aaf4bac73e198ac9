"""A training corpus from ``documents``: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of ``documents``; the last gives the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fabula.llm import op1_toxicity, op7_packing, op8_substring, op10_icws
from fabula.llm.common import written


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", op1_toxicity.stage),
    ("near_dedup", op10_icws.stage),
    ("substring_dedup", op8_substring.stage),
    ("packing", packing),
]

#: Trained models, sampled hashes and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(spark, docs)
    return docs
