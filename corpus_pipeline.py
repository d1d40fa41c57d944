"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, near_dup, packing, quality
from tessera.llm.common import written

STAGES = [
    ("quality_rules", quality.stage),
    ("language_id", language_id.stage),
    ("minhash_near_dup", near_dup.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

#: Compression (stage 2) and sub-word lengths (stage 5) have no SQL form; tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
