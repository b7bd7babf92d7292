"""The corpus pipeline: documents through quality, near-duplicates, decontamination, secrets and mixing.

Defined cases are those of the stages (quarry/llm/queries.py): ids and further columns pass through, null and empty texts are empty, repeated
rows leave one, an empty table gives an empty result. Rows are lost only by a stage's decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import queries
from quarry.llm.common import cut

STAGES = [
    ("quality_classifier", queries.stage_quality),
    ("near_duplicates", queries.stage_near_duplicates),
    ("decontamination", queries.stage_decontamination),
    ("secrets", queries.stage_secrets),
    ("mixing", queries.stage_mixing),
]

#: Trained models and likelihoods cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written as Parquet and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
