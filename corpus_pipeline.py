"""Corpus pipeline: each stage reads what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import stages
from quarry.session import read_table, scratch_path

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup_stage),
    ("near_dedup", stages.near_dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("byte_bpe", stages.byte_bpe_stage),
]

#: Stages beyond the rules (sketches, latent vectors, tokenizers) have no SQL; tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the documents table; each one's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
