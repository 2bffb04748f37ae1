"""The corpus pipeline's stages.

Each function takes (spark, docs, sf_dir).  All but the last return the
documents they keep, with the columns of ``docs`` as they came.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from quarry.llm.queries import MIN_SITES, RANKS
from quarry.session import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the current quality policy."""
    return quality.keep_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their boilerplate lines; ``n_chars`` follows the text where it is a column.
    Documents that consist mostly of such lines are copies, for the next stage to thin out."""
    out = line_dedup.remove_lines(docs, min_sites=MIN_SITES, spare_share=(1, 2)).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; documents without an id
    stay."""
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item was found."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""
    return bpe.digest_documents(docs, RANKS, public_tokenizers.PATTERN)
