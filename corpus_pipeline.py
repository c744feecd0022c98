"""From raw documents to training tokens: five stages, each written as Parquet and read again by the next.

All stages carry further columns along, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stormsift.llm import stages
from stormsift.llm.common import table
from stormsift.sources.io import kept as written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; without labels of both classes all stay. Null and empty texts stay."""
    return stages.without_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, row by row. Null and empty texts fail and go."""
    return stages.of_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, of rows that repeat its doc_id one; rows without doc_id all stay."""
    return stages.without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, parts as rows of their own; texts without words go."""
    return stages.mixed(docs)


def sentence_piece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the piece ids of their texts; null and empty texts have none."""
    return stages.encoded(docs)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mixing", mixing), ("sentence_piece", sentence_piece)]

#: SQL can express neither the classifier nor the encoder; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
