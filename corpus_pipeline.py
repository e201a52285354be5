"""Preparation of a training corpus, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from podium.llm import stages
from podium.llm.common import table
from podium.session import new_folder

#: Each stage takes (spark, docs, sf_dir) and gives the documents that the next one works on.
STAGES = stages.STAGES

#: The stages train models, so SQL cannot express their result; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
