"""Joins between ranked lists and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_identical(run: DataFrame) -> DataFrame:
    """Hits whose document is the query itself do not count in any metric."""
    return run.where(~F.col("query_id").eqNullSafe(F.col("doc_id")))


def judge_run(run: DataFrame, qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every hit with its grade, 0 when unjudged."""
    grades = qrels.select(*by, "query_id", "doc_id", "rel")
    return run.join(grades, [*by, "query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def relevant_hits(run: DataFrame, qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return run.join(qrels.where("rel > 0"), [*by, "query_id", "doc_id"], "left_semi")


def judged_docs(qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return qrels.select(*by, "doc_id").distinct()


def unjudged_hits(run: DataFrame, qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits whose document is judged for no query at all."""
    return run.join(judged_docs(qrels, by), [*by, "doc_id"], "left_anti")


def unjudged_queries(run: DataFrame, qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Queries with hits but without judgments: no metric covers them."""
    keys = [*by, "query_id"]
    return run.select(*keys).distinct().join(qrels.select(*keys), keys, "left_anti")


def rank_hits(run: DataFrame, by: tuple[str, ...] = (), out: str = "place") -> DataFrame:
    """Place by score, equal scores in stored order."""
    order = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "rank")
    return run.withColumn(out, F.row_number().over(order))
