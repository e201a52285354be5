"""Registry of queries ``(spark, sf_dir) -> DataFrame`` and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL it is compared with."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column, digits: int = 6) -> Column:
    """Rounded, with -0.0 written as 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def numbers(df: DataFrame, id_column: str, vector: str = "embedding") -> DataFrame:
    """One row per number of a vector, for comparison."""
    return df.select(id_column, F.posexplode(vector).alias("pos", "x")).select(
        id_column, "pos", rounded(F.col("x").cast("double")).alias("x")
    )
