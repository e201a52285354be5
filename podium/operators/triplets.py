"""Triplet preparation: query ids, graded weights and checks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.config import FieldSpec, TripletConfig
from podium.functions.text import as_id, composite_query_id
from podium.operators.topk import first_per_group


def add_query_id(df: DataFrame, left_keys: list[str] | None = None, query_id_key: str | None = None) -> DataFrame:
    """``query_id`` from a given column, or made of the left columns."""
    if query_id_key is not None:
        return df.withColumn("query_id", as_id(query_id_key))
    return df.withColumn("query_id", composite_query_id(*left_keys))


def _weight_stats(value):
    return [
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.count(F.lit(1)).alias("_rows"),
        F.count(value).alias("_known"),
    ]


def scale_weights(
    df: DataFrame, weight_key: str | None = None, out: str = "weight", by: tuple[str, ...] = (), lo: int = 1, hi: int = 100
) -> DataFrame:
    """Integer grades ``lo..hi`` from a weight column, linear between its global extremes.

    Without a weight column, or when all its values are equal, every grade is 1. A weight column
    with some values missing is an error, as is a named column that does not exist. ``by``
    scales each group on its own (one row of extremes per group); rows whose group is null are a group.
    """
    if weight_key is None:
        return df.withColumn(out, F.lit(1))
    if weight_key not in df.columns:
        raise ValueError(f"weight column {weight_key!r} is not among {df.columns}")
    value = F.nanvl(F.col(weight_key).cast("double"), F.lit(None).cast("double"))
    if by:
        extremes = df.groupBy(*by).agg(*_weight_stats(value)).withColumnsRenamed({c: f"_by_{c}" for c in by})
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        ranged = df.join(extremes, same).drop(*[f"_by_{c}" for c in by])
        low, high, rows, known = (F.col(c) for c in ("_lo", "_hi", "_rows", "_known"))
    else:
        extremes = df.agg(F.struct(*_weight_stats(value)).alias("stats")).scalar()
        ranged = df.withColumn("_stats", extremes)
        low, high, rows, known = (F.col(f"_stats.{c}") for c in ("_lo", "_hi", "_rows", "_known"))
    scaled = F.floor((value - low) / (high - low) * (hi - lo) + lo).cast("int")
    grade = (
        F.when((known == 0) | ((known == rows) & (low == high)), 1)
        .when(known < rows, F.raise_error(F.lit(f"column {weight_key} has missing weights")).cast("int"))
        .otherwise(scaled)
    )
    return ranged.withColumn(out, grade).drop("_stats", "_lo", "_hi", "_rows", "_known")


def check_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Fails while running if a weight is missing or below 1."""
    bad = F.col(weight).isNull() | (F.col(weight) < 1)
    message = F.concat(F.lit("weight below 1: "), F.coalesce(F.col(weight).cast("string"), F.lit("null")))
    return df.withColumn(weight, F.when(bad, F.raise_error(message).cast("int")).otherwise(F.col(weight)))


def prepare_triplets(df: DataFrame, config: TripletConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Triplets with ``query_id``, ``doc_id`` and an integer ``weight``, other columns kept."""
    keyed = add_query_id(df, [field.name for field in config.left], config.query_id_key)
    keyed = keyed.withColumn("doc_id", as_id(config.doc_id_key))
    return check_weights(scale_weights(keyed, config.weight_key, by=by))


def query_weight(df: DataFrame, weight: str = "weight", by: tuple[str, ...] = ()) -> DataFrame:
    """Total weight per query; rows without a query id are left out."""
    known = df.where(F.col("query_id").isNotNull())
    return known.groupBy(*by, "query_id").agg(F.sum(weight).alias("query_weight"))


def distinct_count(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Number of distinct values, a missing value counting as one."""
    counted = F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
    return df.agg(counted.alias(out))


def first_per_query(df: DataFrame, order_by: list, spread_by: str | None = None) -> DataFrame:
    """One row per query: the first by ``order_by``."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    return first_per_group(df, ["query_id"], order, spread_by=spread_by)


def attach_query_fields(queries: DataFrame, first_rows: DataFrame, fields: list[str | FieldSpec]) -> DataFrame:
    """Field values of each query; a query without a row is an error."""
    names = [f.name if isinstance(f, FieldSpec) else f for f in fields]
    right = first_rows.select("query_id", *names, F.lit(True).alias("_found"))
    joined = queries.join(right, "query_id", "left")
    missing = F.raise_error(F.concat(F.lit("no row for query "), F.col("query_id"))).cast("string")
    checked = F.when(F.col("_found"), F.col("query_id")).otherwise(missing)
    return joined.withColumn("query_id", checked).drop("_found")
