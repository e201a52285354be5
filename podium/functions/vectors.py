"""Column expressions over vectors (``array<float>`` or ``array<double>``), summed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def inner_product(left, right) -> Column:
    return _total(F.zip_with(_doubles(left), _doubles(right), lambda a, b: a * b))


def norm(column) -> Column:
    return F.sqrt(_total(F.transform(_doubles(column), lambda x: x * x)))


def cosine_similarity(left, right, eps: float = 1e-6) -> Column:
    return inner_product(left, right) / F.greatest(norm(left) * norm(right), F.lit(eps))


def l2_normalize(column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = norm(column)
    return F.transform(_doubles(column), lambda x: x / F.when(length > 0, length).otherwise(1.0))


def renormalize(weights) -> Column:
    """Weights divided by their sum; null when the sum is 0."""
    total = _total(_doubles(weights))
    return F.when(total > 0, F.transform(_doubles(weights), lambda w: w / total))


def scaled(column, factor: Column) -> Column:
    return F.transform(_doubles(column), lambda x: x * factor)


def weighted_sum(columns: list[str], weights) -> Column:
    """Sum of weight times vector over the fields; a null vector must have weight 0."""
    weights = _doubles(weights)
    total = None
    for position, name in enumerate(columns, start=1):
        part = scaled(name, F.element_at(weights, position))
        if total is None:
            total = part
        else:
            summed = F.zip_with(total, part, lambda a, b: a + b)
            total = F.when(F.col(name).isNull(), total).otherwise(summed)
    return total


def fuse_fields(columns: list[str], weights) -> Column:
    return l2_normalize(weighted_sum(columns, weights))


def cls_pool(tokens) -> Column:
    """The first token's vector."""
    return F.element_at(tokens, 1)


def mean_pool(tokens, mask) -> Column:
    """Mean of the token vectors whose mask is 1; null when no token counts."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    mask = F.col(mask) if isinstance(mask, str) else mask
    pairs = F.filter(F.arrays_zip(tokens.alias("vector"), mask.alias("used")), lambda t: t["used"] == 1)
    kept = F.transform(pairs, lambda t: t["vector"].cast("array<double>"))
    zero = F.transform(F.element_at(kept, 1), lambda x: F.lit(0.0))
    summed = F.aggregate(kept, zero, lambda total, v: F.zip_with(total, v, lambda a, b: a + b))
    count = F.size(kept)
    return F.when(count > 0, F.transform(summed, lambda x: x / count))


def mean_pool_long(tokens: DataFrame, key: str, vector: str, mask: str, out: str = "embedding") -> DataFrame:
    """Masked mean over a table with one row per token.

    Sums are combined per (key, position) before the shuffle, so a key with very many tokens
    costs one partial row per task and position.
    """
    parts = (
        tokens.where(F.col(mask) == 1)
        .select(key, F.posexplode(_doubles(vector)).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(F.avg("x").alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda p: p["x"]).alias(out))
