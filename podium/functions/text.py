"""Column expressions over ids, paths, text fields and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.config import KEY_SEPARATOR, FieldSpec


def as_id(column) -> Column:
    """Ids are compared as strings on both sides of every join."""
    return F.col(column).cast("string") if isinstance(column, str) else column.cast("string")


def composite_query_id(*columns: str, separator: str = KEY_SEPARATOR) -> Column:
    """Every column followed by the separator, the last one too; null if any part is null."""
    parts = []
    for name in columns:
        parts += [as_id(name), F.lit(separator)]
    return F.concat(*parts)


def basename_into(column, directory: str) -> Column:
    """The last part of a path, put below ``directory``."""
    return F.concat(F.lit(directory.rstrip("/") + "/"), F.element_at(F.split(column, "/"), -1))


def replace_prefix(column, old: str, new: str) -> Column:
    """Literal replacement of ``old`` wherever it occurs."""
    return F.replace(F.col(column) if isinstance(column, str) else column, F.lit(old), F.lit(new))


def role_prefix(column, role: str) -> Column:
    """``query: `` or ``passage: `` in front of a text, as asymmetric text encoders expect."""
    if role not in ("query", "passage"):
        raise ValueError(f"role must be 'query' or 'passage', not {role!r}")
    return F.concat(F.lit(f"{role}: "), F.col(column) if isinstance(column, str) else column)


def truncate_tokens(column, max_tokens: int) -> Column:
    """The first ``max_tokens`` whitespace tokens: the context length of an encoder."""
    tokens = F.split(F.regexp_replace(column, r"^\s+|\s+$", ""), r"\s+", max_tokens + 1)
    return F.array_join(F.slice(tokens, 1, max_tokens), " ")


def stringify(column) -> Column:
    """Text form of a value; a missing one becomes the literal ``nan``."""
    return F.coalesce(as_id(column), F.lit("nan"))


def is_missing(df: DataFrame, name: str) -> Column:
    """True for null, and for NaN in floating-point columns."""
    column = F.col(name)
    if df.schema[name].dataType.typeName() in ("double", "float"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def field_weights(df: DataFrame, fields: list[FieldSpec]) -> Column:
    """Per-row field weights: 0 for a missing field (never for the first), scaled to sum to 1.

    Null when every weight is 0.
    """
    weights = [F.lit(float(fields[0].weight))]
    for field in fields[1:]:
        weights.append(F.when(is_missing(df, field.name), 0.0).otherwise(float(field.weight)))
    total = weights[0]
    for weight in weights[1:]:
        total = total + weight
    return F.when(total > 0, F.array(*[w / total for w in weights]))


def project_fields(df: DataFrame, id_column: str, fields: list[FieldSpec]) -> DataFrame:
    """The id and the fields of one side, in the configured order."""
    return df.select(id_column, *[field.name for field in fields])


def round_relevance(column) -> Column:
    """Weight to integer grade, halves to the even neighbour."""
    return F.bround(column, 0).cast("int")


def unit_hash(column, seed: int = 1) -> Column:
    """A number in (0, 1) that depends on the id and the seed only, not on partitioning."""
    digest = F.md5(F.concat(as_id(column), F.lit(f"|{seed}")))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (number + 1) / F.lit(float(2**52 + 1))
