"""Dataset splits by query and document, position scores and training weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.text import unit_hash
from podium.operators.topk import position_in_group


def split_two_way(
    df: DataFrame, query: str = "query_id", doc: str = "doc_id", query_share: float = 0.8, doc_share: float = 0.5, seed: int = 1
) -> DataFrame:
    """``q_split`` and ``d_split``, 0 for the in-domain part and 1 for the novel part."""
    return df.withColumn("q_split", side_of(query, query_share, f"{seed}q")).withColumn(
        "d_split", side_of(doc, doc_share, f"{seed}d")
    )


def side_of(column: str, share: float, seed) -> Column:
    return F.when(unit_hash(column, seed) <= share, 0).otherwise(1)


def dev_test_split(df: DataFrame, query: str = "query_id", dev_share: float = 0.5, seed: int = 1) -> DataFrame:
    """``part`` is ``dev`` or ``test``; all rows of a query get the same one."""
    u = unit_hash(query, f"{seed}t")
    return df.withColumn("part", F.when(u <= dev_share, "dev").otherwise("test"))


def score_linear(df: DataFrame, query: str, order_by: list[str], out: str = "score_linear") -> DataFrame:
    """A score that falls by one per list position and ends at 1."""
    numbered = position_in_group(df, query, order_by, position="position", count="_n")
    return numbered.withColumn(out, (F.col("_n") - F.col("position") + 1).cast("double")).drop("_n")


def category_subset(triplets: DataFrame, corpus: DataFrame, condition: Column, doc: str = "doc_id"):
    """The documents that meet a condition and the triplets that point at them."""
    kept = corpus.where(condition)
    return triplets.join(kept.select(doc), doc, "left_semi"), kept


def training_weights(df: DataFrame, score: str, form: str = "linear", out: str = "train_weight") -> DataFrame:
    """Pair weight from a rank score: ``linear`` keeps it, ``log`` and ``inverse`` reshape it.

    With ``x`` the score over the largest score: ``linear`` x, ``log`` log2(1 + x), ``inverse``
    1 / (2 - x).
    """
    largest = df.agg(F.max(F.col(score).cast("double"))).scalar()
    x = F.try_divide(F.col(score).cast("double"), F.col("_largest"))
    forms = {"linear": x, "log": F.log2(x + 1), "inverse": 1 / (2 - x)}
    if form not in forms:
        raise ValueError(f"form must be one of {sorted(forms)}")
    return df.withColumn("_largest", largest).withColumn(out, forms[form]).drop("_largest")
