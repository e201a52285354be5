"""Ground truth: graded judgments from weighted triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.text import as_id, round_relevance
from podium.operators.topk import top_per_group

#: Query ids of this number are broadcast.
BROADCAST_QUERIES = 100_000


def docs_for_queries(triplets: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All triplet rows of the given queries.

    The queries are counted when this is called, and broadcast up to ``BROADCAST_QUERIES``: triplets of
    a frequent query are then not brought together.
    """
    chosen = queries.select(*by, "query_id")
    if chosen.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        chosen = F.broadcast(chosen)
    return triplets.join(chosen, [*by, "query_id"], "left_semi")


def top_judgments(triplets: DataFrame, k: int = 1000, weight: str = "weight", by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` heaviest rows of each query. Repeated documents count as separate rows.

    Rows that tie on weight and document are equal in all that is kept, so the cut between
    them does not matter.
    """
    rows = triplets.select(*by, "query_id", as_id("doc_id").alias("doc_id"), weight)
    order = [F.desc(weight), F.asc("doc_id")]
    return top_per_group(rows, [*by, "query_id"], order, k, rank="place", spread_by="doc_id")


def build_qrels(
    triplets: DataFrame,
    queries: DataFrame | None = None,
    weight: str = "weight",
    top_k: int = 1000,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Judgments ``(query_id, doc_id, rel)``: cut to ``top_k`` rows, then one row per document.

    A document that is repeated within the cut keeps the last, lowest, of its weights.
    """
    rows = triplets if queries is None else docs_for_queries(triplets, queries, by)
    top = top_judgments(rows, top_k, weight, by)
    return top.groupBy(*by, "query_id", "doc_id").agg(F.min(round_relevance(weight)).alias("rel"))


def max_grade(qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return qrels.groupBy(*by, "query_id").agg(F.max("rel").alias("max_rel"))
