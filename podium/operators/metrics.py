"""Rank metrics for all cutoffs in one pass over the judged hits.

Hits meet the judgments by (query, document) and the judged documents by document; then they are dealt out and sorted
by query once, and a scan over Arrow batches adds up every metric's terms for all cutoffs (``ranked_sums``), one row per query. The
judgments enter through joins that are all aggregated or keyed by (query, document) first, so a query with very many judgments
is no single group anywhere.
"""

from __future__ import annotations

from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.config import CUTOFFS, RBP_PERSISTENCE
from podium.operators.judge import judge_run, judged_docs
from podium.operators.ranked_sums import AT_CUTOFF, list_sums, whole_lists
from podium.session import ship_package

EVALUATED_METRICS = ("NDCG", "MAP", "Recall", "P")
CUTOFF_METRICS = (*EVALUATED_METRICS, "MRR", "Hole", "Accuracy")


def rbp_name(p: float) -> str:
    return "RBP" + f"{p:g}".replace("0.", "", 1)


def checked_grades(qrels: DataFrame) -> DataFrame:
    """Grades as integers."""
    return qrels.withColumn("rel", F.col("rel").cast("int"))


def query_stats(qrels: DataFrame, ks: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Per judged query: highest grade, number of relevant documents and ideal gain per cutoff.

    Built from the number of documents per grade, so judgments are counted before they are
    brought together.
    """
    keys = [*by, "query_id"]
    per_grade = qrels.groupBy(*keys, "rel").agg(F.count(F.lit(1)).alias("n"))
    discounts = [0.0]
    for rank in range(1, max(ks) + 1):
        discounts.append(discounts[-1] + 1 / log2(rank + 1))
    to_rank = F.split(F.lit(",".join(map(repr, discounts))), ",").cast("array<double>")
    best_first = Window.partitionBy(*keys).orderBy(F.desc("rel"))
    upto = best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gain = f"greatest(rel, 0) * (to_rank[int(least(place, {max(ks)}))] - to_rank[int(least(place - n, {max(ks)}))])"
    # In the best order a grade fills the places place - n + 1 to place. It settles the cutoffs
    # that end there; the lowest grade settles all that are left.
    settled = (
        per_grade.withColumn("place", F.sum("n").over(upto))
        .withColumn("next_start", F.when(F.lead("n").over(best_first).isNotNull(), F.col("place") + 1))
        .withColumn("to_rank", to_rank)
        .withColumn("gain", F.expr(gain))
        .drop("to_rank")  # a constant: not to be carried through the next window's sort
        .withColumn("gain_before", F.sum("gain").over(upto) - F.col("gain"))
        .withColumn("to_rank", to_rank)
        .withColumn("first_cutoff", _interval("place - n + 1", ks))
        .withColumn("end_cutoff", F.coalesce(F.when(F.col("next_start").isNotNull(), _interval("next_start", ks)), F.lit(len(ks))))
        .withColumn(
            "ideals",
            F.expr(
                f"""transform(slice(array({", ".join(map(str, ks))}), first_cutoff + 1, end_cutoff - first_cutoff),
                    k -> struct(k, gain_before + greatest(rel, 0)
                      * (to_rank[int(least(place, k))] - to_rank[int(place - n)]) AS ideal))"""
            ),
        )
    )
    settled = settled.drop("to_rank")
    ideals = F.array_sort(F.flatten(F.collect_list("ideals")))
    return settled.groupBy(*keys).agg(
        F.max("rel").alias("max_rel"),
        F.sum(F.when(F.col("rel") > 0, F.col("n")).otherwise(0)).alias("n_relevant"),
        F.transform(ideals, lambda at: at["ideal"]).alias("ideal"),
    )


def _checked(ties: str) -> str:
    if ties not in ("reference", "stable", "trec"):
        raise ValueError(f"ties must be one of {['reference', 'stable', 'trec']}")
    return ties


def _orders(ties: str) -> tuple[list[Column], list[Column]]:
    """Orders of the (NDCG, MAP, Recall, P) family and of the others, self hits left aside."""
    stored, by_doc = [F.desc("score"), F.asc("rank")], [F.desc("score"), F.desc("doc_id")]
    return {"reference": (by_doc, stored), "stable": (stored, stored), "trec": (by_doc, by_doc)}[_checked(ties)]


def _places(ties: str, keys: list[str]) -> tuple[Window, Window]:
    """The same as windows, in which self hits come last."""
    gain, read = (Window.partitionBy(*keys).orderBy("_self", *order) for order in _orders(ties))
    return gain, (gain if ties != "reference" else read)


def judged_hits(run: DataFrame, qrels: DataFrame, ties: str = "reference", by: tuple[str, ...] = ()) -> DataFrame:
    """Hits of judged queries with grade, both places, and the running terms of every metric."""
    keys = [*by, "query_id"]
    stats = qrels.groupBy(*keys).agg(F.max("rel").alias("max_rel"))
    return _running(_graded(run, qrels, by), stats, ties, keys)


def _graded(run: DataFrame, qrels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    hits = run.select(*by, "query_id", "doc_id", F.col("score").cast("double").alias("score"), "rank")
    graded = judge_run(hits.withColumn("_self", F.col("query_id").eqNullSafe(F.col("doc_id"))), qrels, by)
    known = judged_docs(qrels, by).withColumn("_known", F.lit(True))
    return (
        graded.join(known, [*by, "doc_id"], "left")
        .withColumn("rel", F.when(F.col("_self"), 0).otherwise(F.col("rel")))
        .withColumn("hole", (F.col("_known").isNull() & ~F.col("_self")).cast("int"))
        .drop("_known")
    )


def _running(graded: DataFrame, stats: DataFrame, ties: str, keys: list[str]) -> DataFrame:
    gain_order, read_order = _places(ties, keys)
    before = read_order.rowsBetween(Window.unboundedPreceding, -1)
    upto = gain_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    relevant = (F.col("rel") > 0).cast("int")
    hits = (
        graded.join(stats, keys)
        .withColumn("relevant", relevant)
        # (2^rel - 1) / 2^max, in a form that no grade overflows
        .withColumn("stop", F.pow(F.lit(2.0), F.col("rel") - F.col("max_rel")) - F.pow(F.lit(2.0), -F.col("max_rel")))
        .withColumn("place", F.row_number().over(read_order))
        .withColumn("reach", F.coalesce(F.product(1 - F.col("stop")).over(before), F.lit(1.0)))
    )
    if gain_order is read_order:
        hits = hits.withColumn("gain_place", F.col("place"))
    else:
        hits = hits.withColumn("gain_place", F.row_number().over(gain_order))
    return hits.withColumn("hits_so_far", F.sum("relevant").over(upto))


def _interval(place: str, ks: list[int]) -> Column:
    """Index of the first cutoff that takes in this place; past the last cutoff one more."""
    cases = " ".join(f"WHEN {place} <= {k} THEN {i}" for i, k in enumerate(ks))
    return F.expr(f"CASE {cases} ELSE {len(ks)} END")


def _results(ks: list[int], whole: dict[str, str]) -> Column:
    """One struct per cutoff, from the sums of a list at that cutoff, and one for the whole list.

    The latter has no ``k``. A struct leaves the metrics of the other kind null.
    """
    at_k = {
        "NDCG": "if(ideal[i] > 0, dcg[i] / ideal[i], 0D)",
        "MAP": "if(n_relevant > 0, precision[i] / n_relevant, 0D)",
        "Recall": "if(n_relevant > 0, found[i] / n_relevant, 0D)",
        "P": "found[i] / k",
        "MRR": "coalesce(if(first <= k, 1 / first, 0D), 0D)",
        "Hole": "coalesce(hole[i] / k, 0D)",
        "Accuracy": "coalesce(double(first <= k), 0D)",
    }
    at_k = {n: f"if(evaluated, {v}, double(null))" if n in EVALUATED_METRICS else v for n, v in at_k.items()}

    def struct(k, values):
        fields = [f"'{name}', {values.get(name, 'double(null)')}" for name in (*at_k, *whole)]
        return f"named_struct('k', {k}, {', '.join(fields)})"

    cutoffs = f"transform(array({', '.join(map(str, ks))}), (k, i) -> {struct('k', at_k)})"
    return F.expr(f"concat({cutoffs}, array({struct('int(null)', whole)}))")


def _summed(hits: DataFrame, stats: DataFrame, keys: list[str], ks: list[int], ps, ties: str) -> DataFrame:
    """Per list its sums at every cutoff: hits are dealt out and sorted by list once, then scanned."""
    _, read_order = _orders(ties)
    ship_package(hits.sparkSession)
    hits = hits.repartition(*keys).join(stats, keys)
    columns = [*keys, "_self", "score", "doc_id", "rel", "hole", "max_rel"]
    ordered = hits.sortWithinPartitions(*keys, "_self", *read_order).select(*columns)
    by_document = ties == "reference"  # the reading order is by stored rank

    def scan(batches):
        for table in whole_lists(batches, keys):
            yield pa.RecordBatch.from_pydict(list_sums(table, keys, ks, list(ps), by_document))

    kinds = [f"`{k}` {ordered.schema[k].dataType.simpleString()}" for k in keys]
    kinds += [f"{name} array<double>" for name in AT_CUTOFF] + ["first double", "err double"]
    return ordered.mapInArrow(scan, ", ".join([*kinds, *(f"rbp{i} double" for i in range(len(ps)))]))


def _wide_metrics(run: DataFrame, qrels: DataFrame, ks, ps, ties: str, by: tuple[str, ...]) -> DataFrame:
    """``(*by, query_id, k, <one column per metric>)``: a row per cutoff and one for the whole list."""
    ks = sorted(ks or CUTOFFS)
    keys = [*by, "query_id"]
    qrels = checked_grades(qrels)
    stats = query_stats(qrels, ks, by)
    sums = _summed(_graded(run, qrels, by), stats.select(*keys, "max_rel"), keys, ks, ps, ties)
    lists = {"ERR": "coalesce(err, 0D)"} | {rbp_name(p): f"coalesce(rbp{i} * {1 - p!r}D, 0D)" for i, p in enumerate(ps)}
    return (
        stats.join(sums, keys, "left")
        .withColumn("evaluated", F.col("dcg").isNotNull())
        .select(*keys, F.explode(_results(ks, lists)).alias("result"))
        .select(*keys, "result.*")
    )


def _by_metric(wide: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, metric, k, value)`` without the metrics that do not belong to the row's kind."""
    metrics = [c for c in wide.columns if c not in (*keys, "k")]
    of_list = F.col("metric").isin(*[m for m in metrics if m not in CUTOFF_METRICS])
    long = wide.unpivot([*keys, "k"], metrics, "metric", "value")
    return long.where(F.col("k").isNull() == of_list).select(*keys, "metric", "k", "value")


def per_query_metrics(
    run: DataFrame,
    qrels: DataFrame,
    ks: list[int] | None = None,
    ps: tuple[float, ...] = RBP_PERSISTENCE,
    ties: str = "reference",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``(*by, query_id, metric, k, value)`` for every judged query.

    ``k`` is null for ERR and RBP, which read the whole list. NDCG, MAP, Recall and P are
    null for a judged query without hits; the other metrics are 0 for it. ``ties`` says how equal
    scores are ordered: ``stable`` by stored rank, ``trec`` by document id descending,
    ``reference`` the latter for NDCG, MAP, Recall and P and the former for the rest.
    """
    wide = _wide_metrics(run, qrels, ks or CUTOFFS, ps, ties, by)
    return _by_metric(wide, [*by, "query_id"])


def evaluate(
    run: DataFrame,
    qrels: DataFrame,
    ks: list[int] | None = None,
    top_k: int | None = None,
    ps: tuple[float, ...] = RBP_PERSISTENCE,
    ties: str = "reference",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Mean metrics of a run against judgments, at every cutoff up to ``top_k``.

    Both tables are read several times: pass stored tables, not long plans.
    """
    cutoffs = [k for k in (ks or CUTOFFS) if top_k is None or k <= top_k]
    wide = _wide_metrics(run, qrels, cutoffs, ps, ties, by)
    # avg leaves nulls out: a judged query that was not evaluated does not count in NDCG, MAP,
    # Recall and P, and as 0 in the rest.
    metrics = [c for c in wide.columns if c not in (*by, "query_id", "k")]
    averages = wide.groupBy(*by, "k").agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])
    means = _by_metric(averages, list(by))
    whole = F.col("k").isNull()
    named = F.when(whole, F.concat(F.lit("m"), "metric")).otherwise(F.concat("metric", F.lit("@"), "k"))
    # Cutoff metrics are reported with 5 decimals, list metrics in full. The last digits of a sum
    # depend on its order; they are cut first so that a report does not.
    reported = F.when(whole, F.col("value")).otherwise(F.bround(F.round("value", 12), 5))
    return means.select(*by, named.alias("name"), "metric", "k", "value", reported.alias("reported"))
