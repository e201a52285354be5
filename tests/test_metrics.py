import math
import random

import pytest

from podium.config import CUTOFFS
from podium.operators.metrics import evaluate, per_query_metrics, rbp_name

QRELS = [("q1", "a", 3), ("q1", "b", 1), ("q1", "c", 0), ("q1", "d", 2), ("q2", "a", 1), ("q2", "e", 1), ("q3", "b", 2)]
RUN = [
    ("q1", "d", 0.9, 1), ("q1", "x", 0.8, 2), ("q1", "a", 0.7, 3), ("q1", "c", 0.6, 4),
    ("q2", "f", 0.5, 1), ("q2", "e", 0.4, 2), ("q2", "a", 0.3, 3),
]


def tables(spark, run, qrels):
    return (
        spark.createDataFrame(run, "query_id string, doc_id string, score double, rank int"),
        spark.createDataFrame(qrels, "query_id string, doc_id string, rel int"),
    )


def means(spark, run, qrels, ks=(1, 3, 5), **options):
    rows = evaluate(*tables(spark, run, qrels), list(ks), **options).collect()
    return {row["name"]: row["value"] for row in rows}, {row["name"]: row["reported"] for row in rows}


def test_golden_means(spark):
    values, reported = means(spark, RUN, QRELS)
    golden = {
        1: (0.33333, 0.16667, 0.16667, 0.50000, 0.33333, 0.33333, 0.33333),
        3: (0.71422, 0.56944, 0.83333, 0.66667, 0.50000, 0.22222, 0.66667),
        5: (0.71422, 0.56944, 0.83333, 0.40000, 0.50000, 0.13333, 0.66667),
    }
    for k, expected in golden.items():
        names = ("NDCG", "MAP", "Recall", "P", "MRR", "Hole", "Accuracy")
        assert tuple(reported[f"{name}@{k}"] for name in names) == expected
    exact = {"mERR": 0.296875, "mRBP7": 0.2346666666666667, "mRBP8": 0.1831111111111111, "mRBP9": 0.1062222222222222}
    for name, expected in exact.items():
        assert values[name] == pytest.approx(expected, abs=1e-12)


def test_golden_per_query(spark):
    rows = per_query_metrics(*tables(spark, RUN, QRELS), [3]).collect()
    values = {(row.query_id, row.metric): row.value for row in rows}
    golden = {
        "q1": {"NDCG": 0.735007, "MAP": 0.555556, "Recall": 0.666667, "P": 0.666667, "MRR": 1, "Hole": 0.333333, "Accuracy": 1},
        "q2": {"NDCG": 0.693426, "MAP": 0.583333, "Recall": 1, "P": 0.666667, "MRR": 0.5, "Hole": 0.333333, "Accuracy": 1},
    }
    for query, metrics in golden.items():
        for metric, expected in metrics.items():
            assert values[query, metric] == pytest.approx(expected, abs=1e-6)
    for query, expected in {"q1": 0.5572916666666666, "q2": 0.3333333333333333, "q3": 0}.items():
        assert values[query, "ERR"] == pytest.approx(expected, abs=1e-12)
    # A judged query without hits was not evaluated by the first family; the others count it as 0.
    assert values["q3", "NDCG"] is None and values["q3", "MRR"] == 0


def brute_force(run, qrels, k):
    """Plain definitions, query by query."""
    grades, hits = {}, {}
    for query, doc, rel in qrels:
        grades.setdefault(query, {})[doc] = rel
    for query, doc, score, rank in run:
        if query in grades:
            hits.setdefault(query, []).append((doc, score, rank))
    known = {doc for _, doc, _ in qrels}
    totals = dict.fromkeys(("NDCG", "MAP", "Recall", "P", "MRR", "Hole", "Accuracy", "ERR", "RBP8"), 0.0)
    for query, found in hits.items():
        grade, found = grades[query], [hit for hit in found if hit[0] != query]
        by_doc = sorted(sorted(found, key=lambda h: h[0], reverse=True), key=lambda h: -h[1])
        stored = sorted(found, key=lambda h: (-h[1], h[2]))
        relevant = sum(rel > 0 for rel in grade.values())
        gains = [grade.get(doc, 0) for doc, _, _ in by_doc]
        ideal = sorted(grade.values(), reverse=True)
        best = sum(rel / math.log2(i + 2) for i, rel in enumerate(ideal[:k]))
        if best:
            totals["NDCG"] += sum(rel / math.log2(i + 2) for i, rel in enumerate(gains[:k])) / best
        if relevant:
            right = [sum(g > 0 for g in gains[: i + 1]) / (i + 1) for i, g in enumerate(gains[:k]) if g > 0]
            totals["MAP"] += sum(right) / relevant
            totals["Recall"] += len(right) / relevant
        totals["P"] += sum(g > 0 for g in gains[:k]) / k
        read = [grade.get(doc, 0) for doc, _, _ in stored]
        first = next((i + 1 for i, g in enumerate(read[:k]) if g > 0), None)
        totals["MRR"] += 1 / first if first else 0
        totals["Accuracy"] += first is not None
        totals["Hole"] += sum(doc not in known for doc, _, _ in stored[:k]) / k
        top, reach = max(grade.values()), 1.0
        for i, g in enumerate(read):
            stop = (2**g - 1) / 2**top
            totals["ERR"] += reach * stop / (i + 1)
            reach *= 1 - stop
            totals["RBP8"] += 0.2 * (g / top if top else 0) * 0.8**i
    evaluated = len(hits)
    return {name: total / (evaluated if name in ("NDCG", "MAP", "Recall", "P") else len(grades)) for name, total in totals.items()}


@pytest.mark.parametrize("seed", range(3))
def test_random_lists_equal_brute_force(spark, seed):
    """Ties, zero grades, unjudged documents and queries, self hits and queries without hits."""
    rng = random.Random(seed)
    qrels = [
        (f"d{q}", f"d{d}", rng.choice([0, 0, 1, 2, 5, 9])) for q in range(12) for d in rng.sample(range(30), rng.randint(1, 14))
    ]
    run = []
    for q in range(3, 15):
        docs = rng.sample(range(40), rng.randint(1, 25))
        scores = sorted((rng.randint(0, 6) / 10 for _ in docs), reverse=True)
        run += [(f"d{q}", f"d{d}", s, i + 1) for i, (d, s) in enumerate(zip(docs, scores))]
    values, _ = means(spark, run, qrels, (1, 2, 5, 10, 30))
    for k in (1, 2, 5, 10, 30):
        for name, expected in brute_force(run, qrels, k).items():
            key = f"m{name}" if name in ("ERR", "RBP8") else f"{name}@{k}"
            assert values[key] == pytest.approx(expected, abs=1e-9), key


def test_ideal_run_is_perfect(spark):
    qrels = [("q", f"d{i}", 9 - i) for i in range(9)]
    run = [("q", f"d{i}", 1.0 - i / 10, i + 1) for i in range(9)]
    values, _ = means(spark, run, qrels, (1, 5, 9, 100))
    for name in ("NDCG@1", "NDCG@5", "NDCG@100", "MRR@1", "Recall@9"):
        assert values[name] == pytest.approx(1, abs=1e-12)
    assert all(0 <= value <= 1 + 1e-12 for value in values.values())


def test_order_of_ties(spark):
    qrels = [("q", "b", 1)]
    run = [("q", "a", 0.5, 1), ("q", "b", 0.5, 2)]
    stable, _ = means(spark, run, qrels, (1,), ties="stable")
    trec, _ = means(spark, run, qrels, (1,), ties="trec")
    both, _ = means(spark, run, qrels, (1,), ties="reference")
    assert (stable["P@1"], stable["MRR@1"]) == (0, 0)
    assert (trec["P@1"], trec["MRR@1"]) == (1, 1)
    assert (both["P@1"], both["MRR@1"]) == (1, 0)


def test_all_grades_zero(spark):
    values, _ = means(spark, [("q", "a", 1.0, 1)], [("q", "a", 0)], (1,))
    assert values["mRBP9"] == values["mERR"] == values["NDCG@1"] == values["MAP@1"] == 0


def test_self_hit_counts_as_evaluated(spark):
    values, _ = means(spark, [("q", "q", 1.0, 1)], [("q", "a", 1), ("r", "a", 1)], (1,))
    assert values["NDCG@1"] == 0 and values["Hole@1"] == 0


def test_no_queries(spark):
    values, _ = means(spark, [], [], (1,))
    assert values == {}


def test_grades_of_any_size(spark):
    """2^rel over 2^max, which floating point cannot hold one by one."""
    run, qrels = tables(spark, [("q", "a", 2.0, 1), ("q", "b", 1.0, 2)], [("q", "a", 5000), ("q", "b", 4999)])
    found = {r.name: r.value for r in evaluate(run, qrels, [1]).collect()}
    assert abs(found["mERR"] - (1 + 0 * 0.5)) < 1e-12


def test_repartitioning_changes_nothing(spark):
    run, qrels = tables(spark, RUN, QRELS)
    one = evaluate(run.repartition(1), qrels.repartition(7), [1, 3]).sort("name").collect()
    two = evaluate(run.repartition(6, "doc_id"), qrels.coalesce(1), [1, 3]).sort("name").collect()
    for a, b in zip(one, two):
        assert (a["name"], a["value"]) == (b["name"], pytest.approx(b["value"], abs=1e-12))


def test_groups_are_evaluated_apart(spark):
    run, qrels = tables(spark, RUN, QRELS)
    from pyspark.sql import functions as F

    split = lambda df: df.withColumn("part", F.when(F.col("query_id") == "q1", 1).otherwise(2))
    rows = evaluate(split(run), split(qrels), [1, 3], by=("part",)).collect()
    apart = {(row.part, row["name"]): row["value"] for row in rows}
    first, _ = means(spark, [r for r in RUN if r[0] == "q1"], [q for q in QRELS if q[0] == "q1"], (1, 3))
    for name, value in first.items():
        assert apart[1, name] == pytest.approx(value, abs=1e-12)


def test_cutoffs_follow_top_k(spark):
    rows = evaluate(*tables(spark, RUN, QRELS), list(CUTOFFS), top_k=5).collect()
    assert {row.k for row in rows} == {1, 2, 3, 4, 5, None}


def test_rbp_names():
    assert [rbp_name(p) for p in (0.7, 0.85, 0.9)] == ["RBP7", "RBP85", "RBP9"]
