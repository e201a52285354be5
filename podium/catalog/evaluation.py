"""Search, judging, metrics and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import query, rounded, table
from podium.catalog.relations import (
    HITS,
    EVERY_CUSTOMER_SQL,
    INPUTS_SQL,
    SPARSE_INPUTS_SQL,
    TRIPLETS_SQL,
    customer_qrels,
    customer_run,
    customer_triplets,
    customer_vectors,
    doc_vectors,
    every_customer_vector,
    metrics_sql,
    qrels_sql,
    query_vectors,
    run_sql,
    sparse_qrels,
    stored_run_and_qrels,
    supplier_triplets,
    unit_sql,
)
from podium.config import CUTOFFS, EvalConfig, FieldSpec, TripletConfig
from podium.functions.text import round_relevance
from podium.operators import judge
from podium.operators.knn import knn
from podium.operators.metrics import evaluate, judged_hits, per_query_metrics
from podium.operators.splits import split_two_way
from podium.operators.truth import build_qrels, max_grade
from podium.plans import report
from podium.plans.evaluation import evaluate_splits as evaluate_all_splits
from podium.plans.evaluation import evaluate_vectors
from podium.session import materialize

KS = [k for k in CUTOFFS if k <= HITS]

KNN_SQL = """
WITH q AS (SELECT cast(vec_id AS varchar) AS query_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT cast(vec_id AS varchar) AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT query_id, doc_id, round({score}, 6) + 0.0 AS score FROM q, d),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs)
SELECT query_id, doc_id, score, rank FROM placed WHERE rank <= 10
"""
COSINE_SQL = KNN_SQL.format(
    score="list_dot_product(q.v, d.v) / greatest(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v)), 1e-6)"
)
INNER_SQL = KNN_SQL.format(score="list_dot_product(q.v, d.v)")


def _all_by_all(spark, sf_dir, similarity="cosine", **options):
    return knn(query_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), 10, similarity, score_digits=6, **options)


@query(COSINE_SQL)
def knn_cosine_topk(spark, sf_dir):
    return _all_by_all(spark, sf_dir)


@query(INNER_SQL)
def knn_ip_topk(spark, sf_dir):
    return _all_by_all(spark, sf_dir, "ip")


@query(COSINE_SQL)
def knn_block_topk(spark, sf_dir):
    """Both sides in shuffled blocks, as for a query side that is too large to broadcast."""
    return _all_by_all(spark, sf_dir, broadcast_bytes=0)


@query(COSINE_SQL)
def knn_passes_topk(spark, sf_dir):
    """Queries in parts, a pass over the documents for each, as for more queries than can be broadcast at once."""
    n = table(spark, sf_dir, "embeddings").count()
    return _all_by_all(spark, sf_dir, broadcast_bytes=n * 64 * 8 // 3)


@query(COSINE_SQL)
def knn_floor_topk(spark, sf_dir):
    """With the lower bounds that a large search takes from a share of the documents."""
    return _all_by_all(spark, sf_dir, merge_rows=0, floor_share=0.2)


UNROUNDED_SQL = INNER_SQL.replace("round(list_dot_product(q.v, d.v), 6) + 0.0", "list_dot_product(q.v, d.v)").replace(
    "doc_id, score, rank", "doc_id, rank"
)


@query(UNROUNDED_SQL)
def knn_unrounded_floor(spark, sf_dir):
    """Scores in full, with lower bounds: nothing may be lost to rounding."""
    found = knn(query_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), 10, "ip", merge_rows=0, floor_share=0.5)
    return found.select("query_id", "doc_id", "rank")


def _with(inputs: str, select: str) -> str:
    return f"WITH {inputs} {select}"


@query(_with(run_sql(), "SELECT query_id, doc_id, score, rank FROM run WHERE query_id <> doc_id"))
def drop_identical(spark, sf_dir):
    return judge.drop_identical(customer_run(spark, sf_dir))


@query(
    _with(
        INPUTS_SQL,
        "SELECT r.query_id, r.doc_id, score, rank, coalesce(rel, 0) AS rel FROM run r LEFT JOIN qrels USING (query_id, doc_id)",
    )
)
def judge_run(spark, sf_dir):
    return judge.judge_run(customer_run(spark, sf_dir), customer_qrels(spark, sf_dir))


@query(
    _with(
        INPUTS_SQL,
        "SELECT query_id, doc_id, score, rank FROM run SEMI JOIN (SELECT * FROM qrels WHERE rel > 0) USING (query_id, doc_id)",
    )
)
def relevant_hits(spark, sf_dir):
    return judge.relevant_hits(customer_run(spark, sf_dir), customer_qrels(spark, sf_dir))


@query(_with(SPARSE_INPUTS_SQL, "SELECT query_id, doc_id, score, rank FROM run ANTI JOIN qrels USING (doc_id)"))
def unjudged_hits(spark, sf_dir):
    return judge.unjudged_hits(customer_run(spark, sf_dir), materialize(sparse_qrels(spark, sf_dir), "judgments"))


@query(_with(SPARSE_INPUTS_SQL, "SELECT DISTINCT query_id FROM run ANTI JOIN qrels USING (query_id)"))
def unjudged_queries(spark, sf_dir):
    return judge.unjudged_queries(customer_run(spark, sf_dir), materialize(sparse_qrels(spark, sf_dir), "judgments"))


@query(
    _with(
        run_sql(),
        "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM run",
    )
)
def rank_hits(spark, sf_dir):
    return judge.rank_hits(customer_run(spark, sf_dir)).select("query_id", "doc_id", "place")


@query(
    _with(
        f"{INPUTS_SQL}, {metrics_sql(KS)}",
        """SELECT query_id, doc_id, rel, place, gain_place, hits_so_far, round(reach, 6) + 0.0 AS reach FROM running""",
    )
)
def hits_per_query(spark, sf_dir):
    """The running terms of every hit: places, relevant hits so far, chance to read this far."""
    hits = judged_hits(*stored_run_and_qrels(spark, sf_dir)).where(~F.col("_self"))
    return hits.select("query_id", "doc_id", "rel", "place", "gain_place", "hits_so_far", rounded("reach").alias("reach"))


@query(_with(f"{TRIPLETS_SQL}, {qrels_sql()}", "SELECT query_id, max(rel) AS max_rel FROM qrels GROUP BY ALL"))
def max_grade_per_query(spark, sf_dir):
    return max_grade(customer_qrels(spark, sf_dir))


def _per_query(spark, sf_dir, metric):
    rows = per_query_metrics(*stored_run_and_qrels(spark, sf_dir), KS).where(F.col("metric") == metric)
    return rows.select("query_id", rounded("value").alias("value"))


def _mean(spark, sf_dir, metric):
    means = evaluate(*stored_run_and_qrels(spark, sf_dir), KS).where(F.col("metric") == metric)
    return means.select("k", rounded("value").alias("value"))


METRICS_SQL = f"{INPUTS_SQL}, {metrics_sql(KS)}"


def _mean_sql(metric: str) -> str:
    return _with(METRICS_SQL, f"SELECT k, round(value, 6) + 0.0 AS value FROM metrics WHERE metric = '{metric}'")


@query(_mean_sql("NDCG"))
def ndcg_at_k(spark, sf_dir):
    return _mean(spark, sf_dir, "NDCG")


@query(_mean_sql("MAP"))
def map_at_k(spark, sf_dir):
    return _mean(spark, sf_dir, "MAP")


@query(_mean_sql("Recall"))
def recall_at_k(spark, sf_dir):
    return _mean(spark, sf_dir, "Recall")


@query(_mean_sql("P"))
def precision_at_k(spark, sf_dir):
    return _mean(spark, sf_dir, "P")


@query(_mean_sql("MRR"))
def mrr_at_k(spark, sf_dir):
    return _mean(spark, sf_dir, "MRR")


SPARSE_METRICS_SQL = f"{SPARSE_INPUTS_SQL}, {metrics_sql(KS)}"


def _sparse_inputs(spark, sf_dir):
    return materialize(customer_run(spark, sf_dir), "run"), materialize(sparse_qrels(spark, sf_dir), "judgments")


@query(_with(SPARSE_METRICS_SQL, "SELECT k, round(value, 6) + 0.0 AS value FROM metrics WHERE metric = 'Hole'"))
def hole_at_k(spark, sf_dir):
    means = evaluate(*_sparse_inputs(spark, sf_dir), KS).where("metric = 'Hole'")
    return means.select("k", rounded("value").alias("value"))


@query(_mean_sql("Accuracy"))
def accuracy_at_k(spark, sf_dir):
    return _mean(spark, sf_dir, "Accuracy")


@query(_with(METRICS_SQL, "SELECT query_id, round(value, 6) + 0.0 AS value FROM per_query WHERE metric = 'ERR'"))
def err_per_query(spark, sf_dir):
    return _per_query(spark, sf_dir, "ERR")


@query(_with(METRICS_SQL, "SELECT query_id, round(value, 6) + 0.0 AS value FROM per_query WHERE metric = 'RBP9'"))
def rbp_per_query(spark, sf_dir):
    return _per_query(spark, sf_dir, "RBP9")


@query(_with(METRICS_SQL, "SELECT name, round(value, 6) + 0.0 AS value FROM metrics WHERE name = 'mERR'"))
def mean_err(spark, sf_dir):
    means = evaluate(*stored_run_and_qrels(spark, sf_dir), KS).where("name = 'mERR'")
    return means.select("name", rounded("value").alias("value"))


@query(_with(METRICS_SQL, "SELECT name, round(value, 6) + 0.0 AS value FROM metrics WHERE name LIKE 'mRBP%'"))
def mean_rbp(spark, sf_dir):
    means = evaluate(*stored_run_and_qrels(spark, sf_dir), KS).where("name LIKE 'mRBP%'")
    return means.select("name", rounded("value").alias("value"))


@query(_with(METRICS_SQL, "SELECT query_id, metric, k, round(value, 6) + 0.0 AS value FROM per_query"))
def metrics_per_query(spark, sf_dir):
    rows = per_query_metrics(*stored_run_and_qrels(spark, sf_dir), KS)
    return rows.select("query_id", "metric", "k", rounded("value").alias("value"))


ALL_MEANS_SQL = "SELECT name, metric, k, round(value, 6) + 0.0 AS value FROM metrics"


def means(metrics):
    return metrics.select("name", F.regexp_replace("metric", "^m", "").alias("metric"), "k", rounded("value").alias("value"))


@query(_with(METRICS_SQL, ALL_MEANS_SQL))
def evaluate_all(spark, sf_dir):
    return means(evaluate(*stored_run_and_qrels(spark, sf_dir), KS))


DEEP = 1000


@query(_with(f"{TRIPLETS_SQL}, {qrels_sql()}, {run_sql(hits=DEEP)}, {metrics_sql(CUTOFFS)}", ALL_MEANS_SQL))
def evaluate_full_depth(spark, sf_dir):
    """A thousand hits per query, at every cutoff."""
    hits = knn(customer_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), DEEP, score_digits=6)
    return means(evaluate(materialize(hits, "run"), materialize(customer_qrels(spark, sf_dir), "judgments"), list(CUTOFFS)))


VECTORS_CONFIG = EvalConfig(top_q=-1, sampling="all", top_k=HITS, score_digits=6)


@query(
    _with(f"{TRIPLETS_SQL}, {qrels_sql(k=HITS)}, {run_sql(queries=EVERY_CUSTOMER_SQL)}, {metrics_sql(KS)}", ALL_MEANS_SQL)
)
def evaluate_from_vectors(spark, sf_dir):
    """Triplets and stored vectors of all customers and documents, to metrics."""
    roles = TripletConfig(
        left=(FieldSpec("query_id"),), right=(FieldSpec("doc_id"),), weight_key="l_quantity", doc_id_key="doc_id", query_id_key="query_id"
    )
    triplets, vectors = customer_triplets(spark, sf_dir), every_customer_vector(spark, sf_dir)
    return means(evaluate_vectors(triplets, vectors, doc_vectors(spark, sf_dir), roles, VECTORS_CONFIG).metrics)


@query(_with(SPARSE_METRICS_SQL, ALL_MEANS_SQL))
def evaluate_sample(spark, sf_dir):
    """One judgment for each of a sample of queries: queries with hits alone are left out."""
    return means(evaluate(*_sparse_inputs(spark, sf_dir), KS))


TIED_INPUTS = f"{TRIPLETS_SQL}, {qrels_sql()}, {run_sql(1)}"


@query(_with(f"{TIED_INPUTS}, {metrics_sql(KS)}", ALL_MEANS_SQL))
def ties_reference(spark, sf_dir):
    """Scores with one digit tie often: by document id for one family, by stored rank for the other."""
    return means(evaluate(*stored_run_and_qrels(spark, sf_dir, 1), KS, ties="reference"))


@query(_with(f"{TIED_INPUTS}, {metrics_sql(KS, ties='stable')}", ALL_MEANS_SQL))
def ties_stable(spark, sf_dir):
    return means(evaluate(*stored_run_and_qrels(spark, sf_dir, 1), KS, ties="stable"))


@query(_with(f"{TIED_INPUTS}, {metrics_sql(KS, ties='trec')}", ALL_MEANS_SQL))
def ties_trec(spark, sf_dir):
    return means(evaluate(*stored_run_and_qrels(spark, sf_dir, 1), KS, ties="trec"))


ZERO_GRADES = f"{TRIPLETS_SQL}, {qrels_sql('triplets', 'round_even(l_discount * 100, 0)')}, {run_sql()}, {metrics_sql(KS)}"


@query(_with(ZERO_GRADES, ALL_MEANS_SQL))
def evaluate_zero_grades(spark, sf_dir):
    """Imported weights from 0 to 10: grades of 0, and queries with no relevant document."""
    weighted = customer_triplets(spark, sf_dir).withColumn("weight", F.bround(F.col("l_discount") * 100, 0))
    qrels = materialize(build_qrels(weighted), "judgments")
    return means(evaluate(materialize(customer_run(spark, sf_dir), "run"), qrels, KS))


SUMMARY_COLUMNS = report.summary_names(HITS)


def _summary_sql(columns: dict[str, str]) -> str:
    picked = ", ".join(f"round(max(value) FILTER (name = '{name}'), 6) + 0.0 AS \"{column}\"" for column, name in columns.items())
    return _with(METRICS_SQL, f"SELECT {picked} FROM metrics")


def _summary(spark, sf_dir, wide=False):
    row = report.summary(evaluate(*stored_run_and_qrels(spark, sf_dir), KS), HITS, wide=wide, value="value")
    return row.select(*[rounded(c).alias(c) for c in row.columns])


@query(_summary_sql(report.summary_names(HITS)))
def metric_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(_summary_sql(report.summary_names(HITS, wide=True)))
def metric_summary_wide(spark, sf_dir):
    return _summary(spark, sf_dir, wide=True)


WANTED = ("MAP@100", "P@10", "Recall@10", "MRR@100", "NDCG@10", "mERR")
DEPTHS = (10, 50, 100)


def _depth_inputs() -> str:
    named = {"run_all": run_sql().replace("\nrun AS", "\nrun_all AS"), "qrels_all": qrels_sql().replace("\nqrels AS", "\nqrels_all AS")}
    depths = f"depths AS (SELECT 'top' || depth AS experiment, depth FROM (SELECT unnest({list(DEPTHS)}) AS depth))"
    return f"""{TRIPLETS_SQL}, {named["qrels_all"]}, {named["run_all"]}, {depths},
run AS (SELECT experiment, run_all.* FROM run_all, depths WHERE rank <= depth),
qrels AS (SELECT experiment, qrels_all.* FROM qrels_all, depths),
{metrics_sql(KS, ("experiment",))}"""


def _experiments(spark, sf_dir):
    """The run read to three depths, evaluated together."""
    run, qrels = stored_run_and_qrels(spark, sf_dir)
    depth = F.explode(F.array(*[F.lit(d) for d in DEPTHS])).alias("depth")
    name = F.concat(F.lit("top"), "depth")
    runs = run.select("*", depth).where("rank <= depth").withColumn("experiment", name).drop("depth")
    judgments = qrels.select("*", depth).withColumn("experiment", name).drop("depth")
    return evaluate(runs, judgments, KS, by=("experiment",))


def _rounded_board(board):
    return board.select("experiment", *[rounded(c).alias(c) for c in board.columns if c != "experiment"])


BOARD_COLUMNS_SQL = ", ".join(f"max(value) FILTER (name = '{n}') AS \"{n}\"" for n in WANTED)
BOARD_SQL = f"{_depth_inputs()}, board AS (SELECT experiment, {BOARD_COLUMNS_SQL} FROM metrics GROUP BY ALL)"


@query(_with(BOARD_SQL, "SELECT experiment, " + ", ".join(f'round("{n}", 6) + 0.0 AS "{n}"' for n in WANTED) + " FROM board"))
def leaderboard(spark, sf_dir):
    return _rounded_board(report.leaderboard(_experiments(spark, sf_dir), WANTED))


@query(
    _with(
        BOARD_SQL,
        "SELECT b.experiment, "
        + ", ".join(f'round((b."{n}" - a."{n}") / a."{n}", 6) + 0.0 AS "{n}"' for n in WANTED)
        + " FROM board b, board a WHERE a.experiment = 'top10'",
    )
)
def relative_gain(spark, sf_dir):
    board = materialize(report.leaderboard(_experiments(spark, sf_dir), WANTED), "board")
    return _rounded_board(report.relative_gain(board, "top10"))


@query(
    _with(
        _depth_inputs(),
        """SELECT experiment, name, round(value, 6) + 0.0 AS value FROM metrics
           UNION ALL SELECT experiment, 'mAP@100', round(value, 6) + 0.0 FROM metrics WHERE name = 'MAP@100'
           UNION ALL SELECT experiment, 'mrr@100', round(value, 6) + 0.0 FROM metrics WHERE name = 'MRR@100'""",
    )
)
def merge_metrics(spark, sf_dir):
    metrics = materialize(_experiments(spark, sf_dir), "metrics")
    wide = report.summary(metrics, HITS, by=("experiment",), value="value")
    long = wide.unpivot("experiment", [c for c in wide.columns if c != "experiment"], "name", "value")
    merged = report.merge_metrics(metrics, long)
    return merged.select("experiment", "name", rounded("value").alias("value"))


@query(
    _with(
        _depth_inputs(),
        f"SELECT experiment, name, round(value, 6) + 0.0 AS value FROM metrics WHERE name IN {WANTED}",
    )
)
def select_metrics(spark, sf_dir):
    chosen = report.select_metrics(_experiments(spark, sf_dir), WANTED)
    return chosen.select("experiment", "name", rounded("value").alias("value"))


SPLIT_CONFIG = EvalConfig(top_q=-1, sampling="all", top_k=HITS, score_digits=6)

SPLITS_SQL = f"""WITH lines AS (
  SELECT cast(l_suppkey AS varchar) AS query_id, cast(l_partkey AS varchar) AS doc_id, l_quantity
  FROM lineitem WHERE l_suppkey IN (SELECT vec_id FROM embeddings)
),
triplets AS (
  SELECT *, CASE WHEN {unit_sql("query_id", "1q")} <= 0.8 THEN 0 ELSE 1 END AS q_split,
         CASE WHEN {unit_sql("doc_id", "1d")} <= 0.5 THEN 0 ELSE 1 END AS d_split
  FROM lines
),
extremes AS (SELECT q_split, d_split, min(l_quantity) AS lo, max(l_quantity) AS hi FROM triplets GROUP BY ALL),
scaled AS (
  SELECT t.*, cast(floor((l_quantity - lo) / (hi - lo) * 99 + 1) AS integer) AS weight
  FROM triplets t JOIN extremes USING (q_split, d_split)
),
{qrels_sql(k=HITS, by="q_split, d_split,")},
vectors AS (
  SELECT cast(vec_id AS varchar) AS id, embedding::DOUBLE[] AS v,
         CASE WHEN {unit_sql("cast(vec_id AS varchar)", "1d")} <= 0.5 THEN 0 ELSE 1 END AS d_split
  FROM embeddings
),
queries AS (SELECT DISTINCT q_split, d_split, query_id FROM qrels),
pairs AS (
  SELECT s.q_split, s.d_split, s.query_id, d.id AS doc_id, round(list_dot_product(q.v, d.v) / greatest(
    sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v)), 1e-6), 6) AS score
  FROM queries s JOIN vectors q ON q.id = s.query_id JOIN vectors d ON d.d_split = s.d_split
),
placed_pairs AS (
  SELECT *, row_number() OVER (PARTITION BY q_split, d_split, query_id ORDER BY score DESC, doc_id) AS rank FROM pairs
),
run AS (SELECT * FROM placed_pairs WHERE rank <= {HITS}),
{metrics_sql(KS, ("q_split", "d_split"))}
SELECT q_split, d_split, name, round(value, 6) + 0.0 AS value FROM metrics"""


@query(SPLITS_SQL)
def evaluate_splits(spark, sf_dir):
    vectors = query_vectors(spark, sf_dir)
    known = supplier_triplets(spark, sf_dir).join(vectors, "query_id", "left_semi")
    metrics = evaluate_all_splits(split_two_way(known), vectors, doc_vectors(spark, sf_dir), SPLIT_CONFIG, "l_quantity")
    return metrics.select("q_split", "d_split", "name", rounded("value").alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, cast(round_even(l_quantity / 2, 0) AS integer) AS rel FROM lineitem")
def round_relevance_half_even(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", round_relevance(F.col("l_quantity") / 2).alias("rel"))
