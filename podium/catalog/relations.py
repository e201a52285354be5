"""Evaluation inputs made from the given tables, as DataFrames and as SQL.

Customers are queries and parts are documents: what a customer ordered is judged by quantity.
A customer's vector is the embedding with its number, so customers beyond the embeddings are
judged queries without hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.catalog.registry import table
from podium.operators.knn import knn
from podium.operators.sampling import sample_queries
from podium.operators.triplets import scale_weights
from podium.operators.truth import build_qrels
from podium.session import materialize

HITS = 100
SAMPLE = 500


def customer_triplets(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("query_id"),
        F.col("l_partkey").cast("string").alias("doc_id"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
    )


def supplier_triplets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("query_id"),
        F.col("l_partkey").cast("string").alias("doc_id"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
    )


def doc_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")


def query_vectors(spark, sf_dir) -> DataFrame:
    return doc_vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id")


def customer_vectors(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("query_id"))
    return query_vectors(spark, sf_dir).join(customers, "query_id", "left_semi")


def every_customer_vector(spark, sf_dir) -> DataFrame:
    """A vector for each customer: that of the customer's number modulo the number of vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    number = vectors.agg(F.count(F.lit(1))).scalar()
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("query_id"), (F.col("c_custkey") % number).alias("_vec")
    )
    return customers.join(vectors, F.col("_vec") == F.col("vec_id")).select("query_id", "embedding")


def customer_qrels(spark, sf_dir) -> DataFrame:
    return build_qrels(scale_weights(customer_triplets(spark, sf_dir), "l_quantity"))


def sparse_qrels(spark, sf_dir) -> DataFrame:
    """The heaviest judgment of a sample of customers: many hits and queries stay unjudged."""
    scaled = scale_weights(customer_triplets(spark, sf_dir), "l_quantity")
    return build_qrels(scaled, sample_queries(scaled, SAMPLE), top_k=1)


def customer_run(spark, sf_dir, digits: int = 6) -> DataFrame:
    return knn(customer_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), HITS, score_digits=digits)


def stored_run_and_qrels(spark, sf_dir, digits: int = 6):
    """Written once: the metrics read both several times."""
    return materialize(customer_run(spark, sf_dir, digits), "run"), materialize(customer_qrels(spark, sf_dir), "judgments")


# The same relations in SQL.

TRIPLETS_SQL = """
triplets AS (
  SELECT cast(o_custkey AS varchar) AS query_id, cast(l_partkey AS varchar) AS doc_id,
         l_orderkey, l_linenumber, l_quantity, l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
scaled AS (
  SELECT t.*, cast(floor((l_quantity - lo) / (hi - lo) * 99 + 1) AS integer) AS weight
  FROM triplets t, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM triplets)
)"""


def qrels_sql(source: str = "scaled", weight: str = "weight", k: int = 1000, by: str = "") -> str:
    return f"""
judgments AS (
  SELECT {by} query_id, doc_id, {weight} AS weight,
         row_number() OVER (PARTITION BY {by} query_id ORDER BY {weight} DESC, doc_id) AS place
  FROM {source}
),
qrels AS (
  SELECT {by} query_id, doc_id, cast(min(round_even(weight, 0)) AS integer) AS rel
  FROM judgments WHERE place <= {k} GROUP BY ALL
)"""


def unit_sql(text: str, seed) -> str:
    """The hash of an id in (0, 1)."""
    return f"((('0x' || substr(md5({text} || '|{seed}'), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE)"


SPARSE_QRELS_SQL = f"""
drawn AS (
  SELECT query_id, ln({unit_sql("query_id", 1)}) / sum(weight) AS draw FROM scaled
  GROUP BY query_id ORDER BY draw DESC, query_id LIMIT {SAMPLE}
),
chosen AS (SELECT * FROM scaled SEMI JOIN drawn USING (query_id)),
{qrels_sql("chosen", k=1)}"""


SCORE_SQL = """list_dot_product(q.v, d.v) / greatest(
    sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v)), 1e-6)"""


KNOWN_CUSTOMERS_SQL = """
  SELECT cast(vec_id AS varchar) AS query_id, embedding::DOUBLE[] AS v
  FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer)"""
EVERY_CUSTOMER_SQL = """
  SELECT cast(c_custkey AS varchar) AS query_id, embedding::DOUBLE[] AS v
  FROM customer JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)"""


def run_sql(digits: int = 6, hits: int = HITS, queries: str = KNOWN_CUSTOMERS_SQL) -> str:
    return f"""
q AS ({queries}
),
d AS (SELECT cast(vec_id AS varchar) AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT query_id, doc_id, round({SCORE_SQL}, {digits}) AS score FROM q, d),
placed_pairs AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs
),
run AS (SELECT * FROM placed_pairs WHERE rank <= {hits})"""


INPUTS_SQL = f"{TRIPLETS_SQL}, {qrels_sql()}, {run_sql()}"
SPARSE_INPUTS_SQL = f"{TRIPLETS_SQL}, {SPARSE_QRELS_SQL}, {run_sql()}"


def metrics_sql(ks, by: tuple[str, ...] = (), ties: str = "reference") -> str:
    """Tables ``running``, ``per_query`` and ``metrics`` from ``run`` and ``qrels``."""
    keys = ", ".join([*by, "query_id"])
    group = "".join(f"{c}, " for c in by)
    stable, trec = "score DESC, rank", "score DESC, doc_id DESC"
    gain_order = stable if ties == "stable" else trec
    read_order = trec if ties == "trec" else stable
    same_doc = " AND ".join(f"j.{c} = r.{c}" for c in (*by, "doc_id"))
    unions = " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS metric, k, {value} AS value FROM at_k"
        for name, value in {
            "NDCG": "CASE WHEN NOT evaluated THEN NULL WHEN ideal > 0 THEN dcg / ideal ELSE 0 END",
            "MAP": "CASE WHEN NOT evaluated THEN NULL WHEN n_relevant > 0 THEN prec / n_relevant ELSE 0 END",
            "Recall": "CASE WHEN NOT evaluated THEN NULL WHEN n_relevant > 0 THEN found / n_relevant ELSE 0 END",
            "P": "CASE WHEN NOT evaluated THEN NULL ELSE found / k END",
            "MRR": "coalesce(1.0::DOUBLE / first_place, 0)",
            "Hole": "hole / k",
            "Accuracy": "CASE WHEN first_place IS NULL THEN 0.0 ELSE 1.0 END",
        }.items()
    )
    lists = " UNION ALL ".join(
        f"SELECT {keys}, '{name}', NULL, {value} FROM whole"
        for name, value in {"ERR": "err", "RBP7": "rbp7", "RBP8": "rbp8", "RBP9": "rbp9"}.items()
    )
    rbp = ", ".join(
        f"coalesce(sum(norm * 0.{p}::DOUBLE ** (place - 1)), 0) * (1 - 0.{p}::DOUBLE) AS rbp{p}" for p in (7, 8, 9)
    )
    return f"""
stats AS (
  SELECT {keys}, max(rel) AS max_rel, count(*) FILTER (rel > 0) AS n_relevant FROM qrels GROUP BY ALL
),
evaluated AS (SELECT DISTINCT {keys} FROM run),
hits AS (
  SELECT {", ".join(f"r.{c}" for c in (*by, "query_id", "doc_id", "score", "rank"))}, coalesce(q.rel, 0) AS rel,
         CASE WHEN j.doc_id IS NULL THEN 1.0::DOUBLE ELSE 0 END AS hole
  FROM run r
  LEFT JOIN qrels q USING ({keys}, doc_id)
  LEFT JOIN (SELECT DISTINCT {group} doc_id FROM qrels) j ON {same_doc}
  WHERE r.query_id <> r.doc_id
),
placed AS (
  SELECT h.*, max_rel, n_relevant,
         (2.0::DOUBLE ** rel - 1) / 2.0::DOUBLE ** max_rel AS stop,
         CASE WHEN max_rel > 0 THEN rel / max_rel::DOUBLE ELSE 0 END AS norm,
         row_number() OVER (PARTITION BY {keys} ORDER BY {read_order}) AS place,
         row_number() OVER (PARTITION BY {keys} ORDER BY {gain_order}) AS gain_place
  FROM hits h JOIN stats USING ({keys})
),
running AS (
  SELECT *,
         coalesce(product(1 - stop) OVER (PARTITION BY {keys} ORDER BY place
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS reach,
         cast(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY gain_place) AS BIGINT) AS hits_so_far
  FROM placed
),
ideal_order AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rel DESC) AS i FROM qrels),
ks AS (SELECT unnest({list(ks)}) AS k),
ideal_at AS (
  SELECT {keys}, k, sum(CASE WHEN i <= k THEN greatest(rel, 0) / log2(i + 1) ELSE 0 END) AS ideal
  FROM ideal_order, ks GROUP BY ALL
),
sums AS (
  SELECT {keys}, k,
         sum(CASE WHEN gain_place <= k THEN rel / log2(gain_place + 1) ELSE 0 END) AS dcg,
         sum(CASE WHEN gain_place <= k AND rel > 0 THEN 1.0::DOUBLE ELSE 0 END) AS found,
         sum(CASE WHEN gain_place <= k AND rel > 0 THEN hits_so_far / gain_place::DOUBLE ELSE 0 END) AS prec,
         sum(CASE WHEN place <= k THEN hole ELSE 0 END) AS hole,
         min(CASE WHEN place <= k AND rel > 0 THEN place END) AS first_place
  FROM running, ks GROUP BY ALL
),
at_k AS (
  SELECT {", ".join(f"s.{c}" for c in (*by, "query_id"))}, i.k, n_relevant, ideal, e.query_id IS NOT NULL AS evaluated,
         coalesce(dcg, 0) AS dcg, coalesce(found, 0) AS found, coalesce(prec, 0) AS prec, coalesce(hole, 0) AS hole, first_place
  FROM stats s JOIN ideal_at i USING ({keys}) LEFT JOIN sums USING ({keys}, k)
  LEFT JOIN evaluated e ON {" AND ".join(f"e.{c} = s.{c}" for c in (*by, "query_id"))}
),
whole AS (
  SELECT {", ".join(f"s.{c}" for c in (*by, "query_id"))}, coalesce(sum(reach * stop / place), 0) AS err, {rbp}
  FROM stats s LEFT JOIN running USING ({keys}) GROUP BY ALL
),
per_query AS ({unions} UNION ALL {lists}),
metrics AS (
  SELECT {group} CASE WHEN k IS NULL THEN 'm' || metric ELSE metric || '@' || k END AS name, metric, k,
         coalesce(avg(value), 0) AS value
  FROM per_query GROUP BY ALL
)"""
