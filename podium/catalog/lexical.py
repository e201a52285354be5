"""The lexical baseline: benchmark texts are the queries, documents the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.evaluation import ALL_MEANS_SQL, KS, means
from podium.catalog.registry import query, rounded, table
from podium.catalog.relations import metrics_sql
from podium.operators import lexical
from podium.operators.metrics import evaluate
from podium.session import materialize

HITS = 100

WEIGHTS_SQL = r"""
tokens AS (
  SELECT doc_id::VARCHAR AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents
),
counts AS (SELECT doc_id, term, count(*) AS n FROM tokens GROUP BY ALL),
weights AS (
  SELECT doc_id, term, ln(1 + (total - docs + 0.5::DOUBLE) / (docs + 0.5::DOUBLE))
      * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) AS impact
  FROM (
    SELECT *, count(*) OVER (PARTITION BY term) AS docs, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS length,
           sum(n) OVER ()::DOUBLE / total AS mean
    FROM counts, (SELECT count(*)::DOUBLE AS total FROM documents)
  )
)"""
RUN_SQL = rf"""
asked AS (
  SELECT query_id, term, count(*) AS n
  FROM (SELECT item_id::VARCHAR AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark)
  GROUP BY ALL
),
scored AS (SELECT query_id, doc_id, round(sum(n * impact), 6) AS score FROM asked JOIN weights USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored),
run AS (SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= {HITS})"""
JUDGED_SQL = """
qrels AS (
  SELECT (doc_id % (SELECT count(*) FROM benchmark))::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, (1 + quality)::INTEGER AS rel
  FROM labels WHERE quality IS NOT NULL
)"""


def _index(spark, sf_dir):
    return lexical.build_index(table(spark, sf_dir, "documents"))


def _search(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.search(_index(spark, sf_dir), items, HITS, score_digits=6)


@query(
    f"WITH {WEIGHTS_SQL} SELECT term, count(*) AS n_docs, round(max(impact), 6) AS largest, round(sum(impact), 4) AS total FROM weights GROUP BY term"
)
def bm25_terms(spark, sf_dir):
    """Per term of the index: the documents that hold it, the largest impact and the sum of all."""
    held = F.explode("postings").alias("p")
    each = _index(spark, sf_dir).table("blocks").select("term", held)
    return each.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_docs"),
        rounded(F.max("p.impact")).alias("largest"),
        rounded(F.sum("p.impact"), 4).alias("total"),
    )


@query(f"WITH {WEIGHTS_SQL}, {RUN_SQL} SELECT * FROM run")
def bm25_topk(spark, sf_dir):
    return _search(spark, sf_dir).run


@query(f"WITH {WEIGHTS_SQL}, {RUN_SQL}, {JUDGED_SQL}, {metrics_sql(KS)} {ALL_MEANS_SQL}")
def bm25_evaluate(spark, sf_dir):
    """The metrics of the lexical run; labelled documents are judged for one of the items."""
    items = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1))).scalar()
    judged = table(spark, sf_dir, "labels").where("quality is not null")
    qrels = judged.select(
        (F.col("doc_id") % items).cast("string").alias("query_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        (1 + F.col("quality")).cast("int").alias("rel"),
    )
    return means(evaluate(materialize(_search(spark, sf_dir).run, "run"), materialize(qrels, "judgments"), KS))
