"""Triplet preparation, sampling, judgments, splits and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import query, rounded, table
from podium.catalog.relations import TRIPLETS_SQL, customer_triplets, qrels_sql, supplier_triplets, unit_sql
from podium.config import TripletConfig, FieldSpec
from podium.functions import text
from podium.operators import sampling, splits, triplets, truth

SUPPLIERS_SQL = """
triplets AS (
  SELECT cast(l_suppkey AS varchar) AS query_id, cast(l_partkey AS varchar) AS doc_id, l_orderkey, l_linenumber, l_quantity
  FROM lineitem
),
scaled AS (
  SELECT t.*, cast(floor((l_quantity - lo) / (hi - lo) * 99 + 1) AS integer) AS weight
  FROM triplets t, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM triplets)
)"""
WEIGHTS_SQL = "weights AS (SELECT query_id, cast(sum(weight) AS bigint) AS query_weight FROM scaled GROUP BY ALL)"


def _scaled(spark, sf_dir):
    return triplets.scale_weights(supplier_triplets(spark, sf_dir), "l_quantity")


def _scaled_customers(spark, sf_dir):
    return triplets.scale_weights(customer_triplets(spark, sf_dir), "l_quantity")


@query("SELECT p_partkey, p_brand || '_{!@#~}_' || p_type || '_{!@#~}_' AS query_id FROM part")
def composite_query_id(spark, sf_dir):
    return triplets.add_query_id(table(spark, sf_dir, "part"), ["p_brand", "p_type"]).select("p_partkey", "query_id")


@query(
    """SELECT p_partkey, cast(floor((p_retailprice - lo) / (hi - lo) * 99 + 1) AS integer) AS weight
       FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)"""
)
def minmax_weight(spark, sf_dir):
    return triplets.scale_weights(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", "weight")


@query("SELECT p_partkey, 1 AS weight FROM part")
def unit_weight(spark, sf_dir):
    """A weight column with a single value gives every triplet the weight 1."""
    parts = table(spark, sf_dir, "part").withColumn("score", F.lit(7.5))
    return triplets.scale_weights(parts, "score").select("p_partkey", "weight")


@query(
    """SELECT p_brand || '_{!@#~}_' || p_type || '_{!@#~}_' AS query_id, cast(p_partkey AS varchar) AS doc_id,
              cast(floor((p_retailprice - lo) / (hi - lo) * 99 + 1) AS integer) AS weight
       FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)"""
)
def prepare_triplets(spark, sf_dir):
    roles = TripletConfig(
        left=(FieldSpec("p_brand"), FieldSpec("p_type")),
        right=(FieldSpec("p_name"),),
        weight_key="p_retailprice",
        doc_id_key="p_partkey",
    )
    return triplets.prepare_triplets(table(spark, sf_dir, "part"), roles).select("query_id", "doc_id", "weight")


@query(f"WITH {SUPPLIERS_SQL}, {WEIGHTS_SQL} SELECT query_id, query_weight FROM weights")
def query_weight(spark, sf_dir):
    return triplets.query_weight(_scaled(spark, sf_dir))


@query(
    """SELECT count(DISTINCT nullif(p_type, 'ECONOMY')) + max(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS n FROM part"""
)
def distinct_queries(spark, sf_dir):
    """A missing value counts as one more."""
    parts = table(spark, sf_dir, "part").withColumn("p_type", F.nullif(F.col("p_type"), F.lit("ECONOMY")))
    return triplets.distinct_count(parts, "p_type")


FIRST_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
FIRST_SQL = f"""
SELECT cast(l_suppkey AS varchar) AS query_id, l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(FIRST_ORDER)}) AS n FROM lineitem
) WHERE n = 1"""


def _first_lines(spark, sf_dir):
    lines = triplets.add_query_id(table(spark, sf_dir, "lineitem"), query_id_key="l_suppkey")
    first = triplets.first_per_query(lines, FIRST_ORDER, spread_by="l_orderkey")
    return first.select("query_id", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(FIRST_SQL)
def first_per_query(spark, sf_dir):
    return _first_lines(spark, sf_dir)


@query(
    f"""WITH {SUPPLIERS_SQL}, {WEIGHTS_SQL}, first AS ({FIRST_SQL})
        SELECT query_id, query_weight, l_partkey, l_quantity FROM weights JOIN first USING (query_id)"""
)
def attach_query_fields(spark, sf_dir):
    weights = triplets.query_weight(_scaled(spark, sf_dir))
    return triplets.attach_query_fields(weights, _first_lines(spark, sf_dir), ["l_partkey", "l_quantity"])


CUSTOMER_WEIGHTS = f"WITH {TRIPLETS_SQL}, {WEIGHTS_SQL}"
RANKED = "row_number() OVER (ORDER BY query_weight DESC, query_id) AS query_rank"


@query(
    f"""{CUSTOMER_WEIGHTS}, drawn AS (
          SELECT *, ln({unit_sql("query_id", 1)}) / query_weight AS draw FROM weights ORDER BY draw DESC, query_id LIMIT 500)
        SELECT query_id, query_weight, {RANKED} FROM drawn"""
)
def sample_weighted(spark, sf_dir):
    return sampling.sample_queries(_scaled_customers(spark, sf_dir), 500, "weighted")


@query(
    f"""{CUSTOMER_WEIGHTS}, drawn AS (
          SELECT *, {unit_sql("query_id", 1)} AS draw FROM weights ORDER BY draw, query_id LIMIT 100)
        SELECT query_id, query_weight, {RANKED} FROM drawn"""
)
def sample_uniform(spark, sf_dir):
    return sampling.sample_queries(_scaled_customers(spark, sf_dir), 100, "uniform")


@query(f"WITH {SUPPLIERS_SQL}, {WEIGHTS_SQL} SELECT query_id, query_weight, {RANKED} FROM weights")
def sample_all(spark, sf_dir):
    return sampling.sample_queries(_scaled(spark, sf_dir), -1)


@query(
    f"""{CUSTOMER_WEIGHTS}, drawn AS (
          SELECT *, ln({unit_sql("query_id", 1)}) / query_weight AS draw FROM weights ORDER BY draw DESC, query_id LIMIT 500)
        SELECT query_id, doc_id, l_orderkey, l_linenumber, weight FROM scaled SEMI JOIN drawn USING (query_id)"""
)
def docs_for_query(spark, sf_dir):
    scaled = _scaled_customers(spark, sf_dir)
    rows = truth.docs_for_queries(scaled, sampling.sample_queries(scaled, 500))
    return rows.select("query_id", "doc_id", "l_orderkey", "l_linenumber", "weight")


@query(f"WITH {SUPPLIERS_SQL}, {qrels_sql()} SELECT query_id, doc_id, weight, place FROM judgments WHERE place <= 10")
def topk_judgments(spark, sf_dir):
    return truth.top_judgments(_scaled(spark, sf_dir), 10)


@query(f"WITH {TRIPLETS_SQL}, {qrels_sql()} SELECT query_id, doc_id, rel FROM qrels")
def build_qrels(spark, sf_dir):
    return truth.build_qrels(_scaled_customers(spark, sf_dir))


@query("SELECT page_id, '/images/' || regexp_extract(url, '[^/]*$') AS url FROM pages")
def repath_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.basename_into("url", "/images/").alias("url"))


@query("SELECT page_id, replace(url, 'http://', 's3://pages/') AS url FROM pages")
def replace_prefix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.replace_prefix("url", "http://", "s3://pages/").alias("url"))


@query("SELECT doc_id, md5('passage: ' || text) AS digest FROM documents")
def role_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.role_prefix("text", "passage")).alias("digest"))


@query(
    r"""SELECT doc_id, md5(array_to_string(
          string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:77], ' ')) AS digest FROM documents"""
)
def truncate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate_tokens("text", 77)).alias("digest"))


@query("SELECT doc_id, coalesce(cast(toxic AS varchar), 'nan') AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def stringify_field(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", text.stringify("toxic").alias("toxic"))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def project_fields(spark, sf_dir):
    return text.project_fields(table(spark, sf_dir, "part"), "p_partkey", [FieldSpec("p_name"), FieldSpec("p_brand")])


SPLIT_SQL = f"""split AS (
  SELECT *, CASE WHEN {unit_sql("query_id", "1q")} <= 0.8 THEN 0 ELSE 1 END AS q_split,
         CASE WHEN {unit_sql("doc_id", "1d")} <= 0.5 THEN 0 ELSE 1 END AS d_split,
         CASE WHEN {unit_sql("query_id", "1t")} <= 0.5 THEN 'dev' ELSE 'test' END AS part
  FROM scaled
)"""


@query(f"WITH {SUPPLIERS_SQL}, {SPLIT_SQL} SELECT query_id, doc_id, l_orderkey, l_linenumber, q_split, d_split FROM split")
def split_two_way(spark, sf_dir):
    split = splits.split_two_way(supplier_triplets(spark, sf_dir))
    return split.select("query_id", "doc_id", "l_orderkey", "l_linenumber", "q_split", "d_split")


@query(
    f"""WITH {TRIPLETS_SQL}, {SPLIT_SQL}, {qrels_sql("split", by="q_split, d_split, part,")}
        SELECT q_split, d_split, part, query_id, doc_id, rel FROM qrels"""
)
def dev_test_split(spark, sf_dir):
    split = splits.dev_test_split(splits.split_two_way(_scaled_customers(spark, sf_dir)))
    return truth.build_qrels(split, by=("q_split", "d_split", "part"))


@query(
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
              cast(count(*) OVER (PARTITION BY user_id)
                - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS double) AS score_linear
       FROM events"""
)
def score_linear(spark, sf_dir):
    scored = splits.score_linear(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return scored.select("event_id", "user_id", "position", "score_linear")


@query(
    f"""WITH {TRIPLETS_SQL}, shares AS (SELECT *, l_quantity / max(l_quantity) OVER () AS x FROM triplets)
        SELECT l_orderkey, l_linenumber, doc_id, round(x, 6) + 0.0 AS linear, round(log2(1 + x), 6) + 0.0 AS log,
               round(1 / (2 - x), 6) + 0.0 AS inverse FROM shares"""
)
def training_weights(spark, sf_dir):
    rows = customer_triplets(spark, sf_dir)
    for form in ("linear", "log", "inverse"):
        rows = splits.training_weights(rows, "l_quantity", form, form)
    return rows.select("l_orderkey", "l_linenumber", "doc_id", *[rounded(f).alias(f) for f in ("linear", "log", "inverse")])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
       WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')"""
)
def category_subset(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_partkey"))
    parts = table(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey"))
    kept, _ = splits.category_subset(lines, parts, F.col("p_type") == "ECONOMY")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
