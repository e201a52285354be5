"""Sources and sinks: each query writes a given table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.evaluation import KS, METRICS_SQL, SUMMARY_COLUMNS
from podium.catalog.registry import numbers, query, rounded, table
from podium.catalog.relations import (
    HITS,
    INPUTS_SQL,
    TRIPLETS_SQL,
    customer_qrels,
    customer_run,
    doc_vectors,
    qrels_sql,
    run_sql,
    stored_run_and_qrels,
    supplier_triplets,
    unit_sql,
)
from podium.config import EvalConfig
from podium.functions.text import basename_into
from podium.operators.metrics import evaluate
from podium.operators.splits import side_of, split_two_way
from podium.plans import report
from podium.plans.evaluation import metric_only as evaluate_stored
from podium.session import materialize, new_folder
from podium.sources import csv_tree, keyed_json, stages, tables

PART_FIELDS = "p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
PART_SQL = "SELECT cast(p_partkey AS varchar) AS doc_id, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def _part_corpus(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").cast("string").alias("doc_id"), *[c for c in parts.columns if c != "p_partkey"])


def _corpus_file(spark, sf_dir):
    path = new_folder(spark, "corpus")
    keyed_json.write_corpus_json(_part_corpus(spark, sf_dir), path)
    return path


@query(PART_SQL)
def keyed_json_roundtrip(spark, sf_dir):
    return keyed_json.read_keyed_corpus(spark, _corpus_file(spark, sf_dir), PART_FIELDS)


@query(PART_SQL)
def keyed_json_splittable(spark, sf_dir):
    return keyed_json.read_keyed_corpus(spark, _corpus_file(spark, sf_dir), PART_FIELDS, splittable=True)


@query(f"WITH {run_sql()} SELECT query_id, doc_id, score, rank FROM run")
def run_json_roundtrip(spark, sf_dir):
    path = new_folder(spark, "run-json")
    keyed_json.write_run_json(customer_run(spark, sf_dir), path)
    return keyed_json.read_run_json(spark, path, splittable=True)


@query(f"WITH {TRIPLETS_SQL}, {qrels_sql()} SELECT query_id, doc_id, rel FROM qrels")
def qrels_json_roundtrip(spark, sf_dir):
    path = new_folder(spark, "qrels-json")
    keyed_json.write_qrels_json(customer_qrels(spark, sf_dir), path)
    return keyed_json.read_qrels_json(spark, path, splittable=True)


@query(
    """SELECT cast(vec_id AS varchar) AS doc_id, unnest(range(len(embedding))) AS pos,
              round(unnest(embedding)::DOUBLE, 6) + 0.0 AS x FROM embeddings"""
)
def vectors_roundtrip(spark, sf_dir):
    path = new_folder(spark, "vectors")
    tables.write_vectors(doc_vectors(spark, sf_dir), path, "doc_id")
    return numbers(tables.read_vectors(spark, path, 64), "doc_id")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def read_columnar(spark, sf_dir):
    return tables.read_columnar(spark, f"{sf_dir}/part.parquet", unique="p_partkey")


@query(
    """SELECT cast(c_custkey AS varchar) AS product_id, c_name AS title, nullif(c_mktsegment, 'MACHINERY') AS segment,
              c_acctbal AS score FROM customer"""
)
def triplets_roundtrip(spark, sf_dir):
    """A CSV in which a missing segment is spelled ``NA``."""
    path = new_folder(spark, "triplets")
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", "NA").otherwise(F.col("c_mktsegment"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("product_id"), F.col("c_name").alias("title"), segment.alias("segment"), F.col("c_acctbal").alias("score")
    )
    customers.write.option("header", True).csv(path)
    return tables.read_triplets(spark, path, "product_id string, score double")


@query("SELECT cast(doc_id AS varchar) AS product_id, nullif(text, '') AS title, lang FROM documents")
def triplets_line_breaks(spark, sf_dir):
    """A CSV whose texts hold quotes, separators and line breaks, read in many tasks."""
    path = new_folder(spark, "triplets")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), F.col("text").alias("title"), "lang")
    documents.write.options(header=True, escape='"', quoteAll=True).csv(path)
    return tables.read_triplets(spark, path)


@query("SELECT cast(doc_id AS varchar) AS doc_id, text, lang, n_chars FROM documents")
def keyed_json_nested(spark, sf_dir):
    """A corpus of nested values, with texts of any characters."""
    path = new_folder(spark, "corpus")
    about = F.struct("lang", F.array("n_chars").alias("sizes")).alias("about")
    keyed_json.write_corpus_json(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", about), path)
    read = keyed_json.read_keyed_corpus(spark, path, "text string, about struct<lang:string,sizes:array<bigint>>")
    return read.select("doc_id", "text", "about.lang", F.col("about.sizes")[0].alias("n_chars"))


REPATHED_SQL = "SELECT cast(page_id AS varchar) AS page_id, '/images/' || regexp_extract(url, '[^/]*$') AS image_local, md5(html) AS digest FROM pages"


@query(REPATHED_SQL)
def csv_tree_rewrite(spark, sf_dir):
    """A folder with pages and, in another layout, nations; only pages have the column."""
    root, new_root = new_folder(spark, "tree"), new_folder(spark, "tree-new")
    pages = table(spark, sf_dir, "pages").withColumnRenamed("url", "image_local")
    pages.write.options(header=True, escape='"', quoteAll=True).csv(f"{root}/a/pages")
    table(spark, sf_dir, "nation").write.option("header", True).csv(f"{root}/b/nations")
    csv_tree.rewrite_csv_tree(spark, root, new_root, "/images/")
    moved = tables.read_csv_text(spark, new_root)
    return moved.select("page_id", "image_local", F.md5("html").alias("digest"))


@query("SELECT 2 AS total_files, 1 AS updated_files")
def csv_tree_counts(spark, sf_dir):
    root, new_root = new_folder(spark, "tree"), new_folder(spark, "tree-new")
    pages = table(spark, sf_dir, "pages").withColumnRenamed("url", "image_local")
    pages.coalesce(1).write.options(header=True, escape='"', quoteAll=True).csv(f"{root}/a")
    table(spark, sf_dir, "nation").coalesce(1).write.option("header", True).csv(f"{root}/b")
    return csv_tree.rewrite_csv_tree(spark, root, new_root, "/images/")


@query("SELECT cast(page_id AS varchar) AS doc_id, '/images/' || regexp_extract(url, '[^/]*$') AS image_local, md5(html) AS digest FROM pages")
def corpus_rewrite(spark, sf_dir):
    path, new_path = new_folder(spark, "corpus"), new_folder(spark, "corpus-new")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("image_local"), "html")
    keyed_json.write_corpus_json(pages, path)
    csv_tree.rewrite_corpus_paths(spark, path, new_path, "/images", ["image_local", "html"])
    moved = keyed_json.read_keyed_corpus(spark, new_path, ["image_local", "html"])
    return moved.select("doc_id", "image_local", F.md5("html").alias("digest"))


SPLIT_FILES_SQL = f"""WITH lines AS (
  SELECT cast(l_suppkey AS varchar) AS query_id, cast(l_partkey AS varchar) AS doc_id, l_quantity FROM lineitem)
SELECT CASE WHEN {unit_sql("query_id", "1q")} <= 0.8 THEN 0 ELSE 1 END AS q_split,
       CASE WHEN {unit_sql("doc_id", "1d")} <= 0.5 THEN 0 ELSE 1 END AS d_split,
       query_id, doc_id, l_quantity, p_name
FROM lines JOIN part ON cast(p_partkey AS varchar) = doc_id"""


@query(SPLIT_FILES_SQL)
def load_splits(spark, sf_dir):
    """Four triplet files and two corpora, written and read as a split dataset."""
    root = new_folder(spark, "splits")
    triplets = split_two_way(supplier_triplets(spark, sf_dir).select("query_id", "doc_id", "l_quantity"))
    triplets = materialize(triplets, "split")
    corpus = _part_corpus(spark, sf_dir).select("doc_id", "p_name").withColumn("d_split", side_of("doc_id", 0.5, "1d"))
    for d in (0, 1):
        keyed_json.write_corpus_json(corpus.where(F.col("d_split") == d).drop("d_split"), f"{root}/corpus_{d + 1}.json")
        for q in (0, 1):
            part = triplets.where((F.col("q_split") == q) & (F.col("d_split") == d)).drop("q_split", "d_split")
            part.write.option("header", True).csv(f"{root}/query_{q}_product_id_{d}.csv")
    read, corpora = tables.load_all_splits(spark, root, "query_id string, doc_id string, l_quantity double", ["p_name"])
    return read.join(corpora, ["doc_id", "d_split"]).select("q_split", "d_split", "query_id", "doc_id", "l_quantity", "p_name")


def _metrics(spark, sf_dir):
    return evaluate(*stored_run_and_qrels(spark, sf_dir), KS)


@query(f"WITH {METRICS_SQL} SELECT name, round_even(value::DECIMAL(18, 12), 5)::DOUBLE AS value FROM metrics WHERE k IS NOT NULL")
def report_roundtrip(spark, sf_dir):
    """The nested report of one experiment, and its metrics as read for a leaderboard."""
    folder = new_folder(spark, "experiment")
    report.write_report_json(_metrics(spark, sf_dir), f"{folder}/output.json", top_k=HITS)
    metrics, _ = report.read_experiments(spark, [folder])
    return metrics.select("name", rounded("value", 5).alias("value"))


@query(f"WITH {METRICS_SQL} SELECT name, metric, k, round(value, 6) + 0.0 AS value FROM metrics")
def report_long(spark, sf_dir):
    path = new_folder(spark, "report")
    report.write_report(_metrics(spark, sf_dir), path)
    rows = spark.read.schema("name string, metric string, k int, value double, reported double").json(path)
    return rows.select("name", "metric", "k", rounded("value").alias("value"))


_SUMMARY_CSV = ", ".join(
    f"round_even(max(value::DECIMAL(18, 12)) FILTER (name = '{name}'), 5)::DOUBLE AS \"{column}\"" for column, name in SUMMARY_COLUMNS.items()
)


@query(f"WITH {METRICS_SQL} SELECT {_SUMMARY_CSV} FROM metrics")
def summary_csv(spark, sf_dir):
    path = new_folder(spark, "summary")
    report.write_summary_csv(report.summary(_metrics(spark, sf_dir), HITS), path)
    row = spark.read.option("header", True).csv(path)
    return row.select(*[F.bround(F.round(F.col(c).cast("double"), 12), 5).alias(c) for c in row.columns])


@query(f"WITH {METRICS_SQL} SELECT name, round(value, 6) + 0.0 AS value FROM metrics")
def metric_only(spark, sf_dir):
    """Metrics from a run and judgments that were stored as JSON."""
    run_path, qrels_path = new_folder(spark, "run-json"), new_folder(spark, "qrels-json")
    keyed_json.write_run_json(customer_run(spark, sf_dir), run_path)
    keyed_json.write_qrels_json(customer_qrels(spark, sf_dir), qrels_path)
    run = keyed_json.read_run_json(spark, run_path, splittable=True)
    qrels = keyed_json.read_qrels_json(spark, qrels_path, splittable=True)
    metrics = evaluate_stored(run, qrels, EvalConfig(top_k=HITS))
    return metrics.select("name", rounded("value").alias("value"))


@query(f"WITH {INPUTS_SQL} SELECT query_id, doc_id, rel FROM qrels")
def cached_stage(spark, sf_dir):
    """Judgments computed for this state of the input files, then read again from the store."""
    root = new_folder(spark, "stages")
    inputs = stages.files_fingerprint(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet")
    key = stages.fingerprint(inputs, {"weight": "l_quantity", "top_k": 1000})
    stages.cached_stage(spark, root, lambda: customer_qrels(spark, sf_dir), key)

    def unreachable():
        raise AssertionError("the stored stage was not used")

    return stages.cached_stage(spark, root, unreachable, key)


@query("SELECT page_id, md5(html) AS digest FROM pages")
def binary_images(spark, sf_dir):
    """Contents embedded in the table for pages under ``https``, else in a file of their own."""
    root = new_folder(spark, "images")
    pages = table(spark, sf_dir, "pages")
    secure = F.col("url").startswith("https")
    pages.where(~secure).select("html", "page_id").write.partitionBy("page_id").text(root)
    files = tables.read_binary_images(spark, root)
    named = files.withColumn("page_id", F.regexp_extract("path", "page_id=([0-9]+)/", 1).cast("long"))
    image = F.when(secure, F.struct(F.encode("html", "utf-8").alias("bytes"), F.col("url").alias("path")))
    rows = pages.select("page_id", image.alias("image")).join(named.select("page_id", F.col("path").alias("image_local")), "page_id", "left")
    with_bytes = tables.attach_images(rows, files, "image_local", "image")
    # The text writer ends each file with a line break.
    content = F.decode("image_bytes", "utf-8")
    whole = F.when(F.col("image").isNull(), F.regexp_replace(content, r"\n\z", "")).otherwise(content)
    return with_bytes.select("page_id", F.md5(whole).alias("digest"))


@query("SELECT page_id, '/images/' || regexp_extract(url, '[^/]*$') AS image_local FROM pages")
def columnar_images(spark, sf_dir):
    """The path inside an embedded image column, moved to another folder."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.struct(F.encode("html", "utf-8").alias("bytes"), F.col("url").alias("path")).alias("image"))
    return pages.select("page_id", basename_into("image.path", "/images").alias("image_local"))
