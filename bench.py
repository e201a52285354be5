"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local threads. Every query is
run once to warm up and then once more for its time, all rows computed.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from podium.catalog import QUERIES
from podium.catalog.relations import HITS, customer_vectors, doc_vectors

HEADLINE = [
    "knn_cosine_topk",
    "knn_block_topk",
    "judge_run",
    "build_qrels",
    "sample_weighted",
    "first_per_query",
    "evaluate_all",
    "metric_summary",
    "evaluate_splits",
    "leaderboard",
    "embed_texts",
    "embed_then_evaluate",
    "classify",
    "mean_pool_long",
    "dev_test_split",
    "score_linear",
    "keyed_json_splittable",
    "run_json_roundtrip",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark, sf_dir, name) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        run(spark, sf_dir, name)
        seconds[name] = round(run(spark, sf_dir, name), 3)
    docs = doc_vectors(spark, sf_dir).count()
    queries = customer_vectors(spark, sf_dir).count()
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    result = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else sf_dir,
        "pairs_per_sec": round(docs * docs / seconds["knn_cosine_topk"]),
        "evaluated_hits_per_sec": round(queries * HITS / seconds["evaluate_all"]),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
