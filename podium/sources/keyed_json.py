"""JSON files that hold one object with an entry per id: corpora, judgments and runs."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.operators.topk import first_per_group
from podium.session import ship_package
from podium.sources.records import OBJECT_ENTRIES, read_records

def read_keyed_json(spark: SparkSession, path: str, value_type: str, splittable: bool = True) -> DataFrame:
    """``(key, value)`` of every entry of the object; of a repeated key the last counts.

    A file of any size, spacing and nesting is cut into its entries in parallel, see ``records``; the files are scanned
    for that when this is called. With ``splittable=False`` each file is parsed by one task. An entry that is no JSON is an error.
    """
    if splittable:
        rows = read_records(spark, path, OBJECT_ENTRIES)
        inner = F.when(F.col("first"), F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
        rows = rows.withColumn("inner", F.when(F.col("last"), F.regexp_replace(inner, r"\}\s*$", "")).otherwise(inner))
        text = F.concat(F.lit("{"), "inner", F.lit("}"))
        entries = F.from_json(text, f"map<string,{value_type}>", {"mode": "FAILFAST"})
        rows = rows.where(F.col("inner").rlike(r"\S")).select("file", "start", "place", F.explode(entries))
        return _last_entry(rows)
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    entries = F.from_json("value", f"map<string,{value_type}>", {"mode": "FAILFAST"})
    rows = text.select("file", F.lit(0).cast("long").alias("start"), F.posexplode(entries).alias("place", "key", "value"))
    return _last_entry(rows.withColumn("place", F.col("place").cast("long")))


def _last_entry(rows: DataFrame) -> DataFrame:
    order = [F.desc("file"), F.desc("start"), F.desc("place")]
    return first_per_group(rows, ["key"], order).select("key", "value")


def read_keyed_corpus(spark: SparkSession, path: str, fields: list[str] | str, splittable: bool = True) -> DataFrame:
    """``doc_id`` and typed field columns from ``{doc_id: {field: value}}``.

    ``fields`` is a list of text fields or a DDL list such as ``title string, price double``.
    """
    if not isinstance(fields, str):
        fields = ", ".join(f"`{name}` string" for name in fields)
    value_type = spark.createDataFrame([], fields).schema.simpleString()
    return read_keyed_json(spark, path, value_type, splittable).select(F.col("key").alias("doc_id"), "value.*")


def read_qrels_json(spark: SparkSession, path: str, splittable: bool = True) -> DataFrame:
    """Judgments from ``{query_id: {doc_id: grade}}``."""
    entries = read_keyed_json(spark, path, "map<string,int>", splittable)
    rows = entries.select(F.col("key").alias("query_id"), F.posexplode("value").alias("place", "doc_id", "rel"))
    last = first_per_group(rows, ["query_id", "doc_id"], [F.desc("place")])
    return last.select("query_id", "doc_id", "rel")


def read_run_json(spark: SparkSession, path: str, splittable: bool = True) -> DataFrame:
    """A ranking from ``{query_id: {doc_id: score}}``; equal scores keep their stored order."""
    entries = read_keyed_json(spark, path, "map<string,double>", splittable)
    rows = entries.select(F.col("key").alias("query_id"), F.posexplode("value").alias("place", "doc_id", "score"))
    last = first_per_group(rows, ["query_id", "doc_id"], [F.desc("place")])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    return last.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "score", "rank")


def write_keyed_json(df: DataFrame, path: str, key: str, value: str):
    """Write ``{key: value}``; ``value`` is a column with the JSON text of the entry.

    Each task writes one file that is a complete object, so no task sees the whole table.
    """

    ship_package(df.sparkSession)

    def lines(batches):
        held = "{"
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held != "{":
                    out.append(held + ",")
                    held = ""
                held += json.dumps(name) + ": " + text
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([held + "}"])], names=["value"])

    df.select(key, value).mapInArrow(lines, "value string").write.option("lineSep", " ").text(path)


def write_corpus_json(df: DataFrame, path: str, doc_id: str = "doc_id"):
    fields = [c for c in df.columns if c != doc_id]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    write_keyed_json(df.select(doc_id, text.alias("_json")), path, doc_id, "_json")


def _write_nested(df: DataFrame, path: str, value: str, order: str):
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct(order, "doc_id", value))), lambda e: F.struct(e["doc_id"], e[value])
    )
    text = F.to_json(F.map_from_entries(entries))
    write_keyed_json(df.groupBy("query_id").agg(text.alias("_json")), path, "query_id", "_json")


def write_qrels_json(qrels: DataFrame, path: str):
    """Judgments as ``{query_id: {doc_id: grade}}``; a query's judgments are one entry."""
    _write_nested(qrels.withColumn("_order", -F.col("rel")), path, "rel", "_order")


def write_run_json(run: DataFrame, path: str):
    """A ranking as ``{query_id: {doc_id: score}}``, best first."""
    _write_nested(run, path, "score", "rank")
