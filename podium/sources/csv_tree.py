"""Rewriting image paths in a tree of CSV files and in a keyed corpus."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.text import basename_into
from podium.session import materialize, ship_package
from podium.sources.keyed_json import read_keyed_corpus, write_corpus_json
from podium.sources.records import QUOTED_LINES, read_records

TREE = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}


def count_csv_files(spark: SparkSession, root: str) -> int:
    """Number of CSVs below a folder, empty ones too; only the listing is read."""
    return len(spark.read.options(**TREE).text(root).inputFiles())


def readable_files(spark: SparkSession, root: str) -> DataFrame:
    """``file`` of every CSV that has lines and can be read to its end.

    A file whose lines, with one or two bytes for each line end, are not as many bytes as it has
    was not read to its end and is left out.
    """
    lines = spark.read.options(ignoreCorruptFiles=True, **TREE).text(root)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"), "value")
    per_file = lines.groupBy("file").agg(
        F.sum(F.octet_length("value").cast("long")).alias("_bytes"), F.count(F.lit(1)).alias("_lines"), F.max("_size").alias("_size")
    )
    return per_file.where(F.col("_bytes") + 2 * F.col("_lines") + 3 >= F.col("_size")).select("file")


def fields_of(record: str) -> Column:
    """The fields of a CSV record with doubled quotes; an empty one without quotes is null."""
    raw = F.regexp_extract_all(record, F.lit(r'(?:^|,)("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'), F.lit(1))
    plain = lambda f: F.regexp_replace(F.regexp_replace(f, '(?s)^"(.*)"([^"]*)$', "$1$2"), '""', '"')
    return F.transform(raw, lambda f: F.when(f.startswith('"'), plain(f)).when(f != "", f))


def _quoted(values: Column) -> Column:
    """A CSV record of all values in quotes."""
    doubled = F.transform(values, lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')))
    return F.array_join(doubled, ",")


def _with_headers(batches):
    """The records (source_file, place, value, header) of a task, and before those of each file its header."""
    seen = set()
    for batch in batches:
        names = batch.column("source_file")
        new = [name for name in names.unique().to_pylist() if name not in seen]
        if new:
            headers = [batch.column("header")[names.index(name).as_py()] for name in new]
            yield pa.RecordBatch.from_arrays([pa.array(new), pa.array([-1] * len(new), pa.int64()), pa.array(headers, names.type)], names=_LINE)
            seen.update(new)
        yield pa.RecordBatch.from_arrays([batch.column(name) for name in _LINE], names=_LINE)


_LINE = ["source_file", "place", "value"]


def rewrite_csv_tree(spark: SparkSession, root: str, new_root: str, directory: str, column: str = "image_local") -> DataFrame:
    """Put the image paths of every CSV below ``root`` into ``directory``.

    Files that have the column are written, all values quoted, to
    ``new_root/source_file=<relative path>``; the originals are left alone. All files are read and written in one pass, each record
    by the header of its own file, whatever their columns; each task writes a part, with the header, of each file
    that it reads. A file that cannot be read to its end is left out whole, and not counted as updated. Fields that a
    record lacks are empty, those beyond the header are dropped. Returns one row ``(total_files, updated_files)``.
    """
    ship_package(spark)
    directory = posixpath.normpath(directory)
    records = read_records(spark, root, QUOTED_LINES, skip_unfinished=True, ignoreCorruptFiles=True, **TREE)
    records = records.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where("text <> ''")
    headers = records.where("first").select("file", fields_of("text").alias("names")).join(readable_files(spark, root), "file", "left_semi")
    headers = materialize(headers.withColumn("at", F.array_position("names", column)).where("at > 0"), "headers")
    base = root.rstrip("/") + "/"
    relative = F.substring_index(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), base, -1)
    rows = records.where(~F.col("first")).withColumn("fields", fields_of("text")).join(headers, "file")
    field = lambda i: F.try_element_at(F.col("fields"), i)
    moved = F.transform(
        F.sequence(F.lit(1), F.size("names")), lambda i: F.when(i == F.col("at"), basename_into(field(i), directory)).otherwise(field(i))
    )
    lines = rows.select(
        relative.alias("source_file"), F.monotonically_increasing_id().alias("place"), _quoted(moved).alias("value"),
        _quoted(F.col("names")).alias("header"),
    )
    lines = lines.mapInArrow(_with_headers, "source_file string, place long, value string")
    lines = lines.sortWithinPartitions("source_file", "place").drop("place")
    lines.write.partitionBy("source_file").option("lineSep", "\n").option("compression", "none").format("text").save(new_root)
    counts = F.lit(count_csv_files(spark, root)).alias("total_files"), F.lit(headers.count()).alias("updated_files")
    return spark.range(1).select(*counts)


def rewrite_corpus_paths(
    spark: SparkSession,
    path: str,
    new_path: str,
    directory: str,
    fields: list[str] | str,
    column: str = "image_local",
    splittable: bool = True,
):
    """The same for a keyed corpus, written as keyed JSON to a new place."""
    corpus = read_keyed_corpus(spark, path, fields, splittable)
    write_corpus_json(corpus.withColumn(column, basename_into(column, directory)), new_path)
