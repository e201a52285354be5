"""Readers and writers of triplets, columnar datasets, vectors and images."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.sources.records import QUOTED_LINES, read_records

# The texts that a CSV reader of the pandas family takes for a missing value.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def has_multiline_fields(spark: SparkSession, path: str | list[str], **options) -> bool:
    """Whether any line of a CSV has an odd number of quotes, so a quoted field spans lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.options(**options).text(path)
    return not lines.where(quotes % 2 == 1).select(F.lit(1)).limit(1).isEmpty()


def read_csv_text(spark: SparkSession, path: str | list[str], multi_line: bool | None = None, **options) -> DataFrame:
    """CSV with a header and doubled quotes, all columns as text.

    A quoted line break is part of a field. The files are checked for them first; where there are any, lines are put
    together to records in parallel, see ``records``. ``multi_line=False`` says that there are none, ``True`` reads
    each file in one task. Several files have the columns of the first one.
    """
    if multi_line is None and has_multiline_fields(spark, path, **options):
        return _read_csv_records(spark, path, options)
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=bool(multi_line), **options)
    return reader.csv(path)


def _read_csv_records(spark: SparkSession, path: str | list[str], options: dict) -> DataFrame:
    rows = read_records(spark, path, QUOTED_LINES, **options).withColumn("text", F.regexp_replace("text", r"\r\z", ""))
    header = rows.where("first").orderBy("file").limit(1).collect()[0]["text"]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in next(csv.reader([header], strict=True))])
    fields = F.from_csv("text", schema.toDDL(), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    return rows.where(~F.col("first") & (F.col("text") != "")).select(fields.alias("fields")).select("fields.*")


def read_triplets(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    na_values: tuple[str, ...] = NA_VALUES,
    multi_line: bool | None = None,
) -> DataFrame:
    """Triplets from CSV. Columns are found by name; those not in ``schema`` stay text.

    Any of ``na_values`` becomes null. A value that does not fit its type is an error.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    typed = {field.name: field.dataType for field in schema or []}
    rows = read_csv_text(spark, path, multi_line)
    absent = [name for name in typed if name not in rows.columns]
    if absent:
        raise ValueError(f"columns {absent} are not in the file, which has {rows.columns}")
    columns = []
    for name in rows.columns:
        quoted = F.col(f"`{name}`")
        value = F.when(~quoted.isin(*na_values), quoted)
        columns.append((value.cast(typed[name]) if name in typed else value).alias(name))
    return rows.select(*columns)


def read_columnar(spark: SparkSession, path: str, unique: str | None = None) -> DataFrame:
    """A columnar dataset, used as triplets or as a corpus.

    ``unique`` names an id that must not repeat; this is checked when called.
    """
    df = spark.read.parquet(path)
    if unique is not None:
        require_unique(df, unique)
    return df


def require_unique(df: DataFrame, column: str):
    repeated = df.groupBy(column).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{column} {repeated[0][column]!r} occurs {repeated[0]['count']} times")


def with_checked_size(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Fails while running on a vector of another size."""
    wrong = F.col(vector).isNotNull() & (F.size(vector) != dim)
    message = F.concat(F.lit(f"expected {dim} numbers, found "), F.size(vector).cast("string"))
    element = df.schema[vector].dataType.simpleString()
    checked = F.when(wrong, F.raise_error(message).cast(element)).otherwise(F.col(vector))
    return df.withColumn(vector, checked)


def read_vectors(spark: SparkSession, path: str, dim: int, vector: str = "embedding") -> DataFrame:
    return with_checked_size(spark.read.parquet(path), dim, vector)


def read_vectors_part(spark: SparkSession, path: str, dim: int, share: float = 0.01, vector: str = "embedding") -> DataFrame:
    """The vectors in some of the files, evenly chosen from all of them, without reading the rest."""
    files = sorted(spark.read.parquet(path).inputFiles())
    count = max(1, round(len(files) * share))
    chosen = [files[i * len(files) // count] for i in range(count)]
    return with_checked_size(spark.read.option("basePath", path).parquet(*chosen), dim, vector)


def write_vectors(df: DataFrame, path: str, id_column: str = "id", vector: str = "embedding", mode: str = "errorifexists"):
    """Vectors travel with their id, never by position."""
    df.select(id_column, F.col(vector).cast("array<float>").alias(vector)).write.mode(mode).parquet(path)


def read_binary_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, content)`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content")


def attach_images(
    df: DataFrame, files: DataFrame | None, path: str | None = "image_local", embedded: str | None = None, out: str = "image_bytes"
) -> DataFrame:
    """Image bytes of each row: embedded in an image column, else from the file at its path."""
    inside: Column = F.col(f"{embedded}.bytes") if embedded else F.lit(None).cast("binary")
    if files is None:
        return df.withColumn(out, inside)
    # Local files have no host: file:/a, file:///a and /a are the same. Other URIs keep scheme and bucket.
    canonical = lambda c: F.regexp_replace(c, "^file:(//(localhost)?)?(?=/)", "")
    bare = lambda c: F.regexp_replace(c, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    names = files.select(canonical("path").alias("_target")).distinct()
    # A path without scheme may also mean a file of another store; the exact name goes first.
    known = names.select(F.col("_target").alias("_key"), F.lit(0).alias("_rank"), "_target").union(
        names.select(bare("_target"), F.lit(1), "_target")
    )
    known = known.groupBy("_key").agg(F.min(F.struct("_rank", "_target"))["_target"].alias("_target"))
    rows = df.withColumn("_key", canonical(F.col(path))).join(known, "_key", "left")
    content = files.groupBy(canonical("path").alias("_target")).agg(F.first("content").alias("_content"))
    joined = rows.join(content, "_target", "left")
    return joined.withColumn(out, F.coalesce(inside, "_content")).drop("_key", "_target", "_content")


def load_split(spark: SparkSession, root: str, q: int, d: int, schema=None, corpus_fields=None, with_judgments: bool = False):
    """One of the four parts of a split dataset: its triplets, its corpus and, if asked, its judgments.

    Part (q, d) is ``query_q_product_id_d.csv`` with ``corpus_{d+1}.json``.
    """
    from podium.sources.keyed_json import read_keyed_corpus, read_qrels_json

    name = f"{root.rstrip('/')}/query_{q}_product_id_{d}"

    def mark(df):
        return df.withColumn("q_split", F.lit(q)).withColumn("d_split", F.lit(d))

    triplets = mark(read_triplets(spark, f"{name}.csv", schema))
    corpus = read_keyed_corpus(spark, f"{root.rstrip('/')}/corpus_{d + 1}.json", corpus_fields).withColumn("d_split", F.lit(d))
    if not with_judgments:
        return triplets, corpus
    judgments = [mark(read_qrels_json(spark, f"{name}_gt_{part}.json")).withColumn("part", F.lit(part)) for part in ("dev", "test")]
    return triplets, corpus, judgments[0].unionByName(judgments[1])


def load_all_splits(spark: SparkSession, root: str, schema=None, corpus_fields=None):
    """Triplets of all four parts, and both corpora, with their split columns."""
    parts = [load_split(spark, root, q, d, schema, corpus_fields) for q in (0, 1) for d in (0, 1)]
    triplets = parts[0][0]
    for part in parts[1:]:
        triplets = triplets.unionByName(part[0])
    return triplets, parts[0][1].unionByName(parts[1][1])
