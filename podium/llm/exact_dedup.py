"""Exact duplicates by a streaming query with keyed state on disk.

The stream reads the files of a Parquet table. Its state, in RocksDB and below the shared folder,
has one entry per digest and never expires: how many rows had it, and length, id and place (file and row) of the
row that stays. New files can be added later: with the same ``state`` folder a run reads only
those. Afterwards every row meets the entry of its digest, and rows that hit another row's entry
are compared with that row's whole text.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.session import new_folder

_SPACE = " \t\n\x0b\f\r"
_STATE = "spark.sql.streaming.stateStore."
_SETTINGS = {
    f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}rocksdb.allowFAllocate": "false",  # else each partition reserves some MB
    f"{_STATE}rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}rocksdb.maxMemoryUsageMB": "300",
}


def without_space(text: Column) -> Column:
    """The text without the six ASCII white-space characters; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in _SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


@contextmanager
def _state_store(spark: SparkSession):
    """The state store's settings, for queries that start inside."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _measured(rows: DataFrame, id_column: str, text_column: str, *more: Column) -> DataFrame:
    whole = without_space(F.col(text_column))
    return rows.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.sha2(whole, 256).alias("digest"),
        F.length(F.coalesce(text_column, F.lit(""))).cast("long").alias("n"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        *more,
    )


def fold_state(
    spark: SparkSession, path: str, state: str, id_column: str = "doc_id", text_column: str = "text", files_per_batch: int = 10_000
) -> DataFrame:
    """Run the stream over the files of ``path`` that ``state`` has not seen; all entries are returned.

    One row per digest: digest, group_size, keep (a struct of n, the bitwise complement of the id, file and row of the
    row that stays: the longest text, then the smallest id, a null id last, then the last file and row).
    """
    schema = spark.read.parquet(path).schema
    place = path.rstrip("/")
    pattern = f"{place[:-1]}[{place[-1]}]"  # only a pattern may name a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    best = F.struct("n", F.bitwise_not("doc_id").alias("not_id"), "file", "row")
    entries = _measured(stream, id_column, text_column).groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(best).alias("keep")
    )

    def store(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{state}/entries/batch={number}")

    with _state_store(spark):
        query = (
            entries.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state}/checkpoint")
            .foreachBatch(store)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    changes = spark.read.option("basePath", f"{state}/entries").parquet(f"{state}/entries")
    newest = F.max_by(F.struct("group_size", "keep"), "batch").alias("entry")
    return changes.groupBy("digest").agg(newest).select("digest", "entry.group_size", "entry.keep")


def exact_duplicates(
    spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text", state: str | None = None
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after all ASCII white space is deleted; a null text is empty, and
    all empty ones are equal. Of equal texts the row with the most code points stays, then the
    smallest id; repeated ids are told apart by file and row. A table without rows gives none, and
    other columns are ignored.
    """
    state = state or new_folder(spark, "dedup-state")
    entries = fold_state(spark, path, state, id_column, text_column)
    rows = _measured(spark.read.parquet(path), id_column, text_column, without_space(F.col(text_column)).alias("whole"))
    met = rows.join(entries, "digest")
    kept = (met.keep.file == met.file) & (met.keep.row == met.row)
    met = met.select(
        "doc_id", "digest", "group_size", "n", "file", "row", F.bitwise_not("keep.not_id").alias("keep_id"), kept.alias("kept"),
        F.when(F.col("group_size") > 1, F.col("whole")).alias("whole"),
    )
    stored = new_folder(spark, "dedup-rows")
    met.write.parquet(stored)
    met = spark.read.parquet(stored)
    shared = met.where("group_size > 1")
    holders = shared.where("kept").select("digest", F.col("whole").alias("held"))
    other = shared.where("not kept").join(holders, "digest").where("whole <> held").select("digest")
    result = ["doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    if other.isEmpty():
        return met.select(result)
    # different texts of one digest: their rows are grouped anew, by the whole text
    clash = met.join(other.distinct(), "digest", "left_semi")
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("not_id"), "file", "row")).alias("keep")
    groups = clash.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("group_size"), best)
    anew = clash.drop("group_size", "keep_id", "kept").join(groups, ["digest", "whole"])
    anew = anew.withColumns(
        {"keep_id": F.bitwise_not("keep.not_id"), "kept": (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))}
    )
    return met.join(other.distinct(), "digest", "left_anti").select(result).unionByName(anew.select(result))
