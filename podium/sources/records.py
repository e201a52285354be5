"""Records of text files whose separators may also stand inside quotes, found in parallel.

A file is read in splits, as pieces between separators. Whether a piece begins inside a quoted text, and how
deep in brackets, depends on all that stands before it; so every split says what it does to either state, and
these transitions are added up over the splits of a file. Then every split knows its first state and cuts its
pieces into records; a record that goes over the end of a split is put together from its parts. No file is read by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.session import materialize, ship_package


@dataclass(frozen=True)
class Layout:
    separator: str  # ends a record where it stands outside of quotes and at this depth
    depth: int = 0
    escapes: bool = False  # a backslash takes a quote's meaning
    brackets: bool = False


#: Lines of a file with quoted fields; a doubled quote is two quotes.
QUOTED_LINES = Layout("\n")
#: Entries of one object per file, whatever their values, spacing and line breaks.
OBJECT_ENTRIES = Layout(",", 1, True, True)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def transitions(texts: pa.Array, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per piece its number of quotes, and by how much it goes deeper if it begins outside, or inside, a quoted text."""
    data, offsets = _bytes(texts)
    quote = data == 34
    piece = lambda at: np.searchsorted(offsets, at, side="right") - 1
    if layout.escapes:
        found = np.flatnonzero(quote)
        other = np.maximum.accumulate(np.where(data != 92, np.arange(len(data)), -1))
        run = np.where(found > 0, found - 1 - other[found - 1], 0)
        quote[found[np.minimum(run, found - offsets[piece(found)]) % 2 == 1]] = False
    sums = np.concatenate([[0], np.cumsum(quote)])
    quotes = sums[offsets[1:]] - sums[offsets[:-1]]
    if not layout.brackets:
        none = np.zeros(len(quotes), np.int64)
        return quotes, none, none
    opens = (data == 123) | (data == 91)
    at = np.flatnonzero(opens | (data == 125) | (data == 93))
    step, of, inside = np.where(opens[at], 1, -1), piece(at), 0
    inside = (sums[at] - sums[offsets[of]]) % 2 == 1
    deeper = [np.bincount(of[s], step[s], len(quotes)).astype(np.int64) for s in (~inside, inside)]
    return quotes, deeper[0], deeper[1]


def _splits(batch: pa.RecordBatch):
    """The runs of rows of one split, with its file and start."""
    file, start = (batch.column(name).to_numpy() for name in ("file", "start"))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if end > begin:
            yield (int(file[begin]), int(start[begin])), batch.slice(begin, end - begin)


def _pieces(spark: SparkSession, path: str | list[str], layout: Layout, options: dict) -> DataFrame:
    rows = spark.read.option("lineSep", layout.separator).options(**options).text(path)
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        F.col("_metadata.file_path").alias("name"),
        "value",
    )


def _entry_states(pieces: DataFrame, layout: Layout) -> DataFrame:
    """Per split the state it begins with, and whether it is the first and the last of its file."""

    def add(batches):
        held = {}
        for batch in batches:
            for split, rows in _splits(batch):
                quotes, outside, inside = transitions(rows.column("value"), layout)
                odd = (np.cumsum(quotes) - quotes) % 2 == 1
                total = held.setdefault(split, np.zeros(3, np.int64))
                # the depth for either first state: a piece of this split is inside if the quotes before it say the other way round
                begun = total[0] % 2 == 1
                even = np.where(odd ^ begun, inside, outside).sum()
                total += [quotes.sum(), even, np.where(odd ^ begun, outside, inside).sum()]
        rows = [(*split, *total.tolist()) for split, total in held.items()]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "quotes", "outside", "inside"])

    shape = "file long, start long, quotes long, outside long, inside long"
    splits = pieces.select("file", "start", "value").mapInArrow(add, shape)
    splits = splits.groupBy("file", "start").agg(*(F.sum(c).alias(c) for c in ("quotes", "outside", "inside")))
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    splits = splits.withColumn("deeper", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    return splits.select(
        "file", "start", "quoted",
        F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"),
        F.lag("start").over(order).isNull().alias("first"),
        F.lead("start").over(order).isNull().alias("last"),
        ((F.col("quoted").cast("long") + F.col("quotes")) % 2 == 1).alias("ends_quoted"),
        F.sum("deeper").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("ends_depth"),
    )


def _cut(pieces: DataFrame, states: DataFrame, layout: Layout) -> DataFrame:
    """Records and, at the ends of splits, parts of records: file, start, place, text, begins, ends, last (of its file)."""
    names = ["file", "start", "place", "text", "begins", "ends", "last"]

    def record(split, number, parts, begins, ends, last=False):
        values = (*split, number, layout.separator.join(parts), begins, ends, last)
        return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, values)}, schema=schema)

    def cut(batches):
        split, parts, begins, last = None, [], False, False
        quotes_before = depth = number = 0
        for batch in batches:
            for found, rows in _splits(batch):
                if found != split:
                    if parts:
                        yield record(split, number, parts, begins, last, last)
                    first = {n: rows.column(n)[0].as_py() for n in ("quoted", "depth", "first", "last")}
                    split, parts, number, last = found, [], 0, first["last"]
                    quotes_before, depth = int(first["quoted"]), first["depth"]
                    begins = first["first"] or (not first["quoted"] and depth == layout.depth)
                values = rows.column("value")
                quotes, outside, inside = transitions(values, layout)
                after = quotes_before + np.cumsum(quotes)
                deep = depth + np.cumsum(np.where((after - quotes) % 2 == 1, inside, outside))
                closed = np.flatnonzero((after % 2 == 0) & (deep == layout.depth))
                quotes_before, depth = int(after[-1]), int(deep[-1])
                if not len(closed):
                    parts += values.to_pylist()
                    continue
                head = int(closed[0]) + 1
                yield record(split, number, [*parts, *values[:head].to_pylist()], begins, True)
                bounds = pa.array(closed.astype(np.int32) + 1)
                whole = pc.binary_join(pa.ListArray.from_arrays(bounds, values.cast(pa.string())), layout.separator)
                n = len(whole)
                flags = [pa.array(np.full(n, v)) for v in (True, True, False)]
                same = [pa.array(np.full(n, v, np.int64)) for v in split]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n) + number + 1), whole, *flags], schema=schema)
                number, parts, begins = number + n + 1, values[int(closed[-1]) + 1 :].to_pylist(), True
        if parts:
            yield record(split, number, parts, begins, last, last)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    schema = pa.schema(list(zip(names, kinds)))
    states = states.select("file", "start", "quoted", "depth", "first", "last")
    known = pieces.select("file", "start", "place", "value").join(states, ["file", "start"])
    ordered = known.sortWithinPartitions("file", "start", "place").drop("place")
    return ordered.mapInArrow(cut, "file long, start long, place long, text string, begins boolean, ends boolean, last boolean")


def read_records(spark: SparkSession, path: str | list[str], layout: Layout, skip_unfinished: bool = False, **options) -> DataFrame:
    """``file`` (its path), ``start``, ``place``, ``text``, ``first`` and ``last`` (of its file): the records in the order of start and place.

    The text of a record has no separator at its end; what the end of the file closes, without a separator, is marked as last. The states of the splits are computed, and stored, when this is called; a file
    that ends inside quotes or brackets is an error then, or is left out with ``skip_unfinished``. The text of one record is held by one task.
    """
    ship_package(spark)
    pieces = _pieces(spark, path, layout, options)
    states = materialize(_entry_states(pieces, layout), "splits")
    names = pieces.select("file", "name").distinct()
    unfinished = states.where("last").where(F.col("ends_quoted") | (F.col("ends_depth") != 0)).select("file")
    if skip_unfinished:
        states = states.join(unfinished, "file", "left_anti")
    elif example := unfinished.join(names, "file").limit(1).collect():
        raise ValueError(f"{example[0]['name']} ends inside quotes or brackets")
    found = _cut(pieces, states, layout)
    whole = found.where("begins and ends").select("file", "start", "place", "text", "last")
    parts = found.where("not (begins and ends)")
    order = Window.partitionBy("file").orderBy("start", "place")  # two rows for each split at most
    parts = parts.withColumn("_record", F.sum(F.col("begins").cast("int")).over(order))
    joined = parts.groupBy("file", "_record").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("p"), F.max("last").alias("last")
    )
    begin = F.col("p")[0]
    joined = joined.select(
        "file", begin["start"].alias("start"), begin["place"].alias("place"), F.array_join("p.text", layout.separator).alias("text"), "last"
    )
    first = states.where("first").select("file", F.col("start").alias("_start"))
    rows = whole.unionByName(joined).join(first, "file").join(names, "file")
    is_first = (F.col("start") == F.col("_start")) & (F.col("place") == 0)
    return rows.select(F.col("name").alias("file"), "start", "place", "text", is_first.alias("first"), "last")
