"""Batch embedding of multi-field records with a pluggable encoder, and zero-shot labels."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.config import FieldSpec
from podium.functions.text import as_id, field_weights, is_missing, stringify, truncate_tokens
from podium.operators.knn import BROADCAST_BYTES, SIMILARITIES, to_matrix
from podium.session import ship_package, spread_small


class Encoder(Protocol):
    """What ``embed`` calls with a list of texts or image bytes.

    ``key`` names the encoder and its settings; a Python worker loads one encoder per key.
    """

    key: str
    dim: int

    def load(self):
        """Called once per Python worker; returns a function from a list to a matrix."""


class HashedNgrams:
    """Text encoder without a model: signed counts of hashed word n-grams.

    The first 8 hex digits of an n-gram's md5 choose the position, the next one the sign.
    """

    def __init__(self, dim: int = 64, sizes: tuple[int, ...] = (1, 2)):
        self.dim = dim
        self.sizes = sizes
        self.key = f"hashed-ngrams-{dim}-{sizes}"

    def load(self):
        return self.encode

    def place(self, gram: str) -> tuple[int, int]:
        digest = hashlib.md5(gram.encode()).hexdigest()
        return int(digest[:8], 16) % self.dim, 1 if int(digest[8], 16) < 8 else -1

    def encode(self, texts: list[str]) -> np.ndarray:
        lists = pc.split_pattern_regex(pa.array(texts, pa.string()), "[ \t\r\n]+")
        row, words = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        filled = pc.not_equal(words, "")
        row, words = row[filled.to_numpy(zero_copy_only=False)], words.filter(filled)
        cells = np.zeros(len(texts) * self.dim)
        for size in self.sizes:
            count = max(0, len(words) - size + 1)
            starts = np.flatnonzero(row[:count] == row[size - 1 : size - 1 + count])
            parts = [words.take(pa.array(starts + i)) for i in range(size)]
            grams = pc.binary_join_element_wise(*parts, " ").dictionary_encode()
            unique = np.array([self.place(gram) for gram in grams.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
            places = unique[grams.indices.to_numpy()]
            cells += np.bincount(row[starts] * self.dim + places[:, 0], weights=places[:, 1], minlength=len(cells))
        return cells.reshape(len(texts), self.dim)


_LOADED: dict = {}


def _loaded(encoder: Encoder):
    if encoder.key not in _LOADED:
        _LOADED[encoder.key] = encoder.load()
    return _LOADED[encoder.key]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths > 0, lengths, 1.0)


def embed(
    df: DataFrame,
    id_column: str,
    fields: list[FieldSpec],
    encoders: dict[str, Encoder],
    batch_size: int = 256,
    carry: tuple[str, ...] = (),
    out: str = "embedding",
) -> DataFrame:
    """``(id, *carry, embedding)``: the weighted sum of a record's field vectors, unit length.

    Field vectors are scaled to unit length first. A missing field other than the first has
    weight 0 and is not encoded; a missing first text is encoded as ``nan``. A record with
    nothing to encode gets a null vector (``count_missing`` counts them).
    """
    ship_package(df.sparkSession)
    dim = {encoders[field.kind].dim for field in fields}
    if len(dim) != 1:
        raise ValueError(f"encoders disagree on the vector size: {sorted(dim)}")
    dim = dim.pop()
    inputs = []
    for position, field in enumerate(fields):
        value = F.col(field.name)
        if field.kind == "txt":
            value = stringify(value)
            value = truncate_tokens(value, field.max_tokens) if field.max_tokens else value
        if position or field.kind != "txt":
            value = F.when(~is_missing(df, field.name), value)
        inputs.append(value.alias(f"_field_{position}"))
    rows = df.select(as_id(id_column).alias(id_column), *carry, field_weights(df, fields).alias("_weights"), *inputs)
    rows = spread_small(rows)
    kept = [id_column, *carry]
    schema = rows.select(*kept).schema.add(out, T.ArrayType(T.FloatType()))
    kinds = [field.kind for field in fields]

    def encode_rows(part: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros((part.num_rows, dim))
        seen = np.zeros(part.num_rows, dtype=bool)
        weights = part.column("_weights").to_pylist()
        for position, kind in enumerate(kinds):
            share = np.array([w[position] if w else 0.0 for w in weights])
            column = part.column(f"_field_{position}")
            use = np.flatnonzero((share > 0) & column.is_valid().to_numpy(zero_copy_only=False))
            if len(use):
                vectors = unit_rows(_loaded(encoders[kind])(column.take(pa.array(use)).to_pylist()))
                total[use] += share[use, None] * vectors
                seen[use] = True
        flat = pa.array(unit_rows(total).astype(np.float32).ravel())
        lists = pa.FixedSizeListArray.from_arrays(flat, dim).cast(pa.list_(pa.float32()))
        vectors = pc.if_else(pa.array(seen), lists, pa.scalar(None, lists.type))
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], vectors], names=[*kept, out])

    def encode(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                yield encode_rows(batch.slice(start, batch_size))

    return rows.mapInArrow(encode, schema)


def count_missing(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Number of records, and of those without a vector."""
    return vectors.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.col(vector).isNull().cast("long")), F.lit(0)).alias("without_vector"),
    )


def label_softmax(scores: DataFrame, item: str = "item_id", score: str = "score", out: str = "probability") -> DataFrame:
    """Softmax over the labels of each item."""
    labels = Window.partitionBy(item)
    shifted = F.exp(F.col(score) - F.max(score).over(labels))
    return scores.withColumn("_shifted", shifted).withColumn(out, F.col("_shifted") / F.sum("_shifted").over(labels)).drop("_shifted")


def _over_labels(items: DataFrame, labels: DataFrame, vector: str, block_bytes: int, row, schema: str) -> list[DataFrame]:
    """Run ``row(item_ids, vectors, names, matrix)`` over the items, once per block of labels.

    Items stay where they are. Labels are broadcast in blocks of a bounded size: one block in
    almost every case; more blocks mean more scans of the items.
    """
    ship_package(items.sparkSession)
    side = labels.where(F.col(vector).isNotNull()).select(as_id("label").alias("label"), F.col(vector).alias("vector"))
    n_labels, dim = side.agg(F.count("*"), F.max(F.size("vector"))).first()
    dim = dim or 0
    blocks = max(1, -(-n_labels * dim * 8 // block_bytes))
    side = side.withColumn("_block", F.pmod(F.xxhash64("label"), F.lit(blocks)))
    rows = items.where(F.col(vector).isNotNull()).select(as_id("item_id").alias("item_id"), F.col(vector).alias("vector"))
    parts = []
    for block in range(blocks):
        table = side.where(F.col("_block") == block).drop("_block").orderBy("label").toArrow()
        shared = items.sparkSession.sparkContext.broadcast((table["label"].to_pylist(), to_matrix(table["vector"], dim)))

        def score(batches, shared=shared):
            names, matrix = shared.value
            step = max(1, 1_000_000 // max(1, len(names)))
            for batch in batches:
                for start in range(0, batch.num_rows if names else 0, step):
                    part = batch.slice(start, step)
                    yield row(part.column("item_id"), to_matrix(part.column("vector"), dim), names, matrix)

        parts.append(rows.mapInArrow(score, schema))
    return parts


def scaled_scores(
    items: DataFrame,
    labels: DataFrame,
    scale: float = 10.0,
    vector: str = "embedding",
    similarity: str = "ip",
    block_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(item_id, label, score)`` for every item and label: ``scale`` times the similarity."""
    compare = SIMILARITIES[similarity]

    def row(ids, vectors, names, matrix):
        item = ids.take(pa.array(np.repeat(np.arange(len(ids)), len(names))))
        values = scale * compare(vectors, matrix, 1e-6)
        columns = [item, pa.array(names * len(ids), pa.string()), pa.array(values.ravel())]
        return pa.RecordBatch.from_arrays(columns, names=["item_id", "label", "score"])

    schema = "item_id string, label string, score double"
    scores, *more = _over_labels(items, labels, vector, block_bytes, row, schema)
    for part in more:
        scores = scores.unionByName(part)
    return scores


def classify(
    items: DataFrame, labels: DataFrame, scale: float = 10.0, vector: str = "embedding", block_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The most probable label of every item: ``(item_id, label, probability)``.

    A task keeps the best label and the sum of exponentials per item, so scores are not
    shuffled; only with several blocks of labels are those two numbers combined per item.
    """

    def row(ids, vectors, names, matrix):
        scores = scale * (vectors @ matrix.T)
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(ids)), best]
        total = np.exp(scores - top[:, None]).sum(axis=1)
        columns = [ids, pa.array([names[i] for i in best], pa.string()), pa.array(top), pa.array(total)]
        return pa.RecordBatch.from_arrays(columns, names=["item_id", "label", "top", "total"])

    schema = "item_id string, label string, top double, total double"
    parts = _over_labels(items, labels, vector, block_bytes, row, schema)
    best = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            best = best.unionByName(part)
        best = best.groupBy("item_id").agg(
            F.max_by("label", F.struct("top", "label")).alias("label"),
            F.max("top").alias("top"),
            F.collect_list(F.struct("top", "total")).alias("blocks"),
        )
        total = F.aggregate("blocks", F.lit(0.0), lambda t, b: t + b["total"] * F.exp(b["top"] - F.col("top")))
        best = best.withColumn("total", total)
    return best.select("item_id", "label", (1 / F.col("total")).alias("probability"))
