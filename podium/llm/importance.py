"""Importance resampling towards a target distribution.

Features are runs of words, hashed into buckets. Two tables of fixed size count the buckets of the corpus
and of the target; they give every bucket a gain, and a document weighs the sum of its features'
gains. Noise of a hash of the id turns the weights into a draw without replacement: the highest scores
are drawn. Which score is the last one to be drawn is found by quickselect over the stored
scores: random pivot keys, exact counts of the rows below, at and above each of them, and again
between the two pivots around the wanted place. Only the drawn rows are sorted, in ranges.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm import tables
from podium.llm.common import blocks, group_rows, text_bytes
from podium.operators.topk import numbered
from podium.session import materialize, ship_package


@dataclass(frozen=True)
class ResamplingConfig:
    longest: int = 1  # words of a feature, at most
    buckets: int = 10_000
    percent: int = 10  # of the documents with ``least_words`` are drawn
    least_words: int = 20
    seed: int = 2024
    pivots: int = 8  # of a round of the selection


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: Features that are hashed side by side, and bytes up to which one is.
_SLICE, _SHORT = 200_000, 64


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (value & np.uint32(1)))
    return value


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each range of bytes; all ranges go on by one byte at a time, the long ones alone."""
    out = np.zeros(len(starts), np.uint32)
    lengths = stops - starts
    for begin in range(0, len(starts), _SLICE):
        size = lengths[begin : begin + _SLICE]
        order = np.argsort(-size, kind="stable")
        size, first = size[order], starts[begin : begin + _SLICE][order]
        state = np.full(len(size), 0xFFFFFFFF, np.uint32)
        for step in range(min(int(size[0]), _SHORT)):
            live = int(np.searchsorted(-size, -step))  # those longer than step come first
            now = state[:live]
            state[:live] = _CRC[(now ^ data[first[:live] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
        out[begin + order] = ~state
    for at in np.flatnonzero(lengths > _SHORT).tolist():
        out[at] = zlib.crc32(data[starts[at] : stops[at]])
    return out


def _word_ranges(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, the first byte and the end of each word, and the number of words of each text."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    solid = _WORD[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, starts, stops, np.diff(np.searchsorted(starts, offsets))


def features(texts: pa.Array, longest: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its numbers of words and of features, and the buckets of all features, text by text."""
    data, starts, stops, words = _word_ranges(texts)
    if longest == 1:
        return words, words, crc32s(data, starts, stops).astype(np.int64) % n_buckets
    # the words one after the other, with one space behind each
    sizes = stops - starts + 1
    ends = np.cumsum(sizes)
    joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inside = np.arange(len(joined)) - np.repeat(ends - sizes, sizes)
    solid = inside < np.repeat(sizes - 1, sizes)
    joined[solid] = data[(np.repeat(starts, sizes) + inside)[solid]]
    rows, last = group_rows(words), np.cumsum(words)[group_rows(words)]
    found_rows, found = [], []
    for size in range(1, longest + 1):
        at = np.arange(len(starts))
        at = at[at + size <= last]
        found_rows.append(rows[at])
        found.append(crc32s(joined, (ends - sizes)[at], ends[at + size - 1] - 1).astype(np.int64) % n_buckets)
    every = np.concatenate(found_rows)
    order = np.argsort(every, kind="stable")
    return words, np.bincount(every, minlength=len(texts)).astype(np.int64), np.concatenate(found)[order]


def bucket_counts(rows: DataFrame, text_column: str, config: ResamplingConfig) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    size = -(-config.buckets // 4096) * 4096

    def count(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            for block in blocks([batch], text_column):
                held += np.bincount(features(block.column(text_column), config.longest, config.buckets)[2], minlength=size)
        yield tables.partial(held)

    ship_package(rows.sparkSession)
    return tables.total(rows.select(text_column).mapInArrow(count, tables.SHAPE), size, "i8")[: config.buckets]


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more frequent a bucket is in the target, rounded down."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in pairs], np.int64)


def weighed(documents: DataFrame, gains: np.ndarray, config: ResamplingConfig, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    table = documents.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def weigh(batches):
        for batch in batches:
            for block in blocks([batch], "text"):
                words, counts, found = features(block.column("text"), config.longest, config.buckets)
                sums = np.concatenate([[0], np.cumsum(table.value[found])])
                ends = np.cumsum(counts)
                columns = [block.column("doc_id"), pa.array(words), pa.array(counts), pa.array(sums[ends] - sums[ends - counts])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel variable of the id, rounded down; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296
    return F.floor(-1000 * F.ln(-F.ln(uniform)))


def _literal(key: list[str], values: tuple[int, ...]) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(name) for name, v in zip(key, values)))


def kth_key(rows: DataFrame, key: list[str], k: int, pivots: int) -> tuple[int, ...]:
    """The ``k``-th smallest (from 1) of the keys, which are whole numbers without nulls and no two alike.

    Each round draws pivots among the rows that are left, counts exactly how many of these are below and at
    each pivot, and keeps those between the two pivots around the k-th. What is left is stored for the next round,
    so all rounds together read little more than the first; the driver sees pivots and counts only.
    """
    below = lambda p: F.struct(*key) < _literal(key, p)
    at = lambda p: F.struct(*key) == _literal(key, p)
    left, turn = rows.select(*key), 0
    while True:
        drawn = left.orderBy(F.xxhash64(F.lit(turn), *key), *key).limit(pivots).collect()
        drawn = sorted(tuple(r) for r in drawn)
        counted = left.agg(*(F.count_if(test(p)) for p in drawn for test in (below, at))).first()
        low, high, before = None, None, 0
        for p, less, equal in zip(drawn, counted[::2], counted[1::2]):
            if less < k <= less + equal:
                return p
            if k <= less:
                high = p
                break
            low, before = p, less + equal
        if low is not None:
            left = left.where(~below(low) & ~at(low))
        if high is not None:
            left = left.where(below(high))
        left, k, turn = materialize(left, "selection"), k - before, turn + 1


def resample(
    documents: DataFrame,
    target: DataFrame,
    config: ResamplingConfig = ResamplingConfig(),
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1 is the highest score; null if not drawn).

    Words are lower-cased (A-Z only) runs of digits, ASCII letters and anything beyond ASCII. A null or empty text has no
    features, weight 0 and is never drawn. Equal scores rank by the smaller id, a null id last, then by more features;
    rows that are alike in all of these rank in any order, so repeated rows are drawn one by one. Without a target text every bucket
    is as rare in it as any other; without documents there are no rows. Other columns are ignored. A text is held whole,
    with some ten bytes for each of its own. Counts, scores and the selection run when this is called.
    """
    corpus = bucket_counts(documents, text_column, config)
    gains = bucket_gains(corpus, bucket_counts(target, target_column, config))
    scored = weighed(documents, gains, config, id_column, text_column)
    scored = scored.withColumn("score", F.col("weight") + noise(config.seed, F.col("doc_id")))
    key = {
        "by_score": -F.col("score"),
        "by_id": F.coalesce("doc_id", F.lit(2**63 - 1)),
        "by_features": -F.col("n_features"),
        "by_place": F.monotonically_increasing_id(),  # stored, so that it stays
    }
    scored = materialize(scored.withColumns(key), "scores")
    enough = scored.where(F.col("n_words") >= config.least_words)
    count = enough.count() * config.percent // 100
    result = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not count:
        return scored.select(*result, unranked)
    last = _literal(list(key), kth_key(enough, list(key), count, config.pivots))
    drawn = (F.col("n_words") >= config.least_words) & (F.struct(*key) <= last)
    ranked = numbered(scored.where(drawn), [F.asc(c) for c in key], "rank")
    return scored.where(~drawn).select(*result, unranked).union(ranked.select(*result, F.col("rank").cast("long")))
