"""Language of a text by averaged embeddings of hashed subwords and a linear softmax.

A text is lower-cased; everything but letters becomes a space, and runs of spaces one. Its
subwords are all sequences of 2, 3 and 4 bytes of the rest, hashed into ``buckets``. The mean of
their embeddings goes through a linear layer and a softmax. Embeddings and layer are learned by
stochastic gradient descent on a bounded sample of labelled rows. Besides the languages there is a class for
what is none of them: texts with their letters shuffled, and subwords drawn at random. Another part of the sample sets
the temperature of the softmax, and the chance to be in any language below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import blocks, sums_per_group, text_bytes
from podium.session import ship_package

SIZES = (2, 3, 4)


@dataclass(frozen=True)
class LanguageConfig:
    sample: int = 3000  # labelled rows to learn from, at most
    calibrate: int = 4  # every fourth of them sets temperature and threshold instead
    bucket_bits: int = 14
    width: int = 16
    epochs: int = 12
    batch: int = 64
    rate: float = 2.0
    seed: int = 11
    shuffled: int = 3  # every third row of the sample is shuffled too; as many rows are drawn at random
    reject_share: float = 0.002  # of the calibration rows, at most
    reject_below: float = 0.5  # never rejected from this chance on


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x (languages, none of them): embeddings times layer
    bias: np.ndarray
    temperature: float
    reject_below: float


_FOLD = np.full(256, 32, np.uint8)
_FOLD[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts with one space for everything between letters; where each begins.

    Bytes above 127 count as letters, which most of them are. Each text begins with a space.
    """
    lowered = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), "")
    data, offsets = text_bytes(lowered)
    data = _FOLD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def subwords(data: np.ndarray, bucket_bits: int) -> Iterator[np.ndarray]:
    """For each size, the bucket of the subword that begins at each byte; the last bytes have none."""
    value = data.astype(np.uint32)
    for size in range(2, max(SIZES) + 1):
        value = value[:-1] * np.uint32(257) + data[size - 1 :] if len(value) else value
        if size in SIZES:
            yield (value * np.uint32(2654435769) + np.uint32(size) * np.uint32(40503)) * np.uint32(2246822519) >> np.uint32(
                32 - bucket_bits
            )


def _inside(offsets: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many subwords of each text end inside it; n: of all texts together."""
    return np.maximum(np.minimum(offsets[1:], n) - offsets[:-1] - (size - 1), 0)


def mean_logits(texts: pa.Array, table: np.ndarray, bucket_bits: int) -> np.ndarray:
    data, offsets = folded(texts)
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    lengths = np.diff(offsets)
    for size, found in zip(SIZES, subwords(data, bucket_bits)):
        rows = np.repeat(np.arange(len(texts)), lengths)[: len(found)]
        inside = np.arange(len(found)) + size <= offsets[1:][rows]
        counts = np.bincount(rows[inside], minlength=len(texts))
        total += sums_per_group(table[found[inside]], counts)
        count += counts
    return total / np.maximum(count, 1)[:, None]


def _shares(data: np.ndarray, n: int) -> tuple[bytes, bytes]:
    """The buckets of a text's subwords, and how often each occurs, scaled if that is more than 16 bits hold."""
    found = sum(np.bincount(x, minlength=n) for x in subwords(data, n.bit_length() - 1))
    keys = np.flatnonzero(found)
    times = np.ceil(found[keys] / max(1.0, found.max() / 65535))
    return keys.astype("<u4" if n > 65536 else "<u2").tobytes(), times.astype("<u2").tobytes()


def _counted(labelled: DataFrame, config: LanguageConfig) -> DataFrame:
    """For each row (draw, doc_id, lang, text), its buckets and how often each occurs; for some also those of its letters shuffled."""
    n = 2**config.bucket_bits

    def count(batches):
        for batch in blocks(batches, "text"):
            data, offsets = folded(batch.column("text"))
            plain, mixed = [], []
            for draw, a, b in zip(batch.column("draw").to_pylist(), offsets[:-1], offsets[1:]):
                plain.append(_shares(data[a:b], n))
                dice = np.random.default_rng(draw % 2**63)
                mixed.append(_shares(dice.permutation(data[a:b]), n) if draw % config.shuffled == 0 else (None, None))
            columns = [pa.array(c, pa.binary()) for c in (*zip(*plain), *zip(*mixed))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *columns], ["draw", "doc_id", "lang", "keys", "times", "shuffled_keys", "shuffled_times"]
            )

    kind = dict(labelled.dtypes)["doc_id"]
    return labelled.mapInArrow(
        count, f"draw long, doc_id {kind}, lang string, keys binary, times binary, shuffled_keys binary, shuffled_times binary"
    )


def _softmax(logits: np.ndarray) -> np.ndarray:
    z = np.exp(logits - logits.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Learn from rows (text, lang) with both; ``labelled`` also has a unique ``doc_id`` to draw by.

    The ``config.sample`` rows with the smallest hash of ``doc_id`` are taken; only their subword
    counts, at most ``2 ** bucket_bits`` pairs each, reach the driver. Rows without a language or any subword
    are left out. Without rows the model knows no language, and every text is ``und``; with one language,
    a text is in it or rejected. Equal ids are ordered by their counts; repeated rows count as often as they are.
    """
    ship_package(labelled.sparkSession)
    labelled = labelled.where("lang is not null")
    number = labelled.select("doc_id").count()
    # about twice the sample by a share of the hashes, then the sample by order
    most = int(-(2**63) + 2**64 * 2 * config.sample / number) if number > 2 * config.sample else 2**63 - 1
    drawn = labelled.select(F.xxhash64(F.col("doc_id"), F.lit(config.seed)).alias("draw"), "doc_id", "lang", "text")
    drawn = _counted(drawn.where(F.col("draw") <= most), config)
    drawn = drawn.orderBy("draw", "doc_id", "keys").limit(config.sample).drop("draw", "doc_id")
    kind = "<u4" if config.bucket_bits > 16 else "<u2"
    rows, shuffled = [], []
    for r in drawn.collect():
        if r["keys"]:
            rows.append((r["lang"], np.frombuffer(r["keys"], kind), np.frombuffer(r["times"], "<u2")))
            if r["shuffled_keys"]:
                shuffled.append((None, np.frombuffer(r["shuffled_keys"], kind), np.frombuffer(r["shuffled_times"], "<u2")))
    n, languages = 2**config.bucket_bits, sorted({r[0] for r in rows})
    k = len(languages)
    if not k:
        return LanguageModel([], np.zeros((n, 1), np.float32), np.zeros(1, np.float32), 1.0, config.reject_below)
    rng = np.random.default_rng(config.seed)

    def foreign(number: int) -> list:
        """Rows of buckets drawn at random, half of them as many as some row of the sample has, half a few."""
        sizes = [len(rows[i][1]) if i % 2 else 1 + i % 30 for i in rng.integers(0, len(rows), number)]
        return [(None, rng.integers(0, n, size), rng.geometric(0.5, size)) for size in sizes]

    def dense(some: list) -> np.ndarray:
        x = np.zeros((len(some), n), np.float32)
        for i, (_, keys, times) in enumerate(some):
            np.add.at(x[i], keys, times / times.sum())
        return x

    place = {lang: i for i, lang in enumerate(languages)} | {None: k}
    held = lambda kept: [r for i, r in enumerate(kept) if i % config.calibrate == 0] if len(rows) >= 8 * config.calibrate else kept
    used = lambda kept: [r for i, r in enumerate(kept) if i % config.calibrate] if len(rows) >= 8 * config.calibrate else kept
    embed = rng.normal(0, 0.1, (n, config.width)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (config.width, k + 1)).astype(np.float32), np.zeros(k + 1, np.float32)
    learned, outside = used(rows), used(shuffled)
    for epoch in range(config.epochs):
        step = config.rate * (1 - epoch / config.epochs)
        all_rows = learned + outside + foreign(len(learned) // config.shuffled + 1)
        y = np.array([place[r[0]] for r in all_rows])
        weight = len(y) / ((k + 1) * np.maximum(np.bincount(y, minlength=k + 1), 1))  # all classes weigh the same
        order = rng.permutation(len(y))
        for some in np.array_split(order, max(1, len(order) // config.batch)):
            x = dense([all_rows[i] for i in some])
            hidden = x @ embed
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(some)), y[some]] -= 1
            error = (error * weight[y[some]][:, None] / len(some)).astype(np.float32)
            back = error @ layer.T
            layer -= step * hidden.T @ error
            bias -= step * error.sum(axis=0)
            embed -= step * len(some) * (x.T @ back)
    table = embed @ layer
    own, others = held(rows), held(shuffled)
    check = own + others + foreign(len(others) + 1)
    y = np.array([place[r[0]] for r in check])
    logits = np.concatenate([dense(check[i : i + config.batch]) @ table for i in range(0, len(check), config.batch)]) + bias
    losses = {t: -np.log(_softmax(logits / t)[np.arange(len(check)), y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 61)}
    temperature = min(losses, key=lambda t: (round(losses[t], 6), abs(np.log(t))))
    scores = np.sort(1 - _softmax(logits[: len(own)] / temperature)[:, k])
    threshold = min(config.reject_below, float(scores[int(config.reject_share * len(scores))]))
    return LanguageModel(languages, table.astype(np.float32), bias, float(temperature), threshold)


def identified(documents: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The documents in a struct ``row``, with lang_pred, score (0 to 1) and rejected.

    A text that is null, empty or without letters is ``und`` with score 0 and rejected; so is, under its
    best language, one whose calibrated chances of all languages together are below the model's threshold. Equal scores give the
    first language by name. A model without languages gives ``und`` for all. Texts of any length count whole, and repeated rows are all kept.
    """
    ship_package(documents.sparkSession)
    bits, place = int(len(model.table)).bit_length() - 1, documents.columns.index(text_column)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.struct(*documents.columns).alias("row"))

    def predict(batches):
        own = sent.value
        for batch in batches:
            whole = batch.column("row")
            part = pa.RecordBatch.from_arrays([whole, whole.field(place)], ["row", "text"])
            for piece in blocks([part], "text", 2_000_000):
                texts = pc.fill_null(piece.column("text"), "")
                chances = _softmax((mean_logits(texts, own.table, bits) + own.bias) / own.temperature)
                best = chances[:, : len(own.languages)].argmax(axis=1) if own.languages else np.zeros(len(texts), int)
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) & bool(own.languages)
                score = np.where(letters, chances[np.arange(len(best)), best], 0.0)
                named = pa.array(np.where(letters, np.array([*own.languages, "und"], object)[best], "und"), pa.string())
                rejected = pa.array(~letters | (1 - chances[:, -1] < own.reject_below))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), named, pa.array(score), rejected], ["row", "lang_pred", "score", "rejected"]
                )

    shape = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(predict, shape)


def identify(documents: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected, as in ``identified``; other columns are ignored."""
    found = identified(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), model)
    return found.select("row.doc_id", "lang_pred", "score", "rejected")


def learning_rows(documents: DataFrame) -> DataFrame:
    """The rows that predictions may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return documents.where("lang is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
