"""Mixing documents to target weights of soft domains.

A softmax classifier over hashed words and the style of the writing, learned from a labelled table,
gives each document a posterior over the domains. The expected tokens of a domain are the sum of rate x tokens x posterior over all
documents. Projected gradient descent finds rates of at least 0 that bring these sums to the
targets, in weighted least squares. A document's rate follows from its posterior and the gradients
of all steps, which are a few numbers each; a step is one aggregation over the stored posteriors. Step lengths are
those of Barzilai and Borwein, the long and the short one by turns, which follow from the last step and the change of the
gradient. Targets that are not reached are reported.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import blocks, group_rows, sums_per_group, text_bytes
from podium.llm.features import content_words, distinct_buckets
from podium.session import materialize, ship_package


@dataclass(frozen=True)
class MixConfig:
    sample: int = 8000  # labelled rows to learn from, at most
    bucket_bits: int = 15
    chosen: int = 1000  # buckets that tell domains apart best
    epochs: int = 300  # over the whole sample
    decay: float = 1e-4
    steps: int = 200  # of projected gradient descent, at most
    stored: int = 20  # steps after which the rates reached are stored, so that later ones go on from them
    tolerance: float = 1e-3  # of the total tokens, in every domain
    seed: int = 7


@dataclass(frozen=True)
class Domains:
    names: list[str]
    rows: np.ndarray  # of the layer, for each bucket and style; -1 if it is not used
    layer: np.ndarray  # rows x domains
    bias: np.ndarray


def _softmax(logits: np.ndarray) -> np.ndarray:
    z = np.exp(logits - logits.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


_STYLES = 16
_KINDS = np.zeros((256, 2), np.int64)  # capital letters, punctuation
_KINDS[range(65, 91), 0] = 1
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum()], 1] = 1


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of words and of features, and all features.

    Features are the buckets of its words, and after them, in 16 bins each, the share of capital
    letters, of punctuation and of different words.
    """
    counts, hashes = content_words(texts)
    sizes, keys = distinct_buckets(counts, (hashes >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)
    data, offsets = text_bytes(texts)
    lengths = np.diff(offsets)
    shares = np.column_stack([sums_per_group(_KINDS[data], lengths) / np.maximum(lengths, 1)[:, None], sizes / np.maximum(counts, 1)])
    bins = np.minimum((_STYLES * np.sqrt(shares)).astype(np.int64), _STYLES - 1) + (1 << bits) + _STYLES * np.arange(3)
    return counts, sizes + 3, np.insert(keys, np.repeat(np.cumsum(sizes), 3), bins.ravel())


def learn_domains(documents: DataFrame, known: DataFrame, config: MixConfig = MixConfig()) -> Domains:
    """Learn from documents (doc_id, text) whose domain is in ``known`` (doc_id, domain).

    At most ``config.sample`` rows of ``known`` are used, drawn by a hash of doc_id; documents that are
    not there any more are not replaced. Only the distinct features of these documents reach the
    driver. The buckets with the largest chi-square against the domains are used, and all styles. Without a
    labelled document there are no domains. Null texts have no words; rows that repeat an id each count.
    """
    ship_package(documents.sparkSession)
    bits, n = config.bucket_bits, (1 << config.bucket_bits) + 3 * _STYLES
    known = known.where("domain is not null and doc_id is not null")
    total = known.count()
    # about twice the sample by a share of the hashes, then the sample by order
    most = int(-(2**63) + 2**64 * 2 * config.sample / total) if total > 2 * config.sample else 2**63 - 1
    known = known.select("doc_id", F.xxhash64("doc_id", F.lit(config.seed)).alias("draw"), "domain").where(F.col("draw") <= most)
    known = known.orderBy("draw", "doc_id", "domain").limit(config.sample)
    labelled = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "draw", "text", "domain")

    def count(batches):
        for batch in blocks(batches, "text"):
            _, sizes, keys = features(batch.column("text"), bits)
            cuts = np.split(keys.astype("<u4"), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("draw"), batch.column("domain"), pa.array([c.tobytes() for c in cuts], pa.binary())],
                ["doc_id", "draw", "domain", "keys"],
            )

    kind = dict(labelled.dtypes)["doc_id"]
    counted = labelled.mapInArrow(count, f"doc_id {kind}, draw long, domain string, keys binary")
    sample = counted.orderBy("draw", "doc_id", "keys").limit(config.sample).select("domain", "keys").collect()
    if not sample:
        return Domains([], np.full(n, -1), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    names = sorted({r["domain"] for r in sample})
    y = np.array([names.index(r["domain"]) for r in sample])
    sets = [np.frombuffer(r["keys"], "<u4") for r in sample]
    with_it = np.stack([np.bincount(np.concatenate([s for s, d in zip(sets, y) if d == k]), minlength=n) for k in range(len(names))])
    share = np.bincount(y) / len(y)
    expected = share[:, None] * with_it.sum(axis=0)
    chi = ((with_it - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) / np.maximum(1 - with_it.sum(axis=0) / len(y), 1e-3)
    chi[1 << bits :] = np.inf
    rows = np.full(n, -1)
    chosen = np.sort(np.argsort(-chi, kind="stable")[: config.chosen + 3 * _STYLES])
    rows[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sets), len(chosen) + 1), np.float32)
    x[:, -1] = 1
    for i, s in enumerate(sets):
        x[i, rows[s][rows[s] >= 0]] = 1
    layer = np.zeros((x.shape[1], len(names)), np.float32)
    first, second = np.zeros_like(layer), np.zeros_like(layer)
    target = np.eye(len(names), dtype=np.float32)[y]
    for epoch in range(1, config.epochs + 1):  # Adam over the whole sample
        slope = x.T @ (_softmax(x @ layer) - target) / len(x) + config.decay * layer
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        layer -= 0.05 * first / (1 - 0.9**epoch) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-6)
    return Domains(names, rows, layer[:-1], layer[-1])


def posteriors(documents: DataFrame, domains: Domains, text_column: str = "text") -> DataFrame:
    """The documents in a struct ``row``, with n_tokens (their words) and posterior, an array in the order of the names."""
    ship_package(documents.sparkSession)
    bits = (len(domains.rows) - 3 * _STYLES).bit_length() - 1
    sent = documents.sparkSession.sparkContext.broadcast(domains)
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    place = documents.columns.index(text_column)

    def run(batches):
        own = sent.value
        for batch in batches:
            whole = batch.column("row")
            part = pa.RecordBatch.from_arrays([whole, whole.field(place)], ["row", "text"])
            for piece in blocks([part], "text"):
                counts, sizes, keys = features(piece.column("text"), bits)
                if not own.names:
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(counts) + 1, np.int32)), pa.array(np.zeros(0)))
                    yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(counts), none], ["row", "n_tokens", "posterior"])
                    continue
                used = own.rows[keys]
                sizes = np.bincount(group_rows(sizes)[used >= 0], minlength=len(sizes))
                logits = sums_per_group(own.layer[used[used >= 0]], sizes) + own.bias
                found = _softmax(logits).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * len(own.names)), pa.array(found))
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(counts), lists], ["row", "n_tokens", "posterior"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, posterior array<double>")


def _dot(posterior: Column, step: Column) -> Column:
    return F.aggregate(F.zip_with(posterior, step, lambda p, s: p * s), F.lit(0.0), lambda a, b: a + b)


def rate_of(posterior: Column, steps: list[list[float]], first: Column | None = None) -> Column:
    """The rate after all steps: from ``first`` or 1, each takes off the posterior times its gradient, down to 0 at least."""
    rate = F.lit(1.0) if first is None else first
    if not steps:
        return rate
    taken = F.array(*(F.array(*(F.lit(float(g)) for g in step)) for step in steps))
    return F.aggregate(taken, rate, lambda r, g: F.greatest(F.lit(0.0), r - _dot(posterior, g)))


def fit_rates(weighed: DataFrame, targets: list[float], config: MixConfig = MixConfig()) -> list[list[float]]:
    """The steps of projected gradient descent on rows (n_tokens, posterior) towards shares of all tokens.

    Minimises the squared differences of expected and wanted tokens of each domain, over the tokens that
    the domain has at rate 1. Ends within the tolerance, or where the rates do not move any more, or after ``config.steps``;
    if the tolerance is not met, the steps to the smallest difference are given, with a warning that says what they reach.
    Without tokens or targets above 0 there is nothing to do.
    """
    k, total = len(targets), sum(targets)
    p = [F.col("posterior")[d] for d in range(k)]
    first = weighed.agg(
        F.sum("n_tokens").alias("all"),
        *(F.sum(p[d] * F.col("n_tokens")).alias(f"m{d}") for d in range(k)),
        *(F.sum(p[d] * p[e] * F.col("n_tokens")).alias(f"g{d}_{e}") for d in range(k) for e in range(d + 1)),
    ).first()
    if not first["all"] or total <= 0:
        return []
    share = np.array(targets, float) / total
    usual = np.maximum(np.array([first[f"m{d}"] for d in range(k)]) / first["all"], 1e-9)
    gram = np.array([[first[f"g{max(d, e)}_{min(d, e)}"] for e in range(k)] for d in range(k)]) / first["all"]
    scale = 1 / np.sqrt(usual)
    pace = 1 / np.linalg.eigvalsh(scale[:, None] * gram * scale).max()
    rows, done, steps = weighed.select("n_tokens", "posterior", F.lit(1.0).alias("rate")), 0, []
    reached, best, closest = usual, 0, usual
    while len(steps) < config.steps and np.abs(reached - share).max() > config.tolerance:
        steps.append((pace * (reached - share) / usual).tolist())
        before = rate_of(F.col("posterior"), steps[done:-1], F.col("rate"))
        moved = rows.select("n_tokens", "posterior", before.alias("before"))
        last = F.array(*map(F.lit, steps[-1]))
        moved = moved.select("*", F.greatest(F.lit(0.0), F.col("before") - _dot(F.col("posterior"), last)).alias("rate"))
        if len(steps) - done == config.stored:
            moved, done = materialize(moved, "rates"), len(steps)
            rows = moved.drop("before")
        now = moved.agg(
            *(F.sum(p[d] * F.col("n_tokens") * F.col("rate")).alias(f"m{d}") for d in range(k)),
            F.sum(F.col("n_tokens") * (F.col("rate") - F.col("before")) ** 2).alias("length"),
        ).first()
        change, reached = -reached, np.array([now[f"m{d}"] for d in range(k)]) / first["all"]
        change += reached
        if np.abs(reached - share).max() < np.abs(closest - share).max():
            best, closest = len(steps), reached
        slope = change / usual
        along, across = change @ slope, slope @ gram @ slope
        if along <= 1e-18 or across <= 0:
            break
        pace = now["length"] / first["all"] / along if len(steps) % 2 else along / across
    if np.abs(closest - share).max() > config.tolerance:
        warnings.warn(f"no rates found that bring the shares of tokens to {share.tolist()}; reached: {closest.tolist()}", stacklevel=2)
    return steps[:best]


def mix_sources(
    documents: DataFrame,
    known: DataFrame,
    targets: Mapping[str, float],
    config: MixConfig = MixConfig(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The documents in a struct ``row``, with n_tokens, posterior, rate and copies.

    ``targets`` gives each domain of ``known`` (doc_id, domain) its share of all tokens; a domain that
    is not named has none. Without documents there are no rows; without any known domain all rates are 1 and posteriors empty. ``copies`` is the rate rounded up or down by a hash of the id, with the
    rate as its mean. A null or empty text has no tokens and the classifier's prior; rows without an
    id share one rounding, and so do rows that repeat an id.
    """
    own = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    if documents.isEmpty():
        return posteriors(documents, Domains([], np.zeros(0, int), np.zeros((0, 0)), np.zeros(0)), text_column).withColumns(
            {"rate": F.lit(1.0), "copies": F.lit(1)}
        )
    domains = learn_domains(own, known, config)
    found = materialize(posteriors(documents, domains, text_column), "posteriors")
    goal = [targets.get(d, 0.0) for d in domains.names]
    steps = fit_rates(found.select("n_tokens", "posterior"), goal, config)
    rated = found.withColumn("rate", rate_of(F.col("posterior"), steps))
    draw = F.pmod(F.xxhash64(F.col("row")[id_column], F.lit(config.seed)), F.lit(1_000_003)) / F.lit(1_000_003)
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.withColumn("copies", copies)


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) for labels (doc_id, quality, toxic): toxic, and else good or poor by quality; null if neither is known."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))
