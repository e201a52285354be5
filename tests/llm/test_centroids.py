"""Centroid clustering against a plain computation of every distance."""

import hashlib
import math
import random

import numpy as np
import pytest

from podium.llm import centroids
from podium.llm.centroids import ClusterConfig
from podium.llm.queries import QUERIES


def plain(rows, config):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == config.width and all(v is not None and abs(v) < centroids.LIMIT / config.scale for v in x):
            kept.append((vec_id, [math.floor(config.scale * float(v)) for v in x]))
    name = lambda i: hashlib.sha256(f"{config.seed}:{'' if i is None else i}".encode()).hexdigest()
    now = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))][: config.clusters]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((apart(v, c), k) for k, c in enumerate(now)) for _, v in kept]
    for _ in range(config.rounds):
        members = [[v for (_, v), (_, c) in zip(kept, found) if c == k] for found in [assign()] for k in range(len(now))]
        now = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, now)]
    found = assign()
    inertia = [sum(d for d, c in found if c == k) for k in range(len(now))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, found)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def vectors(n, width, seed):
    dice = random.Random(seed)
    rows = [(k, [dice.choice([-1.0, 0.5, 1.0, dice.uniform(-2, 2)]) for _ in range(width)]) for k in range(n)]
    same = [dice.uniform(-1, 1) for _ in range(width)]
    odd = [None, [], [1.0] * (width - 1), [None] + [1.0] * (width - 1), [math.nan] * width, [math.inf] + [0.0] * (width - 1), [3e38] * width]
    return rows + [(n + k, same) for k in range(n // 2)] + [(5, same), (None, same), (None, rows[0][1])] + [(900 + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize("config", [ClusterConfig(6, 4, 3, 4, 2, 3), ClusterConfig(6, 4, 3, 4, 2, 1), ClusterConfig(400, 2, 2, 256, 9, 12)])
def test_odd_rows(spark, config):
    rows = vectors(60, config.width, config.clusters)
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]  # as floats
    assert ordered(centroids.cluster(frame.repartition(4), config).collect()) == ordered(plain(rows, config))


def test_nothing_kept(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert centroids.cluster(frame).collect() == [] and centroids.cluster(frame.where("false")).collect() == []


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert ordered(QUERIES["op12_centroid_clustering"](spark, sf_dir).collect()) == ordered(plain(rows, ClusterConfig()))


def test_bounds_spare_distances_and_lose_none():
    """Groups that lie apart: most centroids are left out, with the result of comparing all."""
    dice = np.random.default_rng(3)
    centres = dice.integers(-3000, 3000, (20, 8))
    found = np.repeat(centres, 50, axis=0) + dice.integers(-30, 30, (1000, 8))
    pivots = centroids.spread_pivots(centres, 6)
    far = np.stack([centroids.squared(found, p) for p in pivots], axis=1)
    number, best, spent = centroids.nearest(found, far, centres, pivots)
    every = ((found[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and spent < 0.25 * every.size
