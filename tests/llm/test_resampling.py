"""Importance resampling against a plain computation of the same draw."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from podium.llm import importance
from podium.llm.importance import ResamplingConfig

CONFIG = ResamplingConfig(buckets=50, percent=30, least_words=3)


def grams(text, longest):
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def plain(rows, target, config):
    count = lambda texts: np.bincount(
        [zlib.crc32(g.encode()) % config.buckets for t in texts for g in grams(t, config.longest)[1]], minlength=config.buckets
    )
    s, t = count([r[1] for r in rows]), count(target)
    gain = [
        math.floor(1000 * math.log((int(b) + 1.0) * (int(s.sum()) + config.buckets) / ((int(a) + 1.0) * (int(t.sum()) + config.buckets))))
        for a, b in zip(s, t)
    ]
    out = []
    for doc_id, text in rows:
        words, features = grams(text, config.longest)
        weight = sum(gain[zlib.crc32(g.encode()) % config.buckets] for g in features)
        h = int(hashlib.sha256(f"{config.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, score, len(words) >= config.least_words])
    enough = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for place, row in enumerate(enough[: len(enough) * config.percent // 100], 1):
        row[4] = place
    return [(*r[:4], None if isinstance(r[4], bool) else r[4]) for r in out]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, odd_rows, odd_documents, longest):
    config = ResamplingConfig(longest=longest, buckets=50, percent=30, least_words=3, pivots=2)
    target = spark.createDataFrame([(1, odd_rows[0][1][:90]), (2, None), (3, "")], "item_id long, text string")
    found = importance.resample(odd_documents, target, config).collect()
    assert ordered(found) == ordered(plain(odd_rows, [odd_rows[0][1][:90], None, ""], config))


def test_ties_and_copies(spark):
    """One id and text in a third of all rows: each copy is drawn on its own, up to the exact number."""
    rows = [(7, "same words in every copy")] * 100 + [(k, f"word{k} is another text") for k in range(200)] + [(None, "no id here at all")] * 9
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = importance.resample(frame, frame.limit(3), CONFIG)
    target = [r.text for r in frame.limit(3).collect()]
    assert ordered(found.collect()) == ordered(plain(rows, target, CONFIG))
    assert sorted(r.rank for r in found.where("rank is not null").collect()) == list(range(1, 309 * 30 // 100 + 1))


def test_empty_tables(spark, odd_documents, no_documents, odd_rows):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(no_documents, target, CONFIG).collect() == []
    assert ordered(importance.resample(odd_documents, target, CONFIG).collect()) == ordered(plain(odd_rows, [], CONFIG))
    none = importance.resample(odd_documents, target, ResamplingConfig(least_words=10**9)).collect()
    assert len(none) == len(odd_rows) and all(r["rank"] is None for r in none)


@pytest.mark.parametrize("pivots", [1, 3, 8])
def test_selection(spark, pivots):
    dice = random.Random(pivots)
    keys = [(dice.choice([0, 0, 0, dice.randint(-5, 5)]), dice.randint(0, 3), k) for k in range(500)]
    frame = spark.createDataFrame(keys, "a long, b long, place long").repartition(4)
    for k in (1, 2, 250, 499, 500):
        assert importance.kth_key(frame, ["a", "b", "place"], k, pivots) == sorted(keys)[k - 1]


def test_crc32_of_long_and_short_ranges():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    starts = np.array([0, 3, 10, 100, 4999, 70])
    stops = np.array([1, 9, 5000, 164, 5000, 135])
    assert importance.crc32s(data, starts, stops).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, stops)]


def test_features_stay_inside_their_text():
    texts = pa.array(["ab", None, "ab", "", "c d", "É_x9", "\x00a\x7f{b"])
    words, counts, found = importance.features(texts, 2, 2**31)
    assert words.tolist() == [1, 0, 1, 0, 2, 2, 2] and counts.tolist() == [1, 0, 1, 0, 3, 3, 3]
    expected = [zlib.crc32(g.encode()) % 2**31 for g in ["ab", "ab", "c", "d", "c d", "É", "x9", "É x9", "a", "b", "a b"]]
    assert found.tolist() == expected
