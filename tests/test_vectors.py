import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from podium.config import FieldSpec
from podium.functions import text
from podium.functions import vectors as V
from podium.operators import embed as E

# Workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(df):
    return df.first()[0]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_similarities(spark):
    df = rows(spark, [([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = df.select(V.inner_product("a", "b"), V.norm("a"), V.cosine_similarity("a", "b"), V.cosine_similarity("a", "z")).first()
    assert tuple(got) == (24.0, 5.0, 0.96, 0.0)
    assert df.select(V.l2_normalize("a"), V.l2_normalize("z")).first() == ([0.6, 0.8], [0.0, 0.0])


def test_renormalize(spark):
    df = rows(spark, [([0.9, 0.1, 0.0],), ([0.0],)], "w array<double>")
    assert [r[0] for r in df.select(V.renormalize("w")).collect()] == [[0.9, 0.1, 0.0], None]


def test_pooling(spark):
    data = [(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[5.0, 5.0]], [0])]
    df = rows(spark, data, "id int, tokens array<array<float>>, mask array<int>").sort("id")
    pooled = df.select(V.mean_pool("tokens", "mask").alias("p"), V.cls_pool("tokens").alias("c")).collect()
    assert [r.p for r in pooled] == [[2.0, 3.0], None] and pooled[0].c == [1.0, 2.0]
    long = df.select("id", F.explode(F.arrays_zip("tokens", "mask")).alias("t")).select("id", "t.tokens", "t.mask")
    assert {r.id: r.embedding for r in V.mean_pool_long(long, "id", "tokens", "mask").collect()} == {1: [2.0, 3.0]}


def test_masked_field_equals_dropped_field(spark):
    df = rows(spark, [([1.0, 0.0], None), ([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    both = [FieldSpec("a", weight=0.9), FieldSpec("b", weight=0.1)]
    fused = [r[0] for r in df.select(V.fuse_fields(["a", "b"], text.field_weights(df, both))).collect()]
    assert fused[0] == [1.0, 0.0]
    assert fused[1] == pytest.approx([0.9 / math.hypot(0.9, 0.1), 0.1 / math.hypot(0.9, 0.1)])


def test_field_weights(spark):
    df = rows(spark, [("x", None, 1.0), (None, "y", float("nan"))], "a string, b string, c double")
    fields = [FieldSpec("a", weight=0.5), FieldSpec("b", weight=0.3), FieldSpec("c", weight=0.2)]
    got = [r[0] for r in df.select(text.field_weights(df, fields)).collect()]
    assert got[0] == pytest.approx([0.5 / 0.7, 0, 0.2 / 0.7]) and got[1] == pytest.approx([0.625, 0.375, 0])
    nothing = df.select(text.field_weights(df, [FieldSpec("a", weight=0), FieldSpec("b", weight=1)]))
    assert [r[0] for r in nothing.collect()] == [None, [0.0, 1.0]]


class Lengths:
    """Encodes a text or image as its length and 1."""

    dim = 2

    def __init__(self, key):
        self.key = key

    def load(self):
        assert self.key != "broken"
        return lambda values: np.array([[len(v), 1.0] for v in values])


def unit(*numbers):
    return [x / math.hypot(*numbers) for x in numbers]


def test_embed_fuses_fields_and_masks(spark):
    data = [(1, "abc", bytearray(b"12345")), (2, "abcd", None), (3, None, bytearray(b"1"))]
    df = rows(spark, data, "id int, title string, image binary")
    fields = [FieldSpec("title", "txt", 0.5), FieldSpec("image", "img", 0.5)]
    encoders = {"txt": Lengths("t"), "img": Lengths("i")}
    got = {r.id: r.embedding for r in E.embed(df, "id", fields, encoders, batch_size=2).collect()}
    a, b = unit(3, 1), unit(5, 1)
    assert got["1"] == pytest.approx(unit((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), abs=1e-6)
    assert got["2"] == pytest.approx(unit(4, 1), abs=1e-6)
    # A missing first text is the word nan, with its full weight.
    a, b = unit(3, 1), unit(1, 1)
    assert got["3"] == pytest.approx(unit((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), abs=1e-6)


def test_embed_counts_records_without_vector(spark):
    df = rows(spark, [(1, None, "x"), (2, None, None)], "id int, image binary, title string")
    fields = [FieldSpec("image", "img", 0.0), FieldSpec("title", "txt", 1.0)]
    vectors = E.embed(df, "id", fields, {"txt": Lengths("t"), "img": Lengths("i")})
    assert {r.id: r.embedding for r in vectors.collect()}["2"] is None
    assert tuple(E.count_missing(vectors).first()) == (2, 1)


def test_embed_truncates_only_when_asked(spark):
    df = rows(spark, [(1, "a bb ccc dddd")], "id int, t string")
    encoder = {"txt": Lengths("t")}
    assert one(E.embed(df, "id", [FieldSpec("t", max_tokens=2)], encoder).select("embedding")) == pytest.approx(unit(4, 1), abs=1e-6)
    assert one(E.embed(df, "id", [FieldSpec("t")], encoder).select("embedding")) == pytest.approx(unit(13, 1), abs=1e-6)


def test_batch_size_changes_nothing(spark):
    df = rows(spark, [(i, f"word{i} other words {i % 3}") for i in range(50)], "id int, t string").repartition(3)
    small = E.embed(df, "id", [FieldSpec("t")], {"txt": E.HashedNgrams(16)}, batch_size=3)
    large = E.embed(df, "id", [FieldSpec("t")], {"txt": E.HashedNgrams(16)}, batch_size=1000)
    assert sorted(small.collect()) == sorted(large.collect())


ITEMS = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.6, 0.8]}
LABELS = {"x": [1.0, 0.0], "y": [0.0, 1.0], "z": [0.7, 0.7]}


@pytest.mark.parametrize("block_bytes", [10**6, 16])
def test_zero_shot(spark, block_bytes):
    """One block of labels, and one label per block."""
    items = rows(spark, list(ITEMS.items()), "item_id string, embedding array<float>")
    labels = rows(spark, list(LABELS.items()), "label string, embedding array<float>")
    scores = E.scaled_scores(items, labels, 10, block_bytes=block_bytes)
    probabilities = {(r.item_id, r.label): r.probability for r in E.label_softmax(scores).collect()}
    best = {r.item_id: (r.label, r.probability) for r in E.classify(items, labels, 10, block_bytes=block_bytes).collect()}
    for item, v in ITEMS.items():
        weights = {label: math.exp(10 * float(np.dot(np.float32(v), np.float32(w)))) for label, w in LABELS.items()}
        for label, weight in weights.items():
            assert probabilities[item, label] == pytest.approx(weight / sum(weights.values()), rel=1e-6)
        top = max(weights, key=weights.get)
        assert best[item] == (top, pytest.approx(weights[top] / sum(weights.values()), rel=1e-6))
