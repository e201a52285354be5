import math

import pytest
from pyspark.sql import functions as F

from podium.config import EvalConfig, FieldSpec, TripletConfig, token_limit
from podium.functions import text
from podium.operators.sampling import sample_queries
from podium.operators.splits import score_linear, split_two_way, training_weights
from podium.operators.triplets import (
    add_query_id,
    attach_query_fields,
    check_weights,
    distinct_count,
    first_per_query,
    prepare_triplets,
    scale_weights,
)
from podium.operators.truth import build_qrels


def values(df, column):
    return [row[column] for row in df.collect()]


def one(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return df.select(expression.alias("out")).first()["out"]


def test_composite_query_id(spark):
    assert one(spark, text.composite_query_id("a", "b"), a="x", b="y") == "x_{!@#~}_y_{!@#~}_"
    assert one(spark, text.composite_query_id("a", "b"), a="x", b=None) is None


def test_text_expressions(spark):
    assert one(spark, text.basename_into("p", "/new/"), p="/a/b/c.jpg") == "/new/c.jpg"
    assert one(spark, text.basename_into("p", "/new"), p="/a/b/") == "/new/"
    assert one(spark, text.replace_prefix("p", "/in/", "/out/"), p="/in/x/in/y") == "/out/x/out/y"
    assert one(spark, text.role_prefix("p", "query"), p="shoes") == "query: shoes"
    assert one(spark, text.truncate_tokens("p", 2), p="  a \n b\tc ") == "a b"
    assert one(spark, text.truncate_tokens("p", 9), p=" a  b ") == "a b"
    assert one(spark, text.stringify("p"), p=None) == "nan"
    with pytest.raises(ValueError):
        text.role_prefix("p", "title")


def test_token_limit():
    assert (token_limit(50, 512), token_limit(0, 512), token_limit()) == (50, 512, 77)


def test_round_relevance_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.4999,)], "w double")
    assert values(df.select(text.round_relevance("w").alias("r")), "r") == [0, 2, 2, 3]


def scaled(spark, weights):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "id int, w double")
    return scale_weights(df, "w").sort("id")


@pytest.mark.parametrize(
    "weights, grades",
    [([1, 5, 10, 100], [1, 5, 10, 100]), ([2, 3, 5, 9], [1, 15, 43, 100]), ([4, 4], [1, 1]), ([None, None], [1, 1])],
)
def test_scale_weights(spark, weights, grades):
    assert values(scaled(spark, [None if w is None else float(w) for w in weights]), "weight") == grades


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_weight_is_an_error(spark, fails, missing):
    assert "missing weights" in fails(scaled(spark, [1.0, missing, 3.0]))


def test_weight_column(spark, fails):
    df = spark.createDataFrame([("a", 0)], "id string, w int")
    with pytest.raises(ValueError, match="not among"):
        scale_weights(df, "nope")
    assert values(scale_weights(df), "weight") == [1]
    assert "below 1" in fails(check_weights(df, "w"))


def test_scale_weights_by_group(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 7.0), ("b", 7.0)], "g string, w double")
    got = sorted((r.g, r.w, r.weight) for r in scale_weights(df, "w", by=("g",)).collect())
    assert got == [("a", 0.0, 1), ("a", 10.0, 100), ("b", 7.0, 1), ("b", 7.0, 1)]


def test_prepare_triplets(spark):
    df = spark.createDataFrame([("red shoe", 7, 1.0), ("hat", 8, 3.0)], "query string, product_id int, score_linear double")
    roles = TripletConfig((FieldSpec("query"),), (FieldSpec("title"),), "score_linear")
    got = sorted((r.query_id, r.doc_id, r.weight) for r in prepare_triplets(df, roles).collect())
    assert got == [("hat_{!@#~}_", "8", 100), ("red shoe_{!@#~}_", "7", 1)]
    assert values(add_query_id(df, query_id_key="product_id").sort("product_id"), "query_id") == ["7", "8"]


def test_distinct_count_takes_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "q string")
    assert values(distinct_count(df, "q"), "n") == [3]
    assert values(distinct_count(df.where("q is not null"), "q"), "n") == [2]


def test_first_per_query_and_fields(spark, fails):
    df = spark.createDataFrame([("q", 2, "late"), ("q", 1, "early"), ("r", 5, "only")], "query_id string, ord int, title string")
    first = first_per_query(df, ["ord"])
    assert sorted((r.query_id, r.title) for r in first.collect()) == [("q", "early"), ("r", "only")]
    queries = spark.createDataFrame([("q",), ("r",)], "query_id string")
    got = attach_query_fields(queries, first, ["title"])
    assert sorted(values(got, "title")) == ["early", "only"]
    unknown = attach_query_fields(queries.union(spark.createDataFrame([("s",)], "query_id string")), first, ["title"])
    assert "no row for query s" in fails(unknown)


def triplets(spark, n=40, weight=lambda i: 1):
    return spark.createDataFrame([(f"q{i}", f"d{i}", weight(i)) for i in range(n)], "query_id string, doc_id string, weight int")


def test_samples(spark, fails):
    df = triplets(spark)
    for method in ("weighted", "uniform"):
        once = {r.query_id for r in sample_queries(df, 10, method).collect()}
        again = {r.query_id for r in sample_queries(df.repartition(7), 10, method).collect()}
        other = {r.query_id for r in sample_queries(df, 10, method, seed=2).collect()}
        assert len(once) == 10 and once == again and once != other
    # With equal weights the weighted draw is the uniform one read from the other end.
    assert sample_queries(df, 100, "weighted").count() == 40
    assert sample_queries(df, -1).count() == sample_queries(df, 5, "all").count() == 40
    assert "fewer than 100" in fails(sample_queries(df, 100, "uniform"))
    assert "more than 30 test queries" in fails(sample_queries(df, -1, max_queries=30))
    with pytest.raises(ValueError):
        sample_queries(df, 20_001, max_queries=20_000)


def test_sample_order_and_weights(spark):
    df = triplets(spark, 30, lambda i: 1000 if i < 3 else 1)
    rows = sample_queries(df, 5).sort("query_rank").collect()
    assert [r.query_rank for r in rows] == [1, 2, 3, 4, 5]
    assert {r.query_id for r in rows[:3]} == {"q0", "q1", "q2"}


def test_sample_by_group(spark):
    df = triplets(spark).withColumn("g", F.when(F.col("doc_id") < "d2", 0).otherwise(1))
    rows = sample_queries(df, 4, by=("g",)).collect()
    assert sorted((r.g, r.query_rank) for r in rows) == [(g, n) for g in (0, 1) for n in (1, 2, 3, 4)]


def test_qrels_keep_the_lowest_repeated_weight_within_the_cut(spark):
    rows = [("q", "a", 9), ("q", "a", 5), ("q", "b", 7), ("q", "c", 1), ("q", "c", 8)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, weight int")
    got = lambda k: {r.doc_id: r.rel for r in build_qrels(df, top_k=k).collect()}
    # Cut to rows first: 9a 8c 7b 5a | 1c.
    assert got(4) == {"a": 5, "c": 8, "b": 7}
    assert got(2) == {"a": 9, "c": 8}
    assert got(1000) == {"a": 5, "b": 7, "c": 1}


def test_qrels_of_chosen_queries(spark):
    df = triplets(spark)
    chosen = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    assert sorted(values(build_qrels(df, chosen), "query_id")) == ["q1", "q2"]


def test_split_two_way(spark):
    rows = split_two_way(spark.range(4000).select(F.col("id").alias("query_id"), (F.col("id") * 7).alias("doc_id"))).collect()
    assert abs(sum(r.q_split for r in rows) / 4000 - 0.2) < 0.03
    assert abs(sum(r.d_split for r in rows) / 4000 - 0.5) < 0.03


def test_score_linear(spark):
    df = spark.createDataFrame([("q", 3), ("q", 1), ("q", 2), ("r", 1)], "query string, place int")
    got = sorted((r.query, r.place, r.score_linear) for r in score_linear(df, "query", ["place"], "score_linear").collect())
    assert got == [("q", 1, 3.0), ("q", 2, 2.0), ("q", 3, 1.0), ("r", 1, 1.0)]


def test_training_weights(spark):
    df = spark.createDataFrame([(4.0,), (1.0,)], "score double")
    got = {form: values(training_weights(df, "score", form).sort("score"), "train_weight") for form in ("linear", "log", "inverse")}
    assert got["linear"] == [0.25, 1.0] and got["inverse"] == [1 / 1.75, 1.0]
    assert got["log"] == [pytest.approx(math.log2(1.25)), 1.0]


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        FieldSpec("a", "audio")
    with pytest.raises(ValueError):
        TripletConfig(left=())
    assert EvalConfig(top_k=10).usable_cutoffs() == [1, 2, 3, 4, 5, 6, 8, 10]


def test_many_queries_are_ranked_without_a_limit(spark):
    df = spark.range(50_000).selectExpr("cast(id as string) AS query_id", "cast(id % 100 + 1 AS int) AS weight")
    rows = sample_queries(df, -1).collect()
    want = sorted(((i % 100 + 1, str(i)) for i in range(50_000)), key=lambda r: (-r[0], r[1]))
    assert [r.query_id for r in sorted(rows, key=lambda r: r.query_rank)] == [q for _, q in want]
    assert sorted(r.query_rank for r in rows) == list(range(1, 50_001))


def test_a_hot_group_is_sorted_by_several_tasks(spark):
    from podium.operators.topk import numbered, position_in_group

    df = spark.range(20_000).selectExpr("'k' AS key", "1 AS at", "id").repartition(4)
    assert numbered(df.select("key", "at", "id"), ["key", "at", "id"]).count() == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as the rows are few here
    ranges = df.repartitionByRange("key", "at", "id").selectExpr("spark_partition_id() AS p").distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges > 1
    assert all(r.position == r.id + 1 for r in position_in_group(df, "key", ["at", "id"]).collect())


def test_rows_of_a_null_group_are_scaled(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 4.0), ("g", 1.0)], "g string, w double")
    assert sorted(r.weight for r in scale_weights(df, "w", by=("g",)).collect()) == [1, 1, 100]
