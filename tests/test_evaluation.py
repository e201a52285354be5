import pytest

from podium.config import EvalConfig, FieldSpec, TripletConfig
from podium.operators.embed import HashedNgrams
from podium.operators.splits import split_two_way
from podium.plans import report
from podium.plans.evaluation import Stages, evaluate_fields, evaluate_splits, evaluate_vectors, metric_only

TITLES = {"1": "red running shoe", "2": "blue running shoe", "3": "green hat", "4": "straw hat", "5": "leather bag"}
SEARCHES = [
    ("red running shoe", "1", 3.0), ("red running shoe", "2", 2.0), ("green hat", "3", 3.0),
    ("green hat", "4", 1.0), ("leather bag", "5", 2.0),
]
ROLES = TripletConfig((FieldSpec("query"),), (FieldSpec("title"),), "score_linear", "product_id")
CONFIG = EvalConfig(top_k=5)


@pytest.fixture
def triplets(spark):
    return spark.createDataFrame(SEARCHES, "query string, product_id string, score_linear double")


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(list(TITLES.items()), "doc_id string, title string")


def named(metrics):
    return {r["name"]: r["value"] for r in metrics.collect()}


def test_evaluate_fields(spark, triplets, corpus, tmp_path):
    encoder = {"txt": HashedNgrams(256)}
    result = evaluate_fields(triplets, corpus, ROLES, encoder, ["product_id"], CONFIG)
    values = named(result.metrics)
    # Titles equal to the query come first.
    assert values["MRR@1"] == values["Accuracy@5"] == values["Recall@5"] == 1 and values["Hole@1"] == 0
    row = report.summary(result.metrics, 5).first().asDict()
    assert row["mAP@5"] is not None and row["mERR"] == values["mERR"] and row["NDCG@10"] is None

    stages = Stages(str(tmp_path), "v1")
    first = evaluate_fields(triplets, corpus, ROLES, encoder, ["product_id"], CONFIG, stages=stages)
    again = evaluate_fields(triplets.limit(0), corpus.limit(0), ROLES, encoder, ["product_id"], CONFIG, stages=stages)
    assert named(first.metrics) == named(again.metrics) == values
    assert named(metric_only(first.run, first.qrels, CONFIG)) == values


def test_other_judgments_are_another_run(spark, triplets, corpus, tmp_path):
    """The stored run belongs to the judgments, and to the order that chooses a query's fields."""
    encoder, stages = {"txt": HashedNgrams(256)}, Stages(str(tmp_path), "v1")
    key = "red running shoe_{!@#~}_", "green hat_{!@#~}_"
    for name, doc in zip(key, ("1", "3")):
        qrels = spark.createDataFrame([(name, doc, 1)], "query_id string, doc_id string, rel int")
        found = evaluate_fields(triplets, corpus, ROLES, encoder, ["product_id"], CONFIG, qrels=qrels, stages=stages)
        assert {r.query_id for r in found.run.select("query_id").distinct().collect()} == {name}
        assert named(found.metrics)["MRR@1"] == 1
    twice = triplets.union(triplets.where("product_id = '1'").selectExpr("query", "'9'", "score_linear"))
    evaluate_fields(twice, corpus, ROLES, encoder, ["product_id"], CONFIG, stages=stages)
    before = len(list((tmp_path / "run").iterdir()))
    evaluate_fields(twice, corpus, ROLES, encoder, ["score_linear", "product_id"], CONFIG, stages=stages)
    assert len(list((tmp_path / "run").iterdir())) == before + 1


def test_evaluate_vectors(spark, triplets):
    queries = {q: i for i, q in enumerate(sorted({s[0] for s in SEARCHES}))}
    vector = lambda i: [1.0 if j == i else 0.1 for j in range(3)]
    query_vectors = spark.createDataFrame([(f"{q}_{{!@#~}}_", vector(i)) for q, i in queries.items()], "query_id string, embedding array<float>")
    best = {doc: queries[q] for q, doc, _ in SEARCHES}
    doc_vectors = spark.createDataFrame([(d, vector(i)) for d, i in best.items()], "doc_id string, embedding array<float>")
    result = evaluate_vectors(triplets, query_vectors, doc_vectors, ROLES, CONFIG)
    assert named(result.metrics)["P@1"] == 1
    with pytest.raises(ValueError, match="no vector for query"):
        evaluate_vectors(triplets, query_vectors.limit(1), doc_vectors, ROLES, CONFIG)


def test_evaluate_splits_equals_each_split_alone(spark):
    sets = [(f"q{i % 9}", f"d{(i * 5) % 20}", float(i % 7)) for i in range(120)]
    triplets = split_two_way(spark.createDataFrame(sets, "query_id string, doc_id string, w double"), query_share=0.5)
    vector = lambda i: [float((i * 7) % 5), float((i * 3) % 4), 1.0]
    docs = spark.createDataFrame([(f"d{i}", vector(i)) for i in range(20)], "doc_id string, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", vector(i + 2)) for i in range(9)], "query_id string, embedding array<float>")
    config = EvalConfig(top_q=4, top_k=3, score_digits=6)
    together = {
        (r.q_split, r.d_split, r["name"]): r["value"] for r in evaluate_splits(triplets, queries, docs, config, "w").collect()
    }
    assert {key[:2] for key in together} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    by_doc = split_two_way(docs.withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "doc_id AS query_id", "embedding"))
    roles = TripletConfig((FieldSpec("query_id"),), (FieldSpec("doc_id"),), "w", "doc_id", "query_id")
    for q, d in ((0, 0), (1, 1)):
        part = triplets.where(f"q_split = {q} AND d_split = {d}")
        alone = evaluate_vectors(part, queries, by_doc.where(f"d_split = {d}"), roles, config)
        for name, value in named(alone.metrics).items():
            assert together[q, d, name] == pytest.approx(value, abs=1e-9), name
