import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.operators import knn as knn_module
from podium.operators.knn import knn
from podium.sources import tables
from podium.operators.topk import position_in_group, top_per_group

RNG = np.random.default_rng(7)
DIM = 8
# Small whole numbers tie often; a third of the documents are copies of one vector.
DOCS = {f"d{i}": [1.0] * DIM if i % 3 == 0 else RNG.integers(-2, 3, DIM).astype(float).tolist() for i in range(150)}
QUERIES = {f"q{i}": RNG.integers(-2, 3, DIM).astype(float).tolist() for i in range(20)}


def frame(spark, vectors, name, **extra):
    df = spark.createDataFrame(list(vectors.items()), f"{name} string, embedding array<float>").repartition(5)
    for column, value in extra.items():
        df = df.withColumn(column, value)
    return df


def expected(similarity, k, docs=DOCS, queries=QUERIES):
    out = {}
    for query, q in queries.items():
        scored = []
        for doc, d in docs.items():
            score = float(np.dot(q, d))
            if similarity == "cosine":
                score /= max(np.linalg.norm(q) * np.linalg.norm(d), 1e-6)
            scored.append((doc, round(score, 6) + 0.0))
        best = sorted(scored, key=lambda hit: (-hit[1], hit[0]))[:k]
        for rank, (doc, score) in enumerate(best, start=1):
            out[query, doc] = (score, rank)
    return out


def found(df):
    return {(r.query_id, r.doc_id): (r.score + 0.0, r["rank"]) for r in df.collect()}


PATHS = {
    "broadcast": {},
    "floor": {"merge_rows": 0, "floor_share": 0.3},
    "passes": {"broadcast_bytes": 300, "max_passes": 1000},
    "passes with floor": {"broadcast_bytes": 700, "max_passes": 1000, "merge_rows": 0, "floor_share": 0.5},
    "blocks": {"broadcast_bytes": 0, "block_bytes": 400},
    "blocks with floor": {"broadcast_bytes": 0, "block_bytes": 900, "merge_rows": 0, "floor_share": 0.5},
}


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("similarity", ["cosine", "ip"])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_equals_brute_force(spark, path, similarity, k):
    df = knn(frame(spark, QUERIES, "query_id"), frame(spark, DOCS, "doc_id"), k, similarity, score_digits=6, **PATHS[path])
    assert found(df) == expected(similarity, k)


def test_floor_from_some_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    frame(spark, DOCS, "doc_id").write.parquet(path)
    part = tables.read_vectors_part(spark, path, DIM, share=0.4)
    assert 0 < part.count() < len(DOCS) and len(part.inputFiles()) == 2
    docs = tables.read_vectors(spark, path, DIM)
    df = knn(frame(spark, QUERIES, "query_id"), docs, 7, "ip", score_digits=6, merge_rows=0, floor_docs=part)
    assert found(df) == expected("ip", 7)


def test_counting_documents_reads_no_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    plan = docs.agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_small_buffers_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(knn_module, "TILE_CELLS", 30)
    monkeypatch.setattr(knn_module, "HELD_ROWS", 20)
    block = knn_module.QueryBlock(
        knn_module.pa.table(
            {
                "query_id": list(QUERIES),
                "vector": list(QUERIES.values()),
                "floor": knn_module.pa.array([None] * len(QUERIES), knn_module.pa.float64()),
            }
        ),
        DIM,
    )
    search = knn_module.BestHits(block, {"k": 4, "similarity": "ip", "digits": None, "eps": 1e-6})
    ids, vectors = list(DOCS), np.array(list(DOCS.values()))
    hits = []
    for start in range(0, len(ids), 11):
        search.offer(vectors[start : start + 11], knn_module.pa.array(ids[start : start + 11]))
        if search.rows > 20:
            search.shrink()
            if search.rows > 60:
                hits += search.take().to_pylist()
    hits += search.take().to_pylist()
    for query in QUERIES:
        best = sorted(((h["score"], h["doc_id"]) for h in hits if h["query_id"] == query), key=lambda h: (-h[0], h[1]))[:4]
        want = sorted(((s, d) for (q, d), (s, _) in expected("ip", 4).items() if q == query), key=lambda h: (-h[0], h[1]))
        assert best == want


@pytest.mark.parametrize("path", PATHS)
def test_groups_search_their_own_documents(spark, path):
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    docs = frame(spark, DOCS, "doc_id", part=half)
    queries = frame(spark, QUERIES, "query_id", part=F.lit(1).cast("long"))
    members = {r.doc_id for r in docs.where("part = 1").collect()}
    rows = found(knn(queries, docs, 6, by=("part",), score_digits=6, **PATHS[path]))
    assert rows == expected("cosine", 6, {d: v for d, v in DOCS.items() if d in members})


def test_passes_move_no_documents(spark, monkeypatch):
    """Each pass gets its share of the queries, and its plan shuffles nothing but the hits of tasks."""
    sent, plans = [], []
    send, search = knn_module._send, knn_module._search_broadcast

    def seen(table, *rest):
        sent.append(len(table))
        return send(table, *rest)

    def planned(*some):
        found = search(*some)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(knn_module, "_send", seen)
    monkeypatch.setattr(knn_module, "_search_broadcast", planned)
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    docs = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.limit(40).select(F.col("vec_id").alias("query_id"), "embedding")
    bound = 18 * 64 * 8
    got = found(knn(queries, docs, 3, score_digits=6, broadcast_bytes=bound))
    assert sum(sent) == 40 and len(sent) > 2 and max(sent) <= 18
    assert not any("Exchange" in plan for plan in plans)
    assert got == found(knn(queries, docs, 3, score_digits=6))


def test_null_and_zero_vectors(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query_id string, embedding array<float>")
    docs = spark.createDataFrame(
        [("a", [2.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None)], "doc_id string, embedding array<float>"
    )
    assert found(knn(queries, docs, 10)) == {("q", "a"): (1.0, 1), ("q", "zero"): (0.0, 2)}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id string, embedding array<float>")
    df = knn(frame(spark, QUERIES, "query_id"), docs, 10)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() == 0


def test_vector_sizes_must_agree(spark, fails):
    docs = spark.createDataFrame([("a", [1.0])], "doc_id string, embedding array<float>")
    assert "must all have 8 numbers" in fails(knn(frame(spark, QUERIES, "query_id"), docs, 10))


def test_documents_stay_in_place(spark):
    """The plan reads the documents without a shuffle and cuts each task's share before merging."""
    path = "/root/testdata/sf0.001/embeddings.parquet"
    vectors = spark.read.parquet(path)
    docs = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.limit(1).select(F.col("vec_id").alias("query_id"), "embedding")
    plan = knn(queries, docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "label" not in plan
    assert plan.index("Exchange") < plan.index("MapInArrow") < plan.index("FileScan")


@pytest.mark.parametrize("spread_by", [None, "doc"])
def test_top_per_group_of_hot_key(spark, spread_by):
    rows = [("hot", f"d{i:03}", i % 10) for i in range(300)] + [("cold", "x", 5)]
    df = spark.createDataFrame(rows, "key string, doc string, weight int")
    top = top_per_group(df, ["key"], [F.desc("weight"), F.asc("doc")], 4, spread_by=spread_by, spread=7)
    got = sorted((r.key, r["rank"], r.doc) for r in top.collect())
    assert got == [("cold", 1, "x"), ("hot", 1, "d009"), ("hot", 2, "d019"), ("hot", 3, "d029"), ("hot", 4, "d039")]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("key", F.col("id") % 3).withColumn("w", F.col("id") % 7)
    top = top_per_group(df, ["key"], [F.desc("w"), F.asc("id")], 5, spread_by="id")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_position_in_group(spark):
    rows = [("hot" if i % 3 else f"k{i}", (i * 7919) % 101, i) for i in range(400)] + [(None, 1, 999)]
    df = spark.createDataFrame(rows, "key string, at int, id int")
    got = {r.id: (r.position, r.n) for r in position_in_group(df, "key", ["at", "id"], count="n").collect()}
    want = {}
    for key in {r[0] for r in rows if r[0]}:
        members = sorted((at, i) for k, at, i in rows if k == key)
        want.update({i: (place, len(members)) for place, (_, i) in enumerate(members, start=1)})
    assert got == want


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
@pytest.mark.parametrize("similarity", ["cosine", "ip"])
@pytest.mark.parametrize("path", [{}, {"merge_rows": 0, "floor_share": 0.99}, {"broadcast_bytes": 0, "block_bytes": 20_000}, {"broadcast_bytes": 3000}])
def test_unrounded_scores_lose_nothing(spark, scale, similarity, path):
    """Every path gives k rows a query, with the best scores, duplicates included."""
    rng = np.random.default_rng(5)
    docs = rng.normal(size=(400, 64)) * scale
    docs[200:260] = docs[:60]
    queries = rng.normal(size=(17, 64)) * scale
    left = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(queries)], "query_id string, embedding array<double>")
    right = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(docs)], "doc_id string, embedding array<double>").repartition(7)
    rows = knn(left, right, 50, similarity, **path).collect()
    scores = queries @ docs.T
    if similarity == "cosine":
        scores = scores / np.maximum(np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(docs, axis=1)), 1e-6)
    assert len(rows) == 17 * 50
    for r in rows:
        best = np.sort(scores[int(r.query_id)])[::-1][r["rank"] - 1]
        assert abs(r.score - best) <= 1e-9 * max(abs(best), scale**2 if similarity == "ip" else 1)


def test_nan_is_an_error(spark, fails):
    left = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    right = spark.createDataFrame([("a", [1.0, float("nan")]), ("b", [1.0, 1.0])], "doc_id string, embedding array<double>")
    assert "NaN" in fails(knn(left, right, 2))


def test_equal_scores_are_cut_to_k(spark):
    """However many documents tie, a task keeps k of them per query: those with the smallest ids."""
    ids = [f"d{i}" for i in range(500)]
    query = {"query_id": ["a", "b"], "vector": [[1.0, 0.0], [0.5, 0.0]], "floor": knn_module.pa.array([None, None], knn_module.pa.float64())}
    search = knn_module.BestHits(knn_module.QueryBlock(knn_module.pa.table(query), 2), {"k": 3, "similarity": "ip", "digits": 1, "eps": 1e-6})
    search.offer(np.ones((500, 2)), knn_module.pa.array(ids))
    assert search.rows == 6
    assert sorted(search.take()["doc_id"].to_pylist()) == sorted(2 * sorted(ids)[:3])


def test_candidates_are_handed_over(spark, monkeypatch):
    """No more candidates are held than HELD_ROWS and those of one tile, whatever k and the number of queries are."""
    monkeypatch.setattr(knn_module, "TILE_CELLS", 500)
    monkeypatch.setattr(knn_module, "HELD_ROWS", 60)
    table = {"query_id": [str(i) for i in range(100)], "vector": RNG.normal(size=(100, 2)).tolist(), "floor": knn_module.pa.nulls(100, knn_module.pa.float64())}
    search = knn_module.BestHits(knn_module.QueryBlock(knn_module.pa.table(table), 2), {"k": 9, "similarity": "ip", "digits": None, "eps": 1e-6})
    docs = knn_module.DocBlock(knn_module.pa.array([str(i) for i in range(100)]), RNG.normal(size=(100, 2)))
    sizes = [len(found) for found in search.found(docs)]
    assert sum(sizes) + search.rows == 900 and max(sizes) <= 60 + 5 * 9


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("similarity", ["cosine", "ip"])
def test_fewer_documents_than_queries(spark, monkeypatch, similarity, parts):
    """The smaller side is sent: each task takes queries and gives their k best, and no query goes through the driver."""
    sent = []
    monkeypatch.setattr(knn_module, "_send", lambda *some: sent.append(some))
    few = dict(list(DOCS.items())[:15])
    many = {f"{q}-{i}": v for q, v in QUERIES.items() for i in range(9)}
    options = {"broadcast_bytes": 400, "block_bytes": 2000 if parts == 1 else 900, "max_passes": 1000}
    df = knn(frame(spark, many, "query_id"), frame(spark, few, "doc_id"), 4, similarity, score_digits=6, **options)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == parts
    assert found(df) == expected(similarity, 4, few, many) and not sent


def test_fewer_documents_than_queries_in_groups(spark):
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    few = dict(list(DOCS.items())[:15])
    many = {f"{q}-{i}": v for q, v in QUERIES.items() for i in range(9)}
    docs = frame(spark, few, "doc_id", part=half)
    members = {r.doc_id for r in docs.where("part = 1").collect()}
    queries = frame(spark, many, "query_id", part=F.lit(1).cast("long"))
    rows = found(knn(queries, docs, 4, by=("part",), score_digits=6, broadcast_bytes=400))
    assert rows == expected("cosine", 4, {d: v for d, v in few.items() if d in members}, many)


def test_blocks_fill_the_cores(spark, monkeypatch):
    """Blocks far below their bound are cut finer, a partition for each pair, so that one task does not search for all."""
    monkeypatch.setattr(knn_module, "TASK_PRODUCTS", 3000)
    df = knn(frame(spark, QUERIES, "query_id"), frame(spark, DOCS, "doc_id"), 5, score_digits=6, broadcast_bytes=0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "REPARTITION_BY_NUM" in plan
    assert found(df) == expected("cosine", 5)
    sizes = {"query_bytes": 1000, "doc_bytes": 8000, "block_bytes": 400}
    q, d = knn_module._pairs_of_blocks(20, 5, sizes, 12)
    assert q >= 3 and q * d >= 12


@pytest.mark.parametrize("digits", [None, 3])
@pytest.mark.parametrize("similarity", ["cosine", "ip"])
def test_single_precision_only_drops_what_cannot_count(similarity, digits):
    """Scores closer than single precision tells apart, copies, and lengths of all sizes: the same hits as of all scores."""
    rng = np.random.default_rng(11)
    docs = rng.normal(size=(3000, 16)) * 10.0 ** rng.integers(-2, 3, (3000, 1))
    docs[1000:2000] = docs[0] + rng.normal(size=(1000, 16)) * 1e-9
    docs[2000:2200] = docs[1]
    docs[2300] = 0
    queries = np.concatenate([docs[:2], rng.normal(size=(40, 16)), np.zeros((1, 16))])
    ids = [f"d{i:04}" for i in range(3000)]
    table = {"query_id": [str(i) for i in range(43)], "vector": queries.tolist(), "floor": knn_module.pa.nulls(43, knn_module.pa.float64())}
    block = knn_module.QueryBlock(knn_module.pa.table(table), 16)
    search = knn_module.BestHits(block, {"k": 30, "similarity": similarity, "digits": digits, "eps": 1e-6})
    found = [t for t in [*search.found(knn_module.DocBlock(knn_module.pa.array(ids), docs)), search.take()] if t is not None]
    got = {}
    for t in found:
        for hit in t.to_pylist():
            got.setdefault(int(hit["query_id"]), []).append((-hit["score"], hit["doc_id"]))
    scores = np.einsum("ik,jk->ij", queries, docs)
    if similarity == "cosine":
        scores /= np.maximum(np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(docs, axis=1)), 1e-6)
    scores = scores if digits is None else np.round(scores, digits)
    for i in range(43):
        assert len(got[i]) == 30
        want = np.sort(scores[i])[::-1][:30]
        assert np.allclose(-np.array(sorted(s for s, _ in got[i])), want, rtol=1e-12, atol=1e-12)
    if digits:
        assert [d for _, d in sorted(got[42])] == ids[:30]


def test_most_cells_are_not_scored_in_double_precision(monkeypatch):
    """Only documents that may be among the best are; all of them, where lengths are too small for it."""
    rng = np.random.default_rng(12)
    dense, seen = knn_module.BestHits._dense, []
    monkeypatch.setattr(knn_module.BestHits, "_dense", lambda self, *some: seen.append(1) or dense(self, *some))
    docs, queries = rng.normal(size=(20_000, 8)), rng.normal(size=(300, 8))
    for scale in (1.0, 1e-5):
        table = {"query_id": [str(i) for i in range(300)], "vector": (queries * scale).tolist(), "floor": knn_module.pa.nulls(300, knn_module.pa.float64())}
        search = knn_module.BestHits(knn_module.QueryBlock(knn_module.pa.table(table), 8), {"k": 10, "similarity": "cosine", "digits": 6, "eps": 1e-6})
        search.offer(docs * scale, knn_module.pa.array([str(i) for i in range(20_000)]))
        assert search.rows == 3000 and bool(seen) == (scale < 1)


def test_as_many_documents_as_queries_are_sent(spark, monkeypatch):
    """A query then meets all documents in one task, which gives k hits of it, and no pass and no floor is needed."""
    sent = []
    monkeypatch.setattr(knn_module, "PASS_BYTES", 400)
    monkeypatch.setattr(knn_module, "MERGE_ROWS", 5)
    monkeypatch.setattr(knn_module, "_send", lambda *some: sent.append(some))
    some = {f"q{i}": v for i, v in enumerate(DOCS.values()) if i < 60}
    df = knn(frame(spark, some, "query_id"), frame(spark, DOCS, "doc_id"), 4, score_digits=6, broadcast_bytes=400, merge_rows=5)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and not sent
    assert found(df) == expected("cosine", 4, DOCS, some)
