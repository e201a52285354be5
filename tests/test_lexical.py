"""The lexical baseline against scoring every document, and what its search leaves unread."""

import math
import os
import random
import re
from collections import Counter

import pytest

from podium.operators import lexical
from podium.operators.lexical import LexicalConfig


def found_terms(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, queries, k, digits=6, k1=1.2, b=0.75):
    counts = {i: Counter(found_terms(t)) for i, t in docs}
    held = Counter(t for c in counts.values() for t in c)
    mean = sum(c.total() for c in counts.values()) / max(len(docs), 1)
    run = []
    for q, text in queries:
        scores = []
        for i, c in counts.items():
            asked = {t: n for t, n in Counter(found_terms(text)).items() if t in c}
            parts = [
                n * math.log(1 + (len(docs) - held[t] + 0.5) / (held[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * c.total() / mean))
                for t, n in asked.items()
            ]
            if asked:
                scores.append((-round(sum(parts), digits), i))
        run += [(q, i, -s, place) for place, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(run)


def corpus(seed, n=400):
    """Texts with words as frequent as words are, one of them in every text, and copies."""
    dice = random.Random(seed)
    words = [f"w{j}" for j in range(300)]
    weights = [1 / (j + 1) for j in range(300)]
    texts = ["the " * dice.randint(1, 4) + " ".join(dice.choices(words, weights, k=dice.randint(1, 60))) for _ in range(n)]
    texts[10:60] = [texts[10]] * 50
    return [(f"d{i}", t) for i, t in enumerate(texts)] + [("none", None), ("empty", ""), ("marks", "?! --")]


def frames(spark, docs, queries):
    return (
        spark.createDataFrame(docs, "doc_id string, text string").repartition(3),
        spark.createDataFrame(queries, "query_id string, text string"),
    )


def hits(result):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in result.run.collect())


QUERIES = [
    ("q1", "the w3"), ("q2", "The THE w0 w1 w2 w250"), ("q3", "unknown"), ("q4", None), ("q5", "w1 w2 w3 w4 w5 w6 w7"), ("q6", "w299 w298 the"),
    ("q7", "the"),
]


@pytest.mark.parametrize("block, k", [(1, 3), (4, 10), (16, 5), (1000, 7), (8, 1000)])
def test_same_as_scoring_all(spark, block, k):
    docs = corpus(block)
    rows, queries = frames(spark, docs, QUERIES)
    index = lexical.build_index(rows, LexicalConfig(block=block))
    assert hits(lexical.search(index, queries, k, score_digits=6)) == plain(docs, QUERIES, k)


def test_frequent_words_are_left_unread(spark):
    """Blocks of a word that is in every text are read at the first levels only."""
    docs = corpus(5, 2000)
    rows, queries = frames(spark, docs, [("q", "w299 w250 w3 the")])
    index = lexical.build_index(rows, LexicalConfig(block=8))
    result = lexical.search(index, queries, 5, score_digits=6)
    assert hits(result) == plain(docs, [("q", "w299 w250 w3 the")], 5)
    assert result.blocks > 250 and result.blocks_read < result.blocks / 4
    levels = {r.level for r in index.table("heads").where("term = 'the'").collect()}
    assert max(result.reads) < max(levels)


def test_blocks_are_bounded_and_ordered(spark):
    rows, _ = frames(spark, corpus(6), QUERIES)
    index = lexical.build_index(rows, LexicalConfig(block=8))
    blocks = index.table("blocks").collect()
    assert max(len(b.postings) for b in blocks) == 8
    assert all(b.head == max(p.impact for p in b.postings) and b.level == int(math.log2(b.block + 1)) for b in blocks)
    ends = {(b.term, b.block): min(p.impact for p in b.postings) for b in blocks}
    assert all(ends[b.term, b.block - 1] >= b.head for b in blocks if b.block)


def test_other_parameters_and_a_stored_index(spark, tmp_path):
    docs = corpus(7)
    rows, queries = frames(spark, docs, QUERIES)
    lexical.build_index(rows, LexicalConfig(k1=0.9, b=0.4, block=4), str(tmp_path / "index"))
    index = lexical.LexicalIndex(spark, str(tmp_path / "index"))
    assert hits(lexical.search(index, queries, 4, score_digits=6)) == plain(docs, QUERIES, 4, k1=0.9, b=0.4)


def test_nothing_to_index_or_to_ask(spark):
    rows, queries = frames(spark, corpus(8), QUERIES)
    empty = lexical.build_index(rows.where("false"))
    assert hits(lexical.search(empty, queries, 5)) == []
    index = lexical.build_index(rows)
    assert hits(lexical.search(index, queries.where("false"), 5)) == []
    with pytest.raises(ValueError):
        lexical.search(index, queries, 0)


def test_no_hit_is_stored_twice(spark, monkeypatch):
    """Each level stores what it has read itself, and the index sorts no more than term, document and weight."""
    rows, sorted_columns = [], []
    store, place = lexical.materialize, lexical.position_in_group

    def stored(df, name="stage"):
        out = store(df, name)
        if name == "read":
            rows.append(out.count())
        return out

    def placed(df, *some, **more):
        sorted_columns.append(sorted(df.columns))
        return place(df, *some, **more)

    monkeypatch.setattr(lexical, "materialize", stored)
    monkeypatch.setattr(lexical, "position_in_group", placed)
    docs = spark.createDataFrame([(str(i), "a " * (1 + i % 7) + "b") for i in range(60)], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "a")], "query_id string, text string")
    run = lexical.search(lexical.build_index(docs, lexical.LexicalConfig(block=4)), asked, 60).run
    assert run.count() == 60
    assert len(rows) > 2 and sum(rows) == 60
    assert sorted_columns == [["_in_doc", "doc_id", "term"]]


def written(spark):
    """Bytes in the shared folder."""
    from podium.session import shared_dir

    root = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(root) for f in files if f.startswith("part-"))


def test_a_search_stores_less_than_its_documents(spark, monkeypatch):
    """Frequent words put most documents among the candidates of each query; they are neither stored nor shuffled."""
    dice = random.Random(1)
    texts = [" ".join(f"w{int(dice.paretovariate(0.6)) % 500}" for _ in range(40)) for _ in range(3000)]
    docs = [(f"d{i}", t) for i, t in enumerate(texts)]
    asked = [(f"q{i}", " ".join(f"w{dice.randint(1, 60)}" for _ in range(20))) for i in range(40)]
    rows, queries = frames(spark, docs, asked)
    index = lexical.build_index(rows)
    monkeypatch.setattr(lexical, "READ_POSTINGS", 50_000)
    before = written(spark)
    result = lexical.search(index, queries, 10, score_digits=6)
    assert written(spark) - before < 250_000
    plan = result.run._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.rindex("WindowGroupLimit") < plan.index("MapInArrow")
    assert hits(result) == plain(docs, asked, 10)


def test_parts_change_nothing(spark, monkeypatch):
    """The index in parts, large groups numbered in ranges, no levels read, queries sent in parts, few cells at once."""
    from podium.operators import topk

    docs = corpus(9)
    rows, queries = frames(spark, docs, QUERIES)
    monkeypatch.setattr(lexical, "SORTED_PAIRS", 1000)
    monkeypatch.setattr(topk, "GROUP_ROWS", 50)
    monkeypatch.setattr(lexical, "ASKED_PAIRS", 5)
    monkeypatch.setattr(lexical, "SCORED_CELLS", 7)
    index = lexical.build_index(rows, LexicalConfig(block=8))
    assert index.table("blocks").groupBy("term", "block").count().where("count > 1").count() == 0
    assert hits(lexical.search(index, queries, 6, score_digits=6)) == plain(docs, QUERIES, 6)
    monkeypatch.setattr(lexical, "READ_POSTINGS", 0)
    result = lexical.search(index, queries, 6, score_digits=6)
    assert not result.reads and hits(result) == plain(docs, QUERIES, 6)


def test_rows_of_one_document_count_together(spark):
    """Two rows of an id add up, whatever their lengths; rows without an id are counted and never found."""
    docs = [("a", "x y"), ("a", "x y z"), ("b", "x"), (None, "x y"), (None, "x y y")]
    rows, queries = frames(spark, docs, [("q", "x y"), (None, "x")])
    found = hits(lexical.search(lexical.build_index(rows), queries, 9))
    mean, idf = 11 / 5, {"x": math.log(1 + 0.5 / 5.5), "y": math.log(1 + 1.5 / 4.5)}
    each = [(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / mean))) for n, ts in ((2, "xy"), (3, "xy")) for t in ts]
    assert [(q, d, r) for q, d, _, r in found] == [("q", "a", 1), ("q", "b", 2)]
    assert abs(found[0][2] - sum(each)) < 1e-9


def test_no_shuffle_files_are_left_by_the_index(spark):
    """What a write has shuffled is gone when it ends, and the setting for it is as before."""
    from podium.session import SHUFFLE_CLEANUP

    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark._jvm.System.gc()
    kept = root.getAllBlocks().toString().count("ShuffleDataBlock")
    rows, _ = frames(spark, corpus(3), QUERIES)
    lexical.build_index(rows)
    assert root.getAllBlocks().toString().count("ShuffleDataBlock") <= kept
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
