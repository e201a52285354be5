"""The pipeline stage by stage, and as one query."""

import importlib
import zlib

import numpy as np

import corpus_pipeline
from podium.llm import decontaminate, jaccard_join, langid
from podium.llm.queries import tokenizer_path


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    language, similar, clean, mixed, _ = (f for _, f in corpus_pipeline.STAGES)
    columns = docs.columns
    first = language(spark, docs, sf_dir)
    model = langid.train(langid.learning_rows(docs))
    kept = {r.doc_id for r in langid.identify(docs, model).collect() if not r.rejected}
    assert first.columns == columns and {r.doc_id for r in first.collect()} == kept
    second = similar(spark, docs, sf_dir)
    groups = jaccard_join.similar_documents(docs).collect()
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(r.doc_id for r in groups if r.doc_id == r.component_id)
    third = clean(spark, docs, sf_dir)
    leaky = {r.row.doc_id for r in decontaminate.screened(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r.leaks}
    assert leaky and third.columns == columns and {r.doc_id for r in third.collect()} == {r.doc_id for r in docs.collect()} - leaky
    fourth = mixed(spark, docs, sf_dir)
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    left = [r.doc_id for r in fourth.collect()]
    assert fourth.columns == columns and len(left) > 0.8 * docs.count() and sum(i in toxic for i in left) < len(toxic) / 2


def test_run(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=lambda r: r[1])
    at = 0
    for doc_id, start, n_tokens, crc in rows:
        ids = tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [1]
        assert (start, n_tokens, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n_tokens
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_run_on_empty_and_unlabelled_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    mixed = dict(corpus_pipeline.STAGES)["mixing to target weights"]
    assert mixed(spark, docs, str(tmp_path)).count() == 20
