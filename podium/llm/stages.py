"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives the next one's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.llm import dac, decontaminate, jaccard_join, langid, mixing
from podium.llm.common import table
from podium.llm.queries import TARGETS, tokenizer_path


def language(spark, docs, sf_dir):
    """Documents whose language is rejected go."""
    model = langid.train(langid.learning_rows(docs.select("doc_id", "lang", "text")))
    return langid.identified(docs, model).where("not rejected").select("row.*")


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of similar ones stays."""
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    found = decontaminate.screened(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select("row.*")


def mixed(spark, docs, sf_dir):
    """Each document as many times as its domains' target weights ask for."""
    known = mixing.domains_of(table(spark, sf_dir, "labels"))
    found = mixing.mix_sources(docs, known, TARGETS)
    return found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def token_codes(spark, docs, sf_dir):
    """Writes the token ids and gives each document's place in them."""
    return dac.read_tokens(dac.write_tokens(docs, tokenizer_path(), independent=True))


STAGES = [
    ("language id", language),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing to target weights", mixed),
    ("token codes", token_codes),
]
