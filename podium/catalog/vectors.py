"""Vector functions, embedding and zero-shot labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import numbers, query, rounded, table
from podium.config import EvalConfig, FieldSpec, TripletConfig
from podium.functions import text
from podium.functions import vectors as V
from podium.operators import embed as E
from podium.plans.evaluation import evaluate_fields
from podium.plans.report import summary


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


LONG = "unnest(range(len(v))) AS pos, round(unnest(v), 6) + 0.0 AS x"
UNIT = "list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-300))"


@query(
    f"""WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings),
        n AS (SELECT vec_id, {UNIT} AS v FROM p)
        SELECT vec_id, {LONG} FROM n"""
)
def l2_normalize(spark, sf_dir):
    tripled = _vectors(spark, sf_dir).withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    return numbers(tripled.select("vec_id", V.l2_normalize("v").alias("embedding")), "vec_id")


# A second vector for records that are labelled good: that of the next record.
TWO_FIELDS_SQL = """
two AS (
  SELECT a.vec_id, a.embedding::DOUBLE[] AS v1, CASE WHEN quality = 1 THEN b.embedding::DOUBLE[] END AS v2
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 LEFT JOIN labels ON doc_id = a.vec_id
),
weighted AS (
  SELECT *, CASE WHEN v2 IS NULL THEN 0.0::DOUBLE ELSE 0.1 END AS raw,
         0.9::DOUBLE / (0.9::DOUBLE + raw) AS w1, raw / (0.9::DOUBLE + raw) AS w2
  FROM two
)"""
FIELDS = [FieldSpec("v1", "img", 0.9), FieldSpec("v2", "txt", 0.1)]


def _two_fields(spark, sf_dir):
    first = _vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("v1"))
    following = _vectors(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    joined = first.join(following, "vec_id", "left").join(labels, "vec_id", "left")
    return joined.select("vec_id", "v1", F.when(F.col("quality") == 1, F.col("next")).alias("v2"))


@query(f"WITH {TWO_FIELDS_SQL} SELECT vec_id, round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2 FROM weighted")
def mask_weights(spark, sf_dir):
    two = _two_fields(spark, sf_dir)
    weights = two.select("vec_id", text.field_weights(two, FIELDS).alias("w"))
    return weights.select("vec_id", rounded(F.col("w")[0]).alias("w1"), rounded(F.col("w")[1]).alias("w2"))


@query(
    f"""WITH {TWO_FIELDS_SQL},
        summed AS (
          SELECT vec_id, CASE WHEN v2 IS NULL THEN v1
            ELSE list_transform(list_zip(v1, v2), lambda p: p[1] * w1 + p[2] * w2) END AS v
          FROM weighted),
        fused AS (SELECT vec_id, {UNIT} AS v FROM summed)
        SELECT vec_id, {LONG} FROM fused"""
)
def fuse_fields(spark, sf_dir):
    two = _two_fields(spark, sf_dir)
    fused = V.fuse_fields(["v1", "v2"], text.field_weights(two, FIELDS))
    return numbers(two.select("vec_id", fused.alias("embedding")), "vec_id")


# Groups of three consecutive vectors stand for the tokens of a text; labelled ones count.
TOKENS_SQL = """
tokens AS (
  SELECT vec_id // 3 AS text_id, vec_id, embedding::DOUBLE[] AS v, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS mask
  FROM embeddings LEFT JOIN labels ON doc_id = vec_id
)"""


def _tokens(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    rows = _vectors(spark, sf_dir).join(labels, "vec_id", "left")
    mask = F.when(F.col("quality") == 1, 1).otherwise(0)
    return rows.select(F.expr("vec_id div 3").alias("text_id"), "vec_id", "embedding", mask.alias("mask"))


def _token_arrays(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "mask")))
    texts = _tokens(spark, sf_dir).groupBy("text_id").agg(ordered.alias("tokens"))
    return texts.select("text_id", F.col("tokens.embedding").alias("tokens"), F.col("tokens.mask").alias("mask"))


POOL_SQL = f"""WITH {TOKENS_SQL}, long AS (
  SELECT text_id, unnest(range(64)) AS pos, unnest(v) AS x FROM tokens WHERE mask = 1)
SELECT text_id, pos, round(avg(x), 6) + 0.0 AS x FROM long GROUP BY ALL"""


@query(POOL_SQL)
def mean_pool(spark, sf_dir):
    texts = _token_arrays(spark, sf_dir)
    return numbers(texts.select("text_id", V.mean_pool("tokens", "mask").alias("embedding")), "text_id")


@query(POOL_SQL)
def mean_pool_long(spark, sf_dir):
    """The same from one row per token, combined before the shuffle."""
    return numbers(V.mean_pool_long(_tokens(spark, sf_dir), "text_id", "embedding", "mask"), "text_id")


@query(
    f"""WITH {TOKENS_SQL}, first AS (SELECT text_id, arg_min(v, vec_id) AS v FROM tokens GROUP BY ALL)
        SELECT text_id, {LONG} FROM first"""
)
def cls_pool(spark, sf_dir):
    texts = _token_arrays(spark, sf_dir)
    return numbers(texts.select("text_id", V.cls_pool("tokens").alias("embedding")), "text_id")


LABELS_SQL = f"""
long AS (SELECT label, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM long GROUP BY ALL),
lists AS (SELECT cast(label AS varchar) AS label, list(x ORDER BY pos) AS v FROM means GROUP BY ALL),
labels_mean AS (SELECT label, {UNIT} AS v FROM lists),
scores AS (
  SELECT cast(vec_id AS varchar) AS item_id, l.label, 10 * list_dot_product(embedding::DOUBLE[], v) AS score
  FROM embeddings e, labels_mean l
),
softmax AS (
  SELECT *, exp(score - max(score) OVER (PARTITION BY item_id)) AS shifted FROM scores
),
probabilities AS (SELECT *, shifted / sum(shifted) OVER (PARTITION BY item_id) AS probability FROM softmax)"""


def _label_vectors(spark, sf_dir):
    """Mean vector of each label, unit length."""
    means = V.mean_pool_long(_vectors(spark, sf_dir).withColumn("used", F.lit(1)), "label", "embedding", "used")
    return means.select(F.col("label").cast("string").alias("label"), V.l2_normalize("embedding").alias("embedding"))


def _items(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "embedding")


@query(f"WITH {LABELS_SQL} SELECT item_id, label, round(score, 6) + 0.0 AS score FROM scores")
def scaled_scores(spark, sf_dir):
    scores = E.scaled_scores(_items(spark, sf_dir), _label_vectors(spark, sf_dir), 10)
    return scores.select("item_id", "label", rounded("score").alias("score"))


@query(f"WITH {LABELS_SQL} SELECT item_id, label, round(probability, 6) + 0.0 AS probability FROM probabilities")
def label_softmax(spark, sf_dir):
    scores = E.scaled_scores(_items(spark, sf_dir), _label_vectors(spark, sf_dir), 10)
    return E.label_softmax(scores).select("item_id", "label", rounded("probability").alias("probability"))


@query(
    f"""WITH {LABELS_SQL} SELECT item_id, arg_max(label, score) AS label, round(max(probability), 6) + 0.0 AS probability
        FROM probabilities GROUP BY item_id"""
)
def classify(spark, sf_dir):
    best = E.classify(_items(spark, sf_dir), _label_vectors(spark, sf_dir), 10)
    return best.select("item_id", "label", rounded("probability").alias("probability"))


@query(
    """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS ip,
              round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
                / greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
                  * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-6), 6) + 0.0 AS cosine
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def pair_similarity(spark, sf_dir):
    """Similarity of vectors that already stand in one row."""
    first = _vectors(spark, sf_dir).select("vec_id", "embedding")
    following = _vectors(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = first.join(following, "vec_id")
    return pairs.select(
        "vec_id",
        rounded(V.inner_product("embedding", "next")).alias("ip"),
        rounded(V.cosine_similarity("embedding", "next")).alias("cosine"),
    )


# Whole texts; an n-gram's md5 chooses position and sign.
HASHED_SQL = r"""
words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM documents
),
grams AS (
  SELECT doc_id, unnest(w) AS gram FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
),
places AS (
  SELECT doc_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 64 AS pos,
         CASE WHEN substr(md5(gram), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END AS sign
  FROM grams
),
counts AS (SELECT doc_id, pos, sum(sign) AS x FROM places GROUP BY ALL),
cells AS (SELECT doc_id, pos, coalesce(x, 0) AS x FROM
  (SELECT doc_id, unnest(range(64)) AS pos FROM documents) LEFT JOIN counts USING (doc_id, pos))
"""


@query(
    f"""WITH {HASHED_SQL}, lengths AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM cells GROUP BY ALL)
        SELECT cast(doc_id AS varchar) AS doc_id, pos,
               round((CASE WHEN n > 0 THEN x / n ELSE 0 END)::FLOAT::DOUBLE, 6) + 0.0 AS x
        FROM cells JOIN lengths USING (doc_id)"""
)
def embed_texts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return numbers(E.embed(documents, "doc_id", [FieldSpec("text")], {"txt": E.HashedNgrams(64)}), "doc_id")


@query("SELECT count(*) AS records, cast(count(*) FILTER (text IS NULL) AS bigint) AS without_vector FROM documents")
def count_missing_vectors(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return E.count_missing(E.embed(documents, "doc_id", [FieldSpec("text")], {"txt": E.HashedNgrams(64)}))


@query()
def embed_then_evaluate(spark, sf_dir):
    """Brand and type as the query, name and type as the document, price as the weight."""
    parts = table(spark, sf_dir, "part")
    roles = TripletConfig(
        left=(FieldSpec("p_brand", weight=0.5), FieldSpec("p_type", weight=0.5)),
        right=(FieldSpec("p_name", weight=0.9), FieldSpec("p_type", weight=0.1)),
        weight_key="p_retailprice",
        doc_id_key="p_partkey",
    )
    corpus = parts.withColumn("doc_id", F.col("p_partkey"))
    config = EvalConfig(top_k=100, score_digits=6)
    result = evaluate_fields(parts, corpus, roles, {"txt": E.HashedNgrams(64)}, ["p_partkey"], config)
    row = summary(result.metrics, config.top_k)
    return row.select(*[rounded(c).alias(c) for c in row.columns])
