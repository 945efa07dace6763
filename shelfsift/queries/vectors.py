"""Similarity, neighbours and density over vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions import text as tx
from shelfsift.functions import vectors as vx
from shelfsift.operators import neighbours as nb
from shelfsift.operators import similarity as sm
from shelfsift.operators.sequences import word_index
from shelfsift.queries import query, table
from shelfsift.queries.fragments import ITEM, documents, items, raw_words, words
from shelfsift.queries.sequences import BY_FREQ, SEEN

_V = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")


@query(
    "SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, "
    f"round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM {_V}"
)
def l2_normalized(spark: SparkSession, folder: str) -> DataFrame:
    unit = _vectors(spark, folder).select("vec_id", vx.l2("embedding").alias("u"))
    return unit.select(
        "vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"))


@query(
    f"SELECT a.vec_id, b.vec_id AS next_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM {_V} a JOIN {_V} b "
    "ON b.vec_id = a.vec_id + 1"
)
def cosine_of_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    following = v.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("next"))
    return v.join(following, F.col("next_id") == F.col("vec_id") + 1).select(
        "vec_id", "next_id", F.round(vx.cosine("embedding", "next"), 6).alias("similarity"))


@query(
    f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM {_V} a JOIN {_V} b "
    "ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.35"
)
def similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nb.vector_pairs(_vectors(spark, folder), "vec_id", "embedding", 0.35).withColumn(
        "similarity", F.round("similarity", 6))


@query()
def similar_vectors_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return nb.vector_pairs_lsh(_vectors(spark, folder), "vec_id", "embedding", 0.35)


@query(
    f"SELECT b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM {_V} a JOIN {_V} b ON a.vec_id = 7 AND b.vec_id <> 7 "
    "ORDER BY similarity DESC, b.vec_id LIMIT 10"
)
def top_similar(spark: SparkSession, folder: str) -> DataFrame:
    return nb.top_similar(_vectors(spark, folder), "vec_id", "embedding", 7, 10).withColumn(
        "similarity", F.round("similarity", 6))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM {_V} a JOIN {_V} b ON a.vec_id = 3 AND b.vec_id = 11")
def word_similarity(spark: SparkSession, folder: str) -> DataFrame:
    found = nb.similarity(_vectors(spark, folder), "vec_id", "embedding", 3, 11)
    return found.select("a", F.col("b").cast("bigint").alias("b"), F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM {_V}),
t AS (SELECT list_transform(list_zip(a.u, b.u, c.u), lambda z: z[1] + z[2] - z[3]) AS t FROM u a, u b, u c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3)
SELECT vec_id, round(list_cosine_similarity(u, t), 6) AS similarity FROM u, t WHERE vec_id NOT IN (1, 2, 3) ORDER BY similarity DESC, vec_id LIMIT 5"""
)
def analogy(spark: SparkSession, folder: str) -> DataFrame:
    return nb.analogy(_vectors(spark, folder), "vec_id", "embedding", [1, 2], [3], 5).withColumn(
        "similarity", F.round("similarity", 6))


_NEAR = f"""WITH d AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, b.label, list_distance(a.v, b.v) AS distance FROM {_V} a JOIN {_V} b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY distance, train_id) AS r FROM d) WHERE r <= 5)"""


@query(_NEAR + " SELECT test_id, train_id, round(distance, 6) AS distance FROM n")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    return nb.nearest(v, v, "vec_id", "embedding", 5, skip_same=True).withColumn("distance", F.round("distance", 6))


def _vote(weight: str) -> str:
    return (
        _NEAR + f", w AS (SELECT test_id, label, round(sum({weight}), 9) AS votes FROM n GROUP BY test_id, label) SELECT test_id AS vec_id, "
        "label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY votes DESC, label) AS r FROM w) WHERE r = 1"
    )


@query(_vote("1.0"))
def knn_uniform(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    return nb.knn_classify(v, v, "vec_id", "embedding", "label", 5, "uniform", skip_same=True)


@query(_vote("1 / distance"))
def knn_distance(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    return nb.knn_classify(v, v, "vec_id", "embedding", "label", 5, "distance", skip_same=True)


@query(
    f"""WITH c AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {_V} WHERE label = 1) GROUP BY i),
cv AS (SELECT array_agg(x ORDER BY i) AS c FROM c), d AS (SELECT vec_id, label, list_distance(v, c) AS distance FROM {_V}, cv),
t AS (SELECT quantile_cont(distance, 0.9) AS threshold FROM d WHERE label = 1)
SELECT vec_id, round(distance, 6) AS distance, round(threshold, 6) AS threshold, round(distance, 9) <= round(threshold, 9) AS inside FROM d, t"""
)
def one_class(spark: SparkSession, folder: str) -> DataFrame:
    found = nb.one_class(_vectors(spark, folder), "vec_id", "embedding", F.col("label") == 1, 0.1)
    return found.select(
        "vec_id", F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), "inside")


@query(
    f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM {_V} a JOIN {_V} b ON a.vec_id <> b.vec_id
  WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.65),
core AS (SELECT vec_id FROM embeddings LEFT JOIN e ON vec_id = a GROUP BY vec_id HAVING count(b) + 1 >= 3),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT vec_id FROM core) AND b IN (SELECT vec_id FROM core)),
reach(v, w) AS (SELECT vec_id, vec_id FROM core UNION SELECT reach.v, ce.b FROM reach JOIN ce ON reach.w = ce.a),
comp AS (SELECT v, min(w) AS c FROM reach GROUP BY v),
border AS (SELECT e.a AS v, min(comp.c) AS c FROM e JOIN comp ON e.b = comp.v GROUP BY e.a)
SELECT vec_id, coalesce(comp.c, border.c, -1) AS cluster FROM embeddings LEFT JOIN comp ON vec_id = comp.v LEFT JOIN border ON vec_id = border.v"""
)
def dbscan(spark: SparkSession, folder: str) -> DataFrame:
    return nb.dbscan(_vectors(spark, folder), "vec_id", "embedding", 0.65, 3)


_POOL = f"""WITH {SEEN}, idx AS ({BY_FREQ}), vec AS (SELECT token, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN idx ON vec_id = idx - 1),
w AS (SELECT doc_id, unnest({words('text')}) AS token FROM documents),
x AS (SELECT doc_id, v FROM w JOIN vec USING (token))
SELECT doc_id, round({{how}}(v[1]), 6) AS x1, round({{how}}(v[64]), 6) AS x64 FROM x GROUP BY doc_id"""


def _pooled(spark: SparkSession, folder: str, how: str) -> DataFrame:
    docs = documents(spark, folder)
    index = word_index(docs, "text", "freq", ["doc_id"]).select("token", "idx")
    named = table(spark, folder, "embeddings").join(index, F.col("vec_id") == F.col("idx") - 1).select("token", "embedding")
    pooled = nb.pooled_vector(docs, "doc_id", tx.tokens_ws("text"), named, "token", "embedding", how)
    return pooled.select(
        "doc_id", F.round(F.get("vector", F.lit(0)), 6).alias("x1"), F.round(F.get("vector", F.lit(63)), 6).alias("x64"))


@query(_POOL.replace("{how}", "avg"))
def pooled_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, "mean")


@query(_POOL.replace("{how}", "max"))
def pooled_max(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, "max")


# -- texts -----------------------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT min(p_partkey) AS id, list_distinct({raw_words(ITEM)}) AS w FROM part GROUP BY {ITEM}),
s AS (SELECT id, unnest(w) AS token, len(w) AS n FROM t),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity
  FROM s a JOIN s b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.6"""
)
def similar_items(spark: SparkSession, folder: str) -> DataFrame:
    found = sm.jaccard_pairs(items(spark, folder), "p_partkey", tx.split_tokens("_text"), "item", 0.6)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH t AS (SELECT min(doc_id) AS id, list_distinct({words('text')}) AS w FROM documents GROUP BY text),
s AS (SELECT id, unnest(w) AS token, len(w) AS n FROM t),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity
  FROM s a JOIN s b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.5"""
)
def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = sm.jaccard_pairs(documents(spark, folder), "doc_id", tx.tokens_ws("_text"), "text", 0.5)
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def jaro_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return sm.jaro_pairs(items(spark, folder), "p_partkey", "item", 0.15, "p_type")


@query()
def fuzzy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return sm.fuzzy_pairs(items(spark, folder).select("p_partkey", "p_name"), "p_partkey", "p_name", 0.3)


@query()
def threshold_clusters(spark: SparkSession, folder: str) -> DataFrame:
    named = items(spark, folder)
    pairs = sm.jaro_pairs(named, "p_partkey", "item", 0.15, "p_type")
    return sm.threshold_clusters(named, "p_partkey", "item", pairs, 0.15, "p_type")


@query()
def complete_linkage_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Part descriptions of one type in clusters whose members are all close to each other."""
    named = items(spark, folder)
    pairs = sm.jaro_pairs(named, "p_partkey", "item", 0.15, "p_type")
    return sm.threshold_clusters(named, "p_partkey", "item", pairs, 0.15, "p_type", linkage="complete")
