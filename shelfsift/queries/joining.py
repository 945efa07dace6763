"""Joins of items with categories, truth and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions.text import process_string
from shelfsift.operators import joins
from shelfsift.operators.counts import category_counts
from shelfsift.operators.sequences import word_index
from shelfsift.plans import jobs
from shelfsift.queries import query, table
from shelfsift.queries.fragments import documents, processed
from shelfsift.queries.sequences import BY_FREQ, SEEN


@query(
    "SELECT c_custkey, category_id, category_path FROM (SELECT c_custkey, c_nationkey AS category_id FROM customer) c "
    "LEFT JOIN (SELECT DISTINCT n_nationkey AS category_id, r_name || ' > ' || n_name AS category_path FROM nation JOIN region "
    "ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') USING (category_id)"
)
def with_category_path(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    dim = nation.join(region.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("category_id"), F.concat_ws(" > ", "r_name", "n_name").alias("category_path"))
    owned = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("category_id"))
    return joins.with_category_path(owned, dim)


# Parts told as predictions for item names, orders of a part's brand as truth.
_PREDICTED = """(SELECT p_name AS description, p_type AS predicted_category, round(p_retailprice / 3000, 6) AS probability FROM part)"""
_TRUTH = "(SELECT p_name AS description, p_brand AS category_id FROM part)"


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_name").alias("description"), F.col("p_type").alias("predicted_category"),
        F.round(F.col("p_retailprice") / 3000, 6).alias("probability"))


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_name").alias("description"), F.col("p_brand").alias("category_id"))


@query(f"SELECT DISTINCT p.*, t.category_id FROM {_PREDICTED} p JOIN {_TRUTH} t USING (description)")
def join_truth(spark: SparkSession, folder: str) -> DataFrame:
    return joins.join_truth(_predicted(spark, folder), _truth(spark, folder), "description")


@query(
    f"SELECT DISTINCT p.*, t.category_id FROM {_PREDICTED} p LEFT JOIN {_TRUTH} t ON p.description = t.description "
    "WHERE t.category_id <> 'Brand#7' AND p.predicted_category ILIKE '%eco%' AND p.predicted_category NOT ILIKE '%promo%'"
)
def missing_item_report(spark: SparkSession, folder: str) -> DataFrame:
    return joins.missing_item_report(
        _predicted(spark, folder), _truth(spark, folder), "description", "Brand#7", "eco", "promo")


_RESULTS = "(SELECT p_name AS truth, p_type AS path, p_size % 7 AS category_id, p_brand AS pred FROM part)"


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_name").alias("truth"), F.col("p_type").alias("path"), (F.col("p_size") % 7).alias("category_id"),
        F.col("p_brand").alias("pred"))


@query(f"SELECT truth, path, count(DISTINCT pred) AS predictions FROM {_RESULTS} GROUP BY truth, path HAVING count(DISTINCT pred) > 4")
def ambiguous_labels(spark: SparkSession, folder: str) -> DataFrame:
    return joins.ambiguous_labels(_results(spark, folder), "truth", "pred", "path").where("predictions > 4")


@query(
    f"SELECT path, category_id, pred, count(*) AS rows FROM {_RESULTS} WHERE truth IN (SELECT truth FROM {_RESULTS} "
    "GROUP BY truth, path HAVING count(DISTINCT pred) > 1) GROUP BY path, category_id, pred"
)
def drill_down(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.ambiguity_report(_results(spark, folder), "truth", "path", "category_id", "pred")["predictions"]


@query(f"SELECT truth, path, category_id, pred FROM {_RESULTS} WHERE truth <> pred")
def ambiguity_wrong_rows(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.ambiguity_report(_results(spark, folder), "truth", "path", "category_id", "pred")["wrong"]


@query("SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS class_rows FROM part")
def with_class_rows(spark: SparkSession, folder: str) -> DataFrame:
    return joins.with_class_rows(table(spark, folder, "part").select("p_partkey", "p_type"), "p_type")


@query(
    "SELECT o_custkey % 25 AS nation, count(*) AS rows FROM orders WHERE o_custkey % 25 IN "
    "(SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') GROUP BY 1"
)
def semi_join_counts(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    wanted = nation.join(region.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation"))
    orders = table(spark, folder, "orders").select((F.col("o_custkey") % 25).alias("nation"))
    return joins.drill_down(orders, ["nation"], wanted, "nation")


# The most frequent words take the given vectors in turn; the other words have none.
@query(
    f"WITH {SEEN}, idx AS ({BY_FREQ}) SELECT token, idx, round(coalesce(CAST(embedding[1] AS DOUBLE), 0), 6) AS x1, "
    "round(coalesce(CAST(embedding[64] AS DOUBLE), 0), 6) AS x64 FROM idx LEFT JOIN embeddings ON vec_id = idx - 1"
)
def vector_lookup(spark: SparkSession, folder: str) -> DataFrame:
    index = word_index(documents(spark, folder), "text", "freq", ["doc_id"]).select("token", "idx")
    vectors = table(spark, folder, "embeddings").join(index, F.col("vec_id") == F.col("idx") - 1).select("token", "embedding")
    found = joins.vector_lookup(index, vectors, "token", "embedding", 64)
    return found.select(
        "token", "idx", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x1"),
        F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("x64"))


@query(
    f"""WITH t AS (SELECT source, {processed('text')} AS text, count(*) AS copies FROM documents GROUP BY ALL)
SELECT d.doc_id, d.source FROM (SELECT doc_id, source, {processed('text')} AS text FROM documents) d WHERE EXISTS
(SELECT 1 FROM t WHERE t.source = d.source AND contains(t.text, d.text) AND t.text <> d.text)"""
)
def truncated_documents(spark: SparkSession, folder: str) -> DataFrame:
    from shelfsift.operators.truncation import truncated_items

    cleaned = documents(spark, folder).withColumn("text", process_string("text"))
    return truncated_items(cleaned, "source", "text", "doc_id").select("doc_id", "source")


_NAMES = """(SELECT p_partkey, p_type, p_name || ' ' || left(p_brand, 6 + p_partkey % 3) || CASE WHEN p_partkey % 5 = 0
  THEN ' size ' || CAST(p_size AS VARCHAR) ELSE '' END AS text FROM part)"""


@query(
    f"SELECT p_partkey, p_type FROM {_NAMES} d WHERE EXISTS (SELECT 1 FROM {_NAMES} t WHERE t.p_type = d.p_type "
    "AND contains(t.text, d.text) AND t.text <> d.text)"
)
def truncated_names(spark: SparkSession, folder: str) -> DataFrame:
    from shelfsift.operators.truncation import truncated_items

    key = F.col("p_partkey")
    text = F.concat(
        "p_name", F.lit(" "), F.substring("p_brand", F.lit(1), (6 + key % 3).cast("int")),
        F.when(key % 5 == 0, F.concat(F.lit(" size "), F.col("p_size").cast("string"))).otherwise(""))
    named = table(spark, folder, "part").select("p_partkey", "p_type", text.alias("text"))
    return truncated_items(named, "p_type", "text", "p_partkey").select("p_partkey", "p_type")


@query("SELECT doc_id, source, n_chars FROM documents")
def ordered_within_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each node together and in text order, as the per-node writer lays them out."""
    return documents(spark, folder, "doc_id", "source", "n_chars", "text").repartitionByRange(
        "source", "text", "doc_id").sortWithinPartitions("source", "text", "doc_id").drop("text")


@query("SELECT p_brand, p_name FROM part ORDER BY p_brand, p_name")
def ordered_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_brand", "p_name").orderBy("p_brand", "p_name")


@query("SELECT source, count(*) AS rows FROM documents GROUP BY source ORDER BY rows DESC, source LIMIT 3")
def largest_categories(spark: SparkSession, folder: str) -> DataFrame:
    return category_counts(documents(spark, folder, "source"), "source").limit(3)
