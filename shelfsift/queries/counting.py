"""Counts, itemsets, crosstabs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions.text import process_string, token_count
from shelfsift.operators import counts
from shelfsift.queries import query, table
from shelfsift.queries.fragments import ITEM, alnum_words, documents, items, processed, raw_words


@query("SELECT source, count(*) AS rows FROM documents WHERE source IS NOT NULL GROUP BY source")
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.category_counts(documents(spark, folder, "source"), "source")


@query("SELECT label AS cluster, count(*) AS rows FROM embeddings GROUP BY label")
def label_frequency(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "embeddings").select(F.col("label").alias("cluster"))
    return counts.category_counts(labelled, "cluster")


@query("SELECT DISTINCT p_type, p_brand FROM part")
def distinct_categories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_type", "p_brand").distinct()


@query(
    f"SELECT token, count(*) AS freq FROM (SELECT unnest(string_split({processed('text')}, ' ')) AS token FROM documents) GROUP BY token"
)
def token_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = documents(spark, folder, "text").select(process_string("text").alias("text"))
    return counts.token_frequencies(cleaned, "text")


_SPOTS = (
    f"spots AS (SELECT p_partkey, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM "
    f"(SELECT p_partkey, {alnum_words('lower(' + ITEM + ')')} AS w FROM part))"
)
_SET = "array_to_string(list_sort(list_distinct([{}])), ' ')"


def _chosen(k: int, least: int) -> str:
    names = "abcd"[:k]
    joins = " ".join(
        f"JOIN spots {y} ON {x}.p_partkey = {y}.p_partkey AND {x}.i < {y}.i" for x, y in zip(names, names[1:])
    )
    return f"SELECT {_SET.format(', '.join(f'{x}.t' for x in names))} AS items FROM spots a {joins} WHERE a.n >= {least}"


def _supported(sizes: tuple[int, ...], least: int, lo: float, hi: float) -> str:
    union = " UNION ALL ".join(_chosen(k, least) for k in sizes)
    return (
        f"WITH {_SPOTS}, chosen AS ({union}) SELECT * FROM (SELECT items, count(*) AS hits, "
        f"count(*) / (SELECT count(*) FROM part) AS support FROM chosen GROUP BY items) WHERE support BETWEEN {lo} AND {hi}"
    )


@query(_supported((3, 4), 4, 0.02, 1.0))
def itemsets_3_4(spark: SparkSession, folder: str) -> DataFrame:
    return counts.itemsets(items(spark, folder), "item", (3, 4), 0.02, min_row_tokens=4)


@query(_supported((1, 2), 1, 0.05, 1.0))
def itemsets_1_2(spark: SparkSession, folder: str) -> DataFrame:
    return counts.itemsets(items(spark, folder), "item", (1, 2), 0.05)


@query(
    f"WITH sets AS (SELECT unnest([[t for t, i in w if (mask >> (i - 1)) & 1 = 1] for mask in range(1, 1 << len(w))]) AS s FROM "
    f"(SELECT {alnum_words('lower(' + ITEM + ')')} AS w FROM part)) SELECT * FROM (SELECT "
    "array_to_string(list_sort(list_distinct(s)), ' ') AS items, count(*) AS hits, count(*) / (SELECT count(*) FROM part) AS support "
    "FROM sets GROUP BY 1) WHERE support >= 0.05"
)
def itemsets_all(spark: SparkSession, folder: str) -> DataFrame:
    return counts.itemsets_all(items(spark, folder), "item", 0.05)


@query(
    f"WITH rows AS (SELECT list_sort(list_distinct({alnum_words('lower(' + ITEM + ')')})) AS w FROM part), "
    "full_rows AS (SELECT [[t, CAST(i AS VARCHAR)] for t, i in w] AS w FROM rows WHERE len(w) > 0), "
    "sets AS (SELECT unnest([[t[1] for t in w if (mask >> (CAST(t[2] AS INTEGER) - 1)) & 1 = 1] for mask in range(1, 1 << len(w))]) AS s FROM full_rows) "
    "SELECT array_to_string(s, ' ') AS items, count(*) AS hits FROM sets GROUP BY 1 HAVING count(*) >= ceil(0.05 * (SELECT count(*) FROM full_rows))"
)
def frequent_sets(spark: SparkSession, folder: str) -> DataFrame:
    found = counts.frequent_sets(items(spark, folder), "item", 0.05)
    return found.select(F.array_join(F.array_sort("items"), " ").alias("items"), F.col("freq").alias("hits"))


_MARKED = "(SELECT CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS pred FROM labels)"


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("pred"))


@query(
    "SELECT coalesce(truth, 'All') AS truth, coalesce(pred, 'All') AS pred, count(*) AS rows FROM "
    f"{_MARKED} GROUP BY CUBE (truth, pred)"
)
def crosstab_long(spark: SparkSession, folder: str) -> DataFrame:
    return counts.crosstab_long(_marked(spark, folder), "truth", "pred")


@query(f"SELECT truth, pred, count(*) AS rows FROM {_MARKED} GROUP BY truth, pred")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return counts.confusion(_marked(spark, folder), "truth", "pred")


@query(
    "SELECT truth, pred, rows, round(rows / sum(rows) OVER (PARTITION BY truth), 6) AS share FROM "
    f"(SELECT truth, pred, count(*) AS rows FROM {_MARKED} GROUP BY truth, pred)"
)
def confusion_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return counts.confusion(_marked(spark, folder), "truth", "pred", True).withColumn("share", F.round("share", 6))


@query(
    "SELECT count(*) AS rows, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END), 6) AS accuracy, "
    "round(avg(CASE WHEN quality = 1 THEN (CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END) END), 6) AS recall, "
    "round(avg(CASE WHEN toxic = 1 THEN (CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) END), 6) AS precision FROM labels"
)
def scores(spark: SparkSession, folder: str) -> DataFrame:
    s = counts.scores(table(spark, folder, "labels"), "quality", "toxic")
    return s.select("rows", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "precision")])


@query(f"SELECT source, CAST(max(len({raw_words('text')})) AS INTEGER) AS most_tokens FROM documents GROUP BY source")
def longest_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).groupBy("source").agg(F.max(token_count("text")).alias("most_tokens"))
