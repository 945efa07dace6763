"""Joins that stay balanced when a few keys hold most of the rows, and the joins of item reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.text import like_text

HOT_SHARE = 0.001  # at most 1 / HOT_SHARE keys can each hold this share of the rows
SALTS = 32
MOST_BROADCAST_BYTES = 16 << 20


def hot_keys(weights: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """The keys that hold at least ``HOT_SHARE`` of all rows: never more than 1 / HOT_SHARE of them."""
    least = weights.agg(F.sum(rows) * HOT_SHARE).scalar()
    return weights.where(F.col(rows) >= least).select(*keys)


def broadcast_small(df: DataFrame, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the measured bytes of the (staged, hence cheap to read) table allow it, else leave the choice to Spark."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    row = sum(texts, F.lit(8 + 8 * len(df.columns)))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0] <= most else df


def skew_join(
    many: DataFrame, one: DataFrame, keys: Sequence[str], weights: DataFrame, rows: str = "n", how: str = "inner"
) -> DataFrame:
    """Join ``many`` with ``one`` (at most one row per key) when some keys are very frequent in ``many``.

    ``weights`` says how many rows of ``many`` hold each key. Hot keys - a number bounded by
    1 / HOT_SHARE, so safe to broadcast - are salted: their rows in ``many`` spread over SALTS
    sub-keys and their single row in ``one`` is repeated SALTS times.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(weights, keys, rows).withColumn("_hot", F.lit(True)))
    salted = many.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(0).cast("int")
    ).drop("_hot")
    repeated = one.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return salted.join(repeated, keys + ["_salt"], how).drop("_salt")


def with_category_path(items: DataFrame, dim: DataFrame, key: str = "category_id", path: str = "category_path") -> DataFrame:
    """Items with the path of their category, null where the category is unknown.

    The dimension is made distinct first; Spark broadcasts it while its measured size allows.
    """
    return items.join(dim.select(key, path).distinct(), key, "left")


def join_truth(preds: DataFrame, truth: DataFrame, text: str, condition: Column | None = None) -> DataFrame:
    """Predictions with the truth rows of the same text, without duplicates.

    Both sides lose their own copies before the join, so a text copied a million times on each
    side still gives one pair.
    """
    joined = preds.distinct().join(truth.distinct(), text, "inner")
    if condition is not None:
        joined = joined.where(condition)
    return joined.distinct()


def missing_item_report(
    preds: DataFrame, truth: DataFrame, text: str, category: str, wanted: str, unwanted: str | None = None,
    truth_category: str = "category_id", label: str = "predicted_category", prob: str = "probability",
) -> DataFrame:
    """Items outside ``category`` whose predicted label contains ``wanted``, most probable first."""
    keep = F.col(label).ilike(like_text(wanted)) & (F.col(truth_category) != category)
    if unwanted is not None:
        keep = keep & ~F.col(label).ilike(like_text(unwanted))
    return join_truth(preds, truth, text, keep).orderBy(F.desc(prob), text, label)


def ambiguous_labels(df: DataFrame, truth: str, pred: str, *extra: str) -> DataFrame:
    """Truth labels that received more than one distinct prediction."""
    return (
        df.groupBy(truth, *extra).agg(F.count_distinct(pred).alias("predictions")).where(F.col("predictions") > 1)
    )


def drill_down(df: DataFrame, keys: Sequence[str], only: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """Rows per key combination, restricted to the values of ``on`` found in ``only``."""
    kept = df if only is None else df.join(only.select(on).distinct(), on, "left_semi")
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def vector_lookup(index: DataFrame, vectors: DataFrame, word: str, vector: str, dim: int) -> DataFrame:
    """Every indexed word with its vector; words without one get zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return index.join(vectors.select(word, vector), word, "left").withColumn(vector, F.coalesce(vector, zeros))


def with_class_rows(df: DataFrame, cls: str, name: str = "class_rows") -> DataFrame:
    """Each row with the row count of its class; the counts, not the classes, travel."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias(name)).withColumnRenamed(cls, "_class")
    return df.join(counts, F.col(cls).eqNullSafe(F.col("_class"))).drop("_class")
