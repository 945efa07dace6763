"""Labelling, filtering and deduplication of item rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.text import like_text, split_tokens

# Canonical column names, reasons and the labels made from them.
CANONICAL_NAMES = {
    "description": "description_mod1",
    "category_id": "category_id_mod1",
    "category_path": "category_full_path_mod1",
}
INCLUDED = ("Category Include", "Category Include Description")
SCRAPED = ("Scraped Category", "Scraped Category & Brand", "Scraped Brand")
MISCATEGORIZED = "Miscategorized"
TRUE_POSITIVE, FALSE_POSITIVE, FALSE_NEGATIVE, OTHER = "True Positive", "False Positive", "False Negative", "Other"
CONFIDENT = 0.7


def rename_canonical(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(CANONICAL_NAMES)


def annotate_type(df: DataFrame, inclusion: str, exclusion: str, name: str = "type") -> DataFrame:
    """Add whether a row is a true / false positive or a false negative of its category."""
    inc, exc = F.col(inclusion), F.col(exclusion)
    kind = (
        F.when(inc.isin(*INCLUDED) & exc.isNull(), FALSE_NEGATIVE)
        .when(exc == MISCATEGORIZED, FALSE_POSITIVE)
        .when((inc.isNull() | inc.isin(*SCRAPED)) & exc.isNull(), TRUE_POSITIVE)
        .otherwise(OTHER)
    )
    return df.withColumn(name, kind)


def annotated_training_rows(
    df: DataFrame, keep: Sequence[str], categories: Sequence[object], category: str, snapshot: Column,
    inclusion: str, exclusion: str, do_use: str,
) -> DataFrame:
    """Distinct (type, kept columns) of one snapshot, chosen categories and usable rows."""
    usable = (
        F.col(category).isin(*categories)
        & snapshot
        & (F.col(exclusion).isNull() | (F.col(exclusion) == MISCATEGORIZED))
        & (F.col(do_use).isNull() | (F.col(do_use) == "Y"))
    )
    return annotate_type(df.where(usable), inclusion, exclusion).select("type", *keep).distinct()


def recent_slice(df: DataFrame, ts: str, since: Column, columns: Sequence[str]) -> DataFrame:
    """Distinct rows from ``since`` on."""
    return df.where(F.col(ts) >= since).select(*columns).distinct()


def positives_negatives(df: DataFrame, cat: object, category: str, text: str, kind: str = "type") -> DataFrame:
    """Labelled texts for one category: 1 for its true positives, 0 for the true positives of other
    categories and its own false positives. Each side is deduplicated alone, so a text may be on both.
    """
    inside = F.col(category) == cat
    positive = inside & (F.col(kind) == TRUE_POSITIVE)
    negative = (~inside & (F.col(kind) == TRUE_POSITIVE)) | (inside & (F.col(kind) == FALSE_POSITIVE))
    label = F.when(positive, 1.0).when(negative, 0.0)
    return df.select(text, label.alias("label")).where(F.col("label").isNotNull()).distinct()


def binary_target(df: DataFrame, kind: str = "type", name: str = "target") -> DataFrame:
    return df.withColumn(name, F.when(F.col(kind) == FALSE_POSITIVE, "False").otherwise("Positive"))


def mark_negative(df: DataFrame, cat: object, category: str, name: str = "target") -> DataFrame:
    """A pool of items outside one category, all marked as negatives."""
    return df.where(F.col(category) != cat).withColumn(name, F.lit("False"))


def mark_positive(df: DataFrame, cat: object, category: str, name: str = "target") -> DataFrame:
    return df.withColumn(name, F.when(F.col(category) == cat, "Positive").otherwise("False"))


def drop_categories(
    df: DataFrame, category: str, contains: Sequence[str] = (), equals: Sequence[object] = (), only: str | None = None
) -> DataFrame:
    """Leave out categories by part of their name or whole name; ``only`` keeps a regular expression."""
    for part in contains:
        df = df.where(~F.col(category).contains(part))
    if equals:
        df = df.where(~F.col(category).isin(*equals))
    return df if only is None else df.where(F.col(category).rlike(only))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace a column by an expensive value that filters and groupings above may use freely.

    A filter on a plain projected column is pushed below the projection, which then computes the
    value twice; it is not pushed through the explode of a one-element array.
    """
    return df.select(*[F.explode(F.array(value)).alias(name) if c == name else F.col(c) for c in df.columns])


def min_tokens(df: DataFrame, text: str, n: int = 2) -> DataFrame:
    """Rows whose text has at least ``n`` tokens; a null text has none."""
    return df.where(F.size(split_tokens(text)) >= n)


def confident(df: DataFrame, prob: str = "probability", cut: float = CONFIDENT) -> DataFrame:
    return df.where(F.col(prob) >= cut)


def candidates(df: DataFrame, truth: str, pred: str, path: str) -> DataFrame:
    """Items that are not in a category but are predicted to be."""
    return df.where((F.col(truth) != path) & (F.col(pred) == path))


def misclassified(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.where(F.col(truth) != F.col(pred))


def label_contains(df: DataFrame, label: str, wanted: str, unwanted: str | None = None) -> DataFrame:
    """Case-insensitive contains / does not contain on a predicted label."""
    kept = df.where(F.col(label).ilike(like_text(wanted)))
    return kept if unwanted is None else kept.where(~F.col(label).ilike(like_text(unwanted)))


def _first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[Column]:
    """Aggregates that pick all columns but ``keys`` from the first row by ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and len(order) == 1:
        return [F.min(order[0]).alias(order[0])]
    first = F.min(F.struct(*order, *rest))
    return [first[c].alias(c) for c in [*order, *rest]]


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key combination, the first by ``order``.

    A grouped minimum instead of a window: copies collapse before the shuffle, so a text copied
    over a third of the table costs one row per input partition.
    """
    first = _first_rows(df, keys, order)
    return df.groupBy(*keys).agg(*first).select(*df.columns)


def dedup_drop_conflicts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Only rows whose key combination occurs once; keys that occur more often vanish wholly."""
    first = _first_rows(df, keys, order)
    return df.groupBy(*keys).agg(*first, F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).select(*df.columns)


def dedup_unambiguous(df: DataFrame, text: str, category: str, order: Sequence[str]) -> DataFrame:
    """``dedup_keep_first([text, category])`` followed by ``dedup_drop_conflicts([text])`` in one shuffle.

    A text stays when all its copies agree on the category, nulls counting as a category.
    """
    first = _first_rows(df, [text], order)
    c = F.col(category)
    agree = F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1))))
    return df.groupBy(text).agg(*first, agree.alias("_agree")).where("_agree").select(*df.columns)


def drop_small_classes(df: DataFrame, cls: str, min_rows: int = 5) -> DataFrame:
    """Rows of classes with at least ``min_rows`` rows; only the class counts are shuffled by class."""
    kept = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(cls)
    return df.join(kept, cls, "left_semi")


def union_labelled(*parts: DataFrame) -> DataFrame:
    """All rows one after the other, columns by name, missing ones null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def with_hard_rows(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """A training set with its misclassified rows repeated once."""
    return df.unionAll(misclassified(df, truth, pred))


def split_hash(df: DataFrame, key: str, share: float, name: str = "is_train") -> DataFrame:
    """Repeatable split: the first digits of a digest of ``key`` decide the side."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int")
    return df.withColumn(name, bucket < int(65536 * share))


def assign_fold(df: DataFrame, key: str, folds: int = 5, name: str = "fold") -> DataFrame:
    """Repeatable fold number from a digest of ``key``."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int")
    return df.withColumn(name, F.pmod(bucket, F.lit(folds)))


def best_of(df: DataFrame, within: Sequence[str], score: str, rank: str, prefer: str = "first") -> DataFrame:
    """The row with the highest ``score`` per group; ties go to the first or the newest by ``rank``."""
    tie = -F.col(rank) if prefer == "first" else F.col(rank)
    rest = [c for c in df.columns if c not in within and c not in (score,)]
    best = F.max(F.struct(F.col(score).alias(score), tie.alias("_tie"), *rest))
    picked = df.groupBy(*within).agg(best.alias("_best")) if within else df.agg(best.alias("_best"))
    return picked.select(*[c if c in within else F.col("_best")[c].alias(c) for c in df.columns])
