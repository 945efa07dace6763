"""The jobs a user runs: prepare, sample, balance, index, score and report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions.text import prediction_label, process_string
from shelfsift.operators import bayes, learners
from shelfsift.operators.counts import category_counts
from shelfsift.operators.joins import ambiguous_labels, drill_down, join_truth, with_category_path, with_class_rows
from shelfsift.operators.prep import (
    candidates, computed_once, confident, dedup_unambiguous, drop_categories, drop_small_classes, min_tokens, misclassified,
)
from shelfsift.operators.features import count_features
from shelfsift.operators.ranks import cap_per_class, systematic_sample
from shelfsift.sources.files import write_predictions
from shelfsift.sources.models import load_model, save_model


def clean_items(items: DataFrame, id: str, text: str, category: str) -> DataFrame:
    """Normalised texts of at least two tokens; one row per text, none whose copies disagree on the category."""
    known = items.where(F.col(text).isNotNull()).select(id, text, category)
    cleaned = computed_once(known, text, process_string(text))
    return dedup_unambiguous(min_tokens(cleaned, text), text, category, [id])


def prepare_training(items: DataFrame, id: str, text: str, category: str, min_rows: int = 5) -> DataFrame:
    """``clean_items`` without the categories that are too small to learn from."""
    return drop_small_classes(clean_items(items, id, text, category), category, min_rows)


def sample_nodes(
    items: DataFrame, id: str, text: str, category: str, k: int, dim: DataFrame | None = None
) -> DataFrame:
    """At most ``k`` items per node at equal steps through its texts in order, with the node's path."""
    sampled = systematic_sample(items.select(id, text, category), category, [text, id], k)
    return sampled if dim is None else with_category_path(sampled, dim, category)


def build_balanced(
    items: DataFrame, id: str, category: str, n: int = 1000, contains: Sequence[str] = ("Other",),
    equals: Sequence[str] = ("Books",), seed: int | None = None,
) -> DataFrame:
    """Catch-all categories left out, class sizes noted, at most ``n`` rows per class."""
    kept = drop_categories(items, category, contains, equals)
    return cap_per_class(with_class_rows(kept, category), category, n, id, seed)


def score_and_report(
    train: DataFrame, items: DataFrame, id: str, text: str, category: str, cut: float = 0.7,
    smoothing: str = "laplace", prior: str = "count",
) -> DataFrame:
    """Items confidently predicted to belong to another category than their own, most probable first."""
    index = bayes.nb_index(train, id, text, category)
    scored = confident(bayes.nb_predict(items, id, text, index, smoothing, prior), cut=cut)
    known = join_truth(scored, items.select(id, category), id)
    return misclassified(known, category, "predicted_category").orderBy(F.desc("probability"), id)


def missing_items(
    index: bayes.TokenIndex, items: DataFrame, id: str, text: str, category: str, path: str, **how: str
) -> DataFrame:
    """Items outside ``path`` that the index puts into it."""
    outside = items.where(F.col(category) != path)
    scored = bayes.nb_predict(outside, id, text, index, **how)
    return candidates(scored.join(outside.select(id, category), id), category, "predicted_category", path)


def ambiguity_report(
    df: DataFrame, truth: str, path: str, category_id: str, pred: str
) -> dict[str, DataFrame]:
    """Labels with several predictions, their predictions counted, and the wrong rows."""
    several = ambiguous_labels(df, truth, pred, path)
    return {
        "labels": several,
        "predictions": drill_down(df, [path, category_id, pred], several, truth),
        "wrong": misclassified(df, truth, pred),
        "sizes": category_counts(df, path),
    }


def train_node_models(
    items: DataFrame, category: str, text: str, path: str, kind: str = "type", features: Pipeline | None = None,
    trainer: Callable[[DataFrame], Model] | None = None, categories: Sequence[object] | None = None, c: float = 1.0,
) -> DataFrame:
    """(category, recall, path) of one model per category, saved below ``path`` with the features they share.

    ``items`` is annotated (``kind`` says true or false positive). The features are fitted once. Without
    a ``trainer`` all categories get a logistic model of strength ``c``, fitted together and saved as one;
    a trainer fits them one by one.
    """
    spark = items.sparkSession
    features = features or count_features(text, binary=True, stop_words=True)
    if trainer is None:
        fitted, models, recalls = learners.train_categories_together(items, category, text, features, kind, categories, c)
        fitted.write().overwrite().save(f"{path}/features")
        save_model(models, {"category": category, "text": text}, f"{path}/models")
        told = [(str(cat), float(recalls[cat]), f"{path}/models#{code}") for code, cat in enumerate(recalls)]
        return spark.createDataFrame(told, "category string, recall double, path string")
    fitted, found = learners.train_per_category(items, category, text, trainer, features, kind, categories)
    fitted.write().overwrite().save(f"{path}/features")
    rows = []
    for i, (cat, (model, recall)) in enumerate(found.items()):
        place = f"{path}/models/{i}"
        save_model(model, {"category": cat, "recall": recall, "text": text}, place)
        rows.append((str(cat), float(recall), place))
    return spark.createDataFrame(rows, "category string, recall double, path string")


TOLD = "description_mod1 string, predicted_category string, probability double"


def _told(scored: DataFrame, text: str, category: Column, cut: float) -> DataFrame:
    """What a row with the probability of class 1 says: the category id, or ``not <id>``, with the probability of that."""
    inside = F.col("probability") > 0.5
    told = scored.select(
        F.col(text).alias("description_mod1"), prediction_label(inside, category).alias("predicted_category"),
        F.when(inside, F.col("probability")).otherwise(1 - F.col("probability")).alias("probability"))
    return confident(told, cut=cut)


def score_with_models(spark: SparkSession, path: str, items: DataFrame, text: str, sink: str, cut: float = 0.7) -> DataFrame:
    """Items scored with all category models that :func:`train_node_models` has fitted together, in one pass; the confident rows are appended to ``sink``, which is returned."""
    features = PipelineModel.load(f"{path}/features")
    models, meta = load_model(spark, f"{path}/models")
    scored = models.transform(features.transform(items.withColumnRenamed(text, meta["text"])).select(meta["text"], "features"))
    write_predictions(_told(scored, meta["text"], F.col("category"), cut), sink)
    return spark.read.schema(TOLD).parquet(sink)


def score_with_model(
    spark: SparkSession, path: str, model_path: str, items: DataFrame, text: str, sink: str, cut: float = 0.7,
) -> DataFrame:
    """Items scored with one saved category model; the confident ones are appended to ``sink``, which is returned.

    ``path`` holds the features, ``model_path`` is what :func:`train_node_models` says: of models fitted
    together the number of the category comes after a ``#``.
    """
    place, _, code = model_path.partition("#")
    model, meta = load_model(spark, place)
    vectors = PipelineModel.load(f"{path}/features").transform(items.withColumnRenamed(text, meta["text"]))
    if code:
        told = _told(model.stages[-1].only(int(code)).transform(vectors), meta["text"], F.col("category"), cut)
    else:
        told = _told(learners.score(model, vectors, meta["text"]), meta["text"], F.lit(meta["category"]), cut)
    write_predictions(told, sink)
    return spark.read.schema(TOLD).parquet(sink)
