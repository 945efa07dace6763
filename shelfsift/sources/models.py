"""Fitted models with a description beside them."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import Model, PipelineModel
from pyspark.sql import SparkSession


def save_model(model: Model, meta: Mapping[str, object], path: str) -> None:
    """Write a model to ``path``/model and its description (parameters, score, labels) to ``path``/meta."""
    spark = SparkSession.getActiveSession()
    stages = model if isinstance(model, PipelineModel) else PipelineModel([model])
    stages.write().overwrite().save(f"{path}/model")
    described = json.dumps(dict(meta), default=str, sort_keys=True)
    spark.createDataFrame([(described,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, object]]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()["value"])
