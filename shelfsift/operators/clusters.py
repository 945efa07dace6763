"""Partition clustering and topics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.operators.features import CountTokens
from shelfsift.operators.ranks import systematic_sample
from shelfsift.operators.topics import Topics
from shelfsift.session import stage


def kmeans(df: DataFrame, vec: str, k: int, iters: int = 10, seed: int = 1) -> KMeansModel:
    return KMeans(k=k, maxIter=iters, seed=seed, featuresCol=vec, predictionCol="cluster").fit(df)


@dataclass(frozen=True)
class Centres:
    """Cluster centres; ``transform`` assigns every row to its nearest."""

    points: np.ndarray
    vec: str

    def transform(self, df: DataFrame) -> DataFrame:
        points = self.points
        half = (points**2).sum(axis=1) / 2

        @F.pandas_udf("int")
        def nearest(rows: pd.Series) -> pd.Series:
            return pd.Series((half - np.stack(rows.to_numpy()) @ points.T).argmin(axis=1) if len(rows) else [], dtype="int32")

        return df.withColumn("cluster", nearest(vector_to_array(self.vec)))


def minibatch_kmeans(df: DataFrame, id: str, vec: str, k: int, batches: int = 10, epochs: int = 2, seed: int = 1) -> Centres:
    """Centres moved batch after batch, each by the mean of its new rows against all rows it has had.

    Batches are dealt by a hash of the id and together hold every row. Each is one grouped mean, of
    which k rows reach the driver. The first centres are the k rows with the smallest hash.
    """
    order = F.xxhash64(id, F.lit(seed))
    rows = stage(df.select(F.col(id).alias("_id"), F.col(vec).alias("_vec"), order.alias("_order"), F.pmod(order, F.lit(batches)).alias("_batch")))
    first = rows.orderBy("_order", "_id").limit(k).collect()
    points, seen = np.array([r["_vec"].toArray() for r in first]), np.zeros(len(first))
    for batch in [b for _ in range(epochs) for b in range(batches)]:
        placed = Centres(points, "_vec").transform(rows.where(F.col("_batch") == batch))
        for r in placed.groupBy("cluster").agg(Summarizer.mean(F.col("_vec")).alias("mean"), F.count(F.lit(1)).alias("n")).collect():
            seen[r["cluster"]] += r["n"]
            points[r["cluster"]] += (r["mean"].toArray() - points[r["cluster"]]) * r["n"] / seen[r["cluster"]]
    return Centres(points, vec)


def cluster_tree(df: DataFrame, vec: str, leaves: int, iters: int = 10, seed: int = 1):
    """Clusters by repeated splitting, the tree form that scales."""
    return BisectingKMeans(k=leaves, maxIter=iters, seed=seed, featuresCol=vec, predictionCol="cluster").fit(df)


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), cluster)


def cluster_sample(df: DataFrame, cluster: str, order: Sequence[str], k: int) -> DataFrame:
    """Rows at equal steps through each cluster, as its representatives."""
    return systematic_sample(df, cluster, order, k)


def topics(df: DataFrame, tokens: Column, k: int, iters: int = 10, vocab: int | None = None, seed: int = 1) -> PipelineModel:
    """Topic model over the counts of all tokens, unless ``vocab`` limits them, fitted online."""
    bags = df.select(tokens.alias("_tokens"))
    return Pipeline(stages=[
        CountTokens([], ["_tokens"], "_bag", limit=vocab),
        Topics(k, iters, seed, "_bag", "topics"),
    ]).fit(bags)


def topic_words(model: PipelineModel, n: int = 10) -> DataFrame:
    """(topic, rank, word, weight) of the heaviest words of each topic."""
    counter, lda = model.stages
    heaviest = counter.vocabulary.sparkSession.createDataFrame(lda.heaviest(n), "topic int, rank int, _at int, weight double")
    # k * n rows at most meet the vocabulary.
    words = counter.vocabulary.select(F.col("place").alias("_at"), F.col("token").alias("word"))
    return words.join(F.broadcast(heaviest), "_at").select("topic", "rank", "word", "weight")
