"""Topics fitted without a matrix of topics and words."""

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfsift.operators import clusters, topics
from shelfsift.sources.models import load_model, save_model


def test_special_functions():
    assert np.allclose(topics.digamma(np.array([0.1, 1.0, 10.0])), [-10.4237549404, -0.5772156649, 2.2517525891])
    assert np.allclose(topics.trigamma(np.array([0.1, 1.0, 10.0])), [101.4332991508, 1.6449340668, 0.1051663357])
    drawn = topics.begun(np.arange(20_000), 3, 1)
    assert np.allclose(drawn.mean(axis=0), 1, atol=0.01) and np.allclose(drawn.var(axis=0), 0.01, atol=0.001)


def test_a_text_is_read_as_spark_reads_it(spark):
    """The same words under the same topics: the same shares."""
    texts = spark.createDataFrame([(["a", "a", "b"],), (["c", "d", "d", "d"],), (["a", "c"],)], "w array<string>")
    bags = CountVectorizer(inputCol="w", outputCol="f").fit(texts).transform(texts)
    lda = LDA(k=2, maxIter=3, optimizer="online", seed=1, featuresCol="f", subsamplingRate=1.0).fit(bags)
    weights = lda.topicsMatrix().toArray()
    words, alpha = np.exp(topics.digamma(weights) - topics.digamma(weights.sum(axis=0))), np.array(lda.estimatedDocConcentration().toArray())
    for r in lda.transform(bags).collect():
        gamma, _ = topics.inferred(words[r["f"].indices], r["f"].values, alpha, np.ones(2))
        assert np.allclose(gamma / gamma.sum(), r["topicDistribution"].toArray(), atol=0.01)


def test_weights_of_all_words_add_up_and_no_matrix_is_made(spark, monkeypatch, tmp_path):
    """Spark's fit holds a number for each word and topic on the driver, several times."""
    monkeypatch.setattr(LDA, "_fit", lambda *_: pytest.fail("matrix"))
    monkeypatch.setattr(topics, "SHARE", 0.7)
    monkeypatch.setattr(topics, "DELAY", 1)
    texts = spark.createDataFrame([(f"x{i % 3} x{i % 3} y{i % 2} z{i}",) for i in range(30)] + [("",)], "t string").withColumn("w", F.array_remove(F.split("t", " "), ""))
    model = clusters.topics(texts, F.col("w"), 2, 4)
    counter, lda = model.stages
    whole = lda.heaviest(counter.tokens)
    assert len(whole) == 2 * counter.tokens
    for t in range(2):
        assert sum(w for topic, _, _, w in whole if topic == t) == pytest.approx(1)
    mixed = model.transform(texts.withColumnRenamed("w", "_tokens"))
    shares = [tuple(r[0].toArray()) for r in mixed.select("topics").collect()]
    assert all(sum(s) == pytest.approx(1) for s in shares if any(s)) and shares.count((0.0, 0.0)) == 1
    save_model(model, {}, str(tmp_path / "m"))
    again, _ = load_model(spark, str(tmp_path / "m"))
    assert again.stages[1].heaviest(3) == lda.heaviest(3)
