"""Naive Bayes by tables: against Spark's, alone and in a search."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfsift.operators import learners as ln, multinomial
from shelfsift.session import stage


def table(spark, n=80, size=9):
    rng = random.Random(4)
    rows = [(0, Vectors.sparse(size, []), 1.0)]
    for i in range(1, n):
        y = float(rng.random() < 0.5)
        x = {j: float(rng.randint(1, 3)) for j in range(size) if rng.random() < (0.6 if (j % 2) == y else 0.2)}
        rows.append((i, Vectors.sparse(size, sorted(x.items())), y))
    return stage(spark.createDataFrame(rows, ["id", "features", "label"]))


@pytest.mark.parametrize("alpha, prior, most", [(1e-4, True, 1 << 20), (0.3, False, 0)])
def test_says_what_sparks_says(spark, tmp_path, monkeypatch, alpha, prior, most):
    monkeypatch.setattr(multinomial, "MOST_BROADCAST_BYTES", most)
    rows = table(spark)
    plain = ln.score(ln.fit_nb(rows, alpha, prior), rows, "id")
    mine = ln.MultinomialNB(alpha, prior).fit(rows)
    mine.write().save(str(tmp_path / "m"))
    for model in (mine, multinomial.MultinomialTable.load(str(tmp_path / "m"))):
        got, want = (np.array(sorted(tuple(r) for r in df.collect())) for df in (ln.score(model, rows, "id"), plain))
        assert np.allclose(got, want)


def test_no_vector_of_the_vocabulary_is_made(spark, monkeypatch):
    """The search that range_search makes asks Spark's fit for nothing, and says what fits of their own say."""
    rows = table(spark)
    spark_nb = NaiveBayes()
    want = ln.search(rows, {"NB": (spark_nb, ln.grid(spark_nb, smoothing=ln.NB_ALPHAS))}, "id", folds=3, draws=4)
    monkeypatch.setattr(NaiveBayes, "_fit", lambda *_: pytest.fail("filled"))
    monkeypatch.setattr(multinomial, "MARGINS", 6)
    mine = ln.MultinomialNB()
    got = ln.search(rows, {"NB": (mine, ln.grid(mine, alpha=[float(a) for a in ln.NB_ALPHAS]))}, "id", folds=3, draws=4)
    assert [t.score for t in got] == pytest.approx([t.score for t in want])
    assert got[0].params["alpha"] == want[0].params["smoothing"]
    assert got[0].model.transform(rows).count() == 80


def test_one_class_and_values_below_0(spark):
    one = table(spark).where("label = 1")
    assert {r["prediction"] for r in ln.MultinomialNB().fit(one).transform(one).collect()} == {0.0}
    below = spark.createDataFrame([(Vectors.dense(-1.0, 2.0), 0.0), (Vectors.dense(1.0, 0.0), 1.0)], ["features", "label"])
    with pytest.raises(ValueError):
        ln.MultinomialNB().fit(below)
