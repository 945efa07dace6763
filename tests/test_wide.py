"""Models whose weights are tables, against Spark's own fits and plain numpy."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfsift.operators import learners as ln, wide
from shelfsift.session import stage
from shelfsift.sources.models import load_model, save_model


def table(spark, n=60, size=40, seed=1):
    """(id, features, label, w): counts, some features constant or empty, labels that lean on two; one row twice, one without entries."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        x = {j: float(rng.choice([1, 1, 1, 2, 300])) if j % 5 else 0.5 for j in range(1, size - 1) if rng.random() < 0.2} | {0: 1.0}
        rows.append((i, Vectors.sparse(size, sorted(x.items()) if i else []), float(x.get(3, 0) + x.get(4, 0) + rng.random() > 1.1), 1.0 + i % 3))
    return stage(spark.createDataFrame([*rows, rows[5]], ["id", "features", "label", "w"]).repartition(5))


def scored(model, rows):
    return np.array(sorted(map(tuple, ln.score(model, rows, "id").collect())))


@pytest.mark.parametrize("weight, decay", [(None, 0.05), ("w", 0.01), (None, 0.0)])
def test_logistic_regression_takes_the_steps_of_sparks(spark, monkeypatch, tmp_path, weight, decay):
    """F2 F10 F15 F17 F20: the same model, and nobody asks Spark for a fit."""
    rows, how = table(spark), {"regParam": decay, "maxIter": 5} | ({"weightCol": weight} if weight else {})
    plain = LogisticRegression(**how).fit(rows)
    want = scored(plain, rows)
    monkeypatch.setattr(ln, "WIDE", 1)
    monkeypatch.setattr(wide, "BLOCK", 8)
    monkeypatch.setattr(wide, "CHUNK", 16)
    monkeypatch.setattr(wide, "MAPPED", 64)
    monkeypatch.setattr(LogisticRegression, "_fit", lambda *_: pytest.fail("weights on the driver"))
    model = ln.Logistic(**how).fit(rows)
    assert np.allclose(scored(model, rows), want, atol=1e-6)
    assert np.allclose(model.coefficients, plain.coefficients.toArray(), atol=1e-6) and model.intercept == pytest.approx(plain.intercept, abs=1e-6)
    save_model(ln.PipelineModel([model]), {}, str(tmp_path / "m"))
    assert np.allclose(scored(load_model(spark, str(tmp_path / "m"))[0], rows), want, atol=1e-6)


def test_refits_and_longer_training_are_of_the_same_kind(spark, monkeypatch):
    rows = table(spark)
    want = scored(ln.refit_on_errors(LogisticRegression(maxIter=2, regParam=0.5).fit(rows), LogisticRegression(maxIter=4, regParam=0.1), rows.drop("w")), rows)
    history = ln.fit_epochs(LogisticRegression(regParam=0.05), rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), [1, 3])[1]
    monkeypatch.setattr(ln, "WIDE", 1)
    monkeypatch.setattr(LogisticRegression, "_fit", lambda *_: pytest.fail("weights on the driver"))
    assert np.allclose(scored(ln.refit_on_errors(ln.Logistic(maxIter=2, regParam=0.5).fit(rows), ln.Logistic(maxIter=4, regParam=0.1), rows.drop("w")), rows), want, atol=1e-6)
    made, whole = [], wide.columns
    monkeypatch.setattr(wide, "columns", lambda *a: made.append(1) or whole(*a))
    assert ln.fit_epochs(ln.Logistic(regParam=0.05), rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), [1, 3])[1] == history
    assert made == [1]


def test_support_vector_machine_has_sparks_loss_or_less(spark, monkeypatch):
    rows = table(spark)
    x, y = (np.array(v) for v in zip(*((r["features"].toArray(), r["label"]) for r in rows.collect())))

    def loss(model):
        margin = x @ np.asarray(model.coefficients) + model.intercept
        return np.maximum(1 - (2 * y - 1) * margin, 0).mean() + 0.05 / 2 * ((np.asarray(model.coefficients) * x.std(axis=0, ddof=1)) ** 2).sum()

    plain = LinearSVC(regParam=0.05, maxIter=30).fit(rows)
    monkeypatch.setattr(ln, "WIDE", 1)
    monkeypatch.setattr(LinearSVC, "_fit", lambda *_: pytest.fail("weights on the driver"))
    mine = ln.Svm(regParam=0.05, maxIter=30).fit(rows)
    assert loss(mine) <= loss(plain) * 1.01
    told = mine.transform(rows).select("rawPrediction", "prediction").collect()
    assert all((r["rawPrediction"][1] > 0) == (r["prediction"] == 1) for r in told)
    both = ln.fit_svm(rows)
    assert len(scored(both, rows)) == 61


def test_network_learns_without_filled_rows(spark, monkeypatch):
    """rows were filled, 128 at a time, in the executors."""
    rows = table(spark)
    monkeypatch.setattr(ln, "WIDE", 1)
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda *_: pytest.fail("filled"))
    found = scored(ln.fit_mlp(rows, 2, hidden=(4,), iters=25), rows)
    truth = dict(rows.select("id", "label").collect())
    assert np.mean([truth[i] == p for i, p, _ in found]) > 0.8


def test_slopes_of_the_network():
    rng = np.random.default_rng(1)
    z, s = rng.normal(size=(3, 7)), rng.normal(size=3 + 2 * 4)
    value = wide.network(rng.integers(0, 2, 7).astype(float), 3, 2, rng.normal(size=(3, 7)))
    _, dz, ds = value(z, s)
    for i in range(len(s)):
        step = np.eye(len(s))[i] * 1e-6
        assert ds[i] == pytest.approx((value(z, s + step)[0] - value(z, s - step)[0]) / 2e-6, abs=1e-6)
    step = np.zeros_like(z)
    step[1, 4] = 1e-6
    assert dz[1, 4] == pytest.approx((value(z + step, s)[0] - value(z - step, s)[0]) / 2e-6, abs=1e-6)


def test_one_class_is_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(ln, "WIDE", 1)
    one = table(spark).withColumn("label", F.lit(1.0))
    assert {r["prediction"] for r in ln.fit_lr(one).transform(one).collect()} == {1.0}
