"""Category models: fitted together as one by one, scored in one pass as model by model."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from shelfsift.operators import category_models as cm, learners as ln
from shelfsift.operators.features import count_features
from shelfsift.plans import jobs
from shelfsift.sources.models import load_model, save_model


def items(spark, seed=1, n=120):
    rng = random.Random(seed)
    kinds = {"bolts": "red bolt steel long", "caps": "blue cap soft wool", "nuts": "red nut steel small"}
    rows = []
    for i in range(n):
        cat = rng.choice(list(kinds))
        words = rng.sample(kinds[cat].split(), 3) + rng.sample(["new", "old", "red", "soft", f"no{i % 9}"], 2)
        rows.append((" ".join(words), cat, rng.choice(["True Positive"] * 6 + ["False Positive", "Other"])))
    return spark.createDataFrame(rows, "item string, category string, type string")


def vectors(spark, **how):
    return ln.category_vectors(items(spark, **how), "category", "item", count_features("item"))


@pytest.mark.parametrize("cells", [1 << 21, 1])
def test_fitted_together_as_one_by_one(spark, monkeypatch, cells):
    monkeypatch.setattr(cm, "CELLS", cells)
    monkeypatch.setattr(cm, "PIECE", 64)
    fitted, rows = vectors(spark)
    size = ln.vector_size(rows, "features")
    models, recalls = cm.fit_categories(rows, ["bolts", "caps", "nuts"], size, c=2.0)
    found = np.zeros((3, size + 1))
    for r in models.weights.collect():
        found[r["codes"], size if r["place"] == cm.INTERCEPT else r["place"]] = r["coefficients"]
    for j, cat in enumerate(models.categories):
        mine = ln.labelled_for(rows, cat)
        one = LogisticRegression(regParam=ln.reg_param(2.0, mine.count()), standardization=False, maxIter=300, tol=1e-12).fit(mine)
        assert np.abs(found[j] - np.append(one.coefficients.toArray(), one.intercept)).max() < 1e-3
        assert recalls[cat] == pytest.approx(ln._recall(one, mine, "label"))


def test_scored_together_as_one_by_one(spark, tmp_path):
    fitted, rows = vectors(spark)
    models, _ = cm.fit_categories(rows, ["bolts", "caps", "nuts"], ln.vector_size(rows, "features"))
    save_model(models, {}, str(tmp_path / "m"))
    loaded, _ = load_model(spark, str(tmp_path / "m"))
    asked = fitted.transform(spark.createDataFrame([("red bolt steel",), ("nothing known",), ("",), ("red bolt steel",)], "item string")).select("item", "features")
    got = sorted((r["item"], r["category"], round(r["probability"], 9)) for r in loaded.transform(asked).collect())
    weights = {r["place"]: dict(zip(r["codes"], r["coefficients"])) for r in models.weights.collect()}
    want = []
    for r in asked.collect():
        for j, cat in enumerate(models.categories):
            margin = weights[cm.INTERCEPT][j] + sum(x * weights.get(int(i), {}).get(j, 0.0) for i, x in zip(r["features"].indices, r["features"].values))
            want.append((r["item"], cat, round(1 / (1 + np.exp(-margin)), 9)))
    assert got == sorted(want) and len(got) == 12


def test_jobs_train_save_and_score_all_categories(spark, tmp_path):
    train, path = items(spark), str(tmp_path / "models")
    told = jobs.train_node_models(train, "category", "item", path).collect()
    assert {r["category"] for r in told} == {"bolts", "caps", "nuts"} and all(r["recall"] > 0.8 for r in told)
    sink = str(tmp_path / "sink")
    scored = jobs.score_with_models(spark, path, train.select("item"), "item", sink, cut=0.0)
    assert scored.count() == 3 * train.count()
    right = scored.join(train.where("type = 'True Positive'"), (F.col("description_mod1") == F.col("item")) & (F.col("predicted_category") == F.col("category")))
    assert right.select("item", "category").distinct().count() > 0.8 * train.where("type = 'True Positive'").select("item", "category").distinct().count()
    one_by_one = jobs.train_node_models(train, "category", "item", str(tmp_path / "single"), trainer=lambda rows: ln.fit_lr(rows)).collect()
    single = jobs.score_with_model(spark, str(tmp_path / "single"), one_by_one[0]["path"], train.select("item"), "item", str(tmp_path / "single_sink"), cut=0.0)
    assert single.count() == train.count()


def test_category_without_rows(spark):
    _, rows = vectors(spark, n=20)
    models, recalls = cm.fit_categories(rows.limit(0), ["bolts"], ln.vector_size(rows, "features"))
    assert recalls == {"bolts": 0.0} and [r["coefficients"] for r in models.weights.collect()] == [[0.0]]


def test_outside_models_get_sparse_batches(spark):
    _, rows = vectors(spark)
    seen = "places, values, first, size"

    def make_predict():
        def predict(places, values, first, size):
            assert len(first) <= 8 and len(places) == len(values) == first[-1] and (places < size).all(), seen
            return np.array([(values[a:b] * (places[a:b] + 1)).sum() for a, b in zip(first[:-1], first[1:])])
        return predict

    scored = ln.score_batches(rows, "features", make_predict, batch=7, name="sum").collect()
    assert len(scored) == rows.count() and all(r["sum"] == sum(x * (i + 1) for i, x in zip(r["features"].indices, r["features"].values)) for r in scored)
    assert ln.score_batches(rows.limit(0), "features", make_predict).collect() == []
