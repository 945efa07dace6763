"""Trees and forests on sparse rows."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors

from shelfsift.operators import learners as ln
from shelfsift.session import stage


def table(spark, seed, n=200, size=8, values=(0.0, 0.0, 1.0, 2.0), classes=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x = [rng.choice(values) for _ in range(size)]
        y = float(int(x[1] + x[3] + rng.random() * 1.5 > x[5] + 1.2) + (classes > 2 and x[0] > 0))
        rows.append((i, Vectors.dense(x) if i % 2 else Vectors.sparse(size, [(j, v) for j, v in enumerate(x) if v]), y))
    return stage(spark.createDataFrame(rows, ["id", "features", "label"]))


def said(model, rows):
    return [(r["id"], r["prediction"], [round(p, 9) for p in r["probability"].toArray()]) for r in model.transform(rows).orderBy("id").collect()]


@pytest.mark.parametrize("values, classes", [((0.0, 0.0, 1.0), 2), ((0.0, 0.0, 1.0, 2.0), 3), ((-1.5, 0.0, 2.0), 2), ((1.0, 2.0), 2)])
def test_a_tree_says_what_sparks_tree_says(spark, values, classes):
    rows = table(spark, 3, values=values, classes=classes)
    for criterion, depth, least in (("gini", 1, 1), ("entropy", 3, 1), ("gini", 4, 10)):
        own = ln.Trees(impurity=criterion, maxDepth=depth, minInstancesPerNode=least).fit(rows)
        spark_tree = DecisionTreeClassifier(impurity=criterion, maxDepth=depth, minInstancesPerNode=least, seed=1).fit(rows)
        assert said(own, rows) == said(spark_tree, rows)


def test_a_forest_without_draws_is_the_tree(spark):
    rows = table(spark, 4)
    forest = ln.fit_forest(rows, trees=3, max_depth=4, max_features="all", bootstrap=False, criterion="entropy")
    assert said(forest, rows) == said(ln.fit_tree(rows, "entropy", 4), rows)


def test_a_forest_draws_rows_and_features(spark):
    rows = table(spark, 5, n=400)
    model = ln.fit_forest(rows, trees=6, max_depth=4, max_features=3)
    trees = model.stages[0].trees
    assert len({str(t) for t in trees}) == 6
    assert sum(y == r["label"] for (_, y, _), r in zip(said(model, rows), rows.orderBy("id").collect())) > 300
    again = ln.fit_forest(rows, trees=6, max_depth=4, max_features=3)
    assert again.stages[0].trees == trees


def test_vectors_of_any_length(spark):
    """A filled row of these would take 8 GB."""
    size = 1_000_000_000
    rows = stage(spark.createDataFrame(
        [(i, Vectors.sparse(size, [(i, 1.0), (999_999_000 + i % 4, 1.0)]), float(i % 4 in (1, 2))) for i in range(40)], ["id", "features", "label"]))
    for model in (ln.fit_tree(rows, max_depth=3), ln.fit_forest(rows, trees=2, max_depth=3, max_features="all", bootstrap=False)):
        assert [y for _, y, _ in said(model, rows)] == [float(i % 4 in (1, 2)) for i in range(40)]
    assert len(said(ln.fit_forest(rows, trees=2, max_depth=3, max_features=5), rows)) == 40


@pytest.mark.parametrize("data", [[(0, [], 1.0)], [(0, [(1, 1.0)], 0.0), (1, [(1, 1.0)], 1.0)]])
def test_rows_that_cannot_be_split(spark, data):
    rows = spark.createDataFrame([(i, Vectors.sparse(3, x), y) for i, x, y in data], ["id", "features", "label"])
    for model in (ln.fit_tree(rows), ln.fit_forest(rows, trees=2)):
        assert len(said(model, rows)) == len(data)


def test_search_of_trees_equals_fits_of_their_own(spark):
    rows = table(spark, 6)
    known = {n: (e, ln.grid(e, **g)) for n, e, g in (
        ("tree", ln.Trees(), {"impurity": ["gini", "entropy"], "maxDepth": [1, 4]}),
        ("forest", ln.Trees(3), {"featureSubsetStrategy": ["all"], "bootstrap": [False], "maxDepth": [2, 5], "minInstancesPerNode": [1, 20]}))}
    alone = {}
    for name, (estimator, maps) in known.items():
        plain = type("Alone", (ln.Trees,), {"rivals": property(lambda self: getattr(self, "none"))})(estimator.getOrDefault("numTrees"))
        alone[name] = (plain, [{plain.getParam(p.name): v for p, v in m.items()} for m in maps])
    for shared, single in zip(ln.search(rows, known, "id", folds=2, draws=3), ln.search(rows, alone, "id", folds=2, draws=3)):
        assert shared.params == single.params and shared.score == pytest.approx(single.score)
        assert said(shared.model, rows) == said(single.model, rows)
