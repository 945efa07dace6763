"""Boosting, neighbours of sparse vectors, own models on disk, and the search over all learners."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfsift.operators import boosting, learners as ln, sparse_neighbours as sn
from shelfsift.operators.features import count_features
from shelfsift.operators.sparse import sparse_rows
from shelfsift.session import stage
from shelfsift.sources.models import load_model, save_model


def table(spark, seed, n=60, size=8, most=1):
    """(id, features, label, _cell): sparse counts, labels that lean on three of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rng.randint(0, most)) * (rng.random() < 0.5) for _ in range(size)]
        y = float(x[1] + x[3] + rng.random() * 1.5 > x[5] + 1.2)
        rows.append((i, Vectors.sparse(size, [(j, v) for j, v in enumerate(x) if v]), y, rng.randint(0, 3)))
    return stage(spark.createDataFrame(rows, ["id", "features", "label", "_cell"]))


def boosted_by_trees(rows, rounds, rate):
    """The same boosting with one tree of depth one fitted by Spark in each round: [(place, threshold, votes, share)]."""
    weighted, out = rows.withColumn("_w", F.lit(1.0)), []
    for _ in range(rounds):
        stump = DecisionTreeClassifier(maxDepth=1, weightCol="_w", seed=1, predictionCol="_vote").fit(weighted)
        voted = stump.transform(weighted).drop("probability", "rawPrediction").cache()
        wrong = F.col("_vote") != F.col("label")
        error = voted.agg(F.sum(F.when(wrong, F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
        if error >= 0.5:
            break
        share = rate * math.log((1 - error) / max(error, 1e-12))
        sides = [r["_vote"] for r in voted.select("_vote").distinct().collect()]
        root = stump._call_java("rootNode")
        out.append((root.split().featureIndex(), root.split().threshold(), len(sides), round(share, 9)) if stump.numNodes > 1 else (-1, math.inf, 1, round(share, 9)))
        if error < 1e-12:
            break
        weighted = stage(voted.select(*rows.columns, (F.col("_w") * F.when(wrong, math.exp(share)).otherwise(1.0)).alias("_w")))
    return out


def learnt(rows, settings, rounds, size=8):
    boosting.boost(stage(sparse_rows(rows, "features", F.col("label"), F.col("_cell"))), settings, rounds, size)
    return settings


@pytest.mark.parametrize("seed, most, rate", [(1, 1, 1.0), (2, 3, 0.5)])
def test_boosting_equals_trees_of_depth_one(spark, seed, most, rate):
    rows = table(spark, seed, most=most)
    setting, = learnt(rows, [boosting.Setting(rate)], 6)
    assert [(s[0], s[1], len(set(s[2:4])), round(s[4], 9)) for s in setting.stumps] == boosted_by_trees(rows, 6, rate)


def test_settings_share_a_pass_and_fewer_rounds_are_a_prefix(spark, monkeypatch):
    rows = table(spark, 3, n=80)
    wanted = [(r, c) for r in (0.3, 1.0, 2.0) for c in (None, frozenset({0, 1}), frozenset({1, 2, 3}))]
    together = learnt(rows, [boosting.Setting(*w) for w in wanted], 9)
    for (rate, cells), found in zip(wanted, together):
        mine = rows if cells is None else rows.where(F.col("_cell").isin(sorted(cells)))
        alone, = learnt(mine, [boosting.Setting(rate)], 5)
        assert [s[:4] for s in alone.stumps] == [s[:4] for s in found.stumps[:5]]
        assert np.allclose([s[4] for s in alone.stumps], [s[4] for s in found.stumps[:5]])
    monkeypatch.setattr(boosting, "SUMS", 8 * 2)
    in_parts = learnt(rows, [boosting.Setting(*w) for w in wanted], 9)
    assert [s.stumps for s in in_parts] == [s.stumps for s in together]


def test_recalls_equal_the_models(spark):
    rows = table(spark, 4)
    train, test = frozenset({0, 1}), frozenset({2, 3})
    setting, = learnt(rows, [boosting.Setting(1.0, train)], 7)
    found, there = boosting.recalls(stage(sparse_rows(rows, "features", F.col("label"), F.col("_cell"))), [setting], [test])[0]
    held = rows.where(F.col("_cell").isin(2, 3) & (F.col("label") == 1))
    assert there == held.count()
    for n in range(1, len(setting.stumps) + 1):
        assert found[n - 1] == boosting.BoostedStumps(setting.stumps[:n]).transform(held).where("prediction = 1").count()


def test_boosting_without_a_choice(spark):
    one = spark.createDataFrame([(1, Vectors.sparse(3, [0], [1.0]), 1.0, 0)] * 3, ["id", "features", "label", "_cell"])
    setting, = learnt(one, [boosting.Setting(1.0)], 5, 3)
    assert [s[:4] for s in setting.stumps] == [(-1, math.inf, 1.0, 1.0)]
    even = spark.createDataFrame([(1, Vectors.sparse(3, [], []), y, 0) for y in (0.0, 1.0)], ["id", "features", "label", "_cell"])
    assert learnt(even, [boosting.Setting(1.0)], 5, 3)[0].stumps == []
    with pytest.raises(ValueError):
        ln.fit_ada(even)
    dense = spark.createDataFrame([(Vectors.dense(-1.0, 2.0), 0.0), (Vectors.dense(-3.0, 0.0), 1.0), (Vectors.dense(0.5, 2.0), 0.0)], ["features", "label"])
    assert [r["prediction"] for r in ln.fit_ada(dense, 3).transform(dense).collect()] == [0.0, 1.0, 0.0]


# -- neighbours ------------------------------------------------------------------------------


def points(spark, seed, n, size=12, most=2, signed=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = {j: float(rng.randint(-most if signed else 1, most)) for j in range(size) if rng.random() < (0.9 if j < 3 else 0.2)}
        rows.append((i, Vectors.sparse(size, sorted((j, v) for j, v in x.items() if v)), float(i % 3), rng.randint(0, 2)))
    df = spark.createDataFrame(rows, ["_no", "features", "label", "cell"])
    return rows, stage(sparse_rows(df, "features", F.col("label"), F.col("cell"), "_no"))


def brute(rows, asked, k, cells=None, skip_same=False):
    out = set()
    for no, x, _, _ in asked:
        near = sorted((round(float(((x.toArray() - y.toArray()) ** 2).sum()) ** 0.5, 9), other) for other, y, _, cell in rows
                      if (cells is None or cell in cells) and not (skip_same and other == no))
        out |= {(no, other, d, r) for r, (d, other) in enumerate(near[:k], 1)}
    return out


def found(df, context=0):
    return {(r["test_id"], r["train_id"], round(r["distance"], 9), r["rank"]) for r in df.where(F.col("context") == context).collect()}


@pytest.mark.parametrize("signed, cells, k", [(False, 1 << 18, 4), (False, 40, 4), (True, 60, 3), (False, 30, 500)])
def test_sparse_neighbours_equal_brute_force(spark, monkeypatch, signed, cells, k):
    monkeypatch.setattr(sn, "CELLS", cells)
    monkeypatch.setattr(sn, "ASKED", 3 * cells)
    rows, known = points(spark, 5, 70, signed=signed)
    others, asked = points(spark, 6, 30, signed=signed)
    assert found(sn.sparse_nearest(known, asked, k)) == brute(rows, others, k)
    assert found(sn.sparse_nearest(known, known, k, skip_same=True)) == brute(rows, rows, k, skip_same=True)


@pytest.mark.parametrize("skip_same", [False, True])
def test_copies_are_searched_once(spark, monkeypatch, skip_same):
    """Equal vectors search, and are searched, once; repeated numbers are rows of their own, as before."""
    searched, whole = [], sn._searched
    monkeypatch.setattr(sn, "_searched", lambda known, asked, *more: searched.append((known.count(), asked.count())) or whole(known, asked, *more))
    few = points(spark, 11, 6)[0]
    rows = [(i, few[i * i % 6][1], 0.0, 0) for i in range(40)]
    known = stage(sparse_rows(spark.createDataFrame(rows, ["_no", "features", "label", "cell"]), "features", F.col("label"), F.col("cell"), "_no"))
    different = len({r[1] for r in rows})
    assert found(sn.sparse_nearest(known, known, 4, skip_same=skip_same)) == brute(rows, rows, 4, skip_same=skip_same)
    assert searched == [(different, different)]
    twice = stage(known.unionByName(known))
    assert sn.sparse_nearest(twice, twice, 4, skip_same=skip_same).count() == 160
    assert searched[1] == (80, 80)


def test_contexts_are_searches_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(sn, "CELLS", 50)
    rows, known = points(spark, 7, 60)
    contexts = {0: None, 1: frozenset({0, 2}), 2: frozenset({1})}
    got = stage(sn.sparse_nearest(known, known, 3, contexts))
    for c, cells in contexts.items():
        assert found(got, c) == brute(rows, rows, 3, cells)


def test_empty_tables_and_vectors(spark):
    rows, known = points(spark, 8, 10)
    assert sn.sparse_nearest(known.limit(0), known, 3).count() == 0
    assert sn.sparse_nearest(known, known.limit(0), 3).count() == 0
    bare = spark.createDataFrame([(99, Vectors.sparse(12, [], []))], ["_no", "features"])
    got = sn.sparse_nearest(known, stage(sparse_rows(bare, "features", None, None, "_no")), 2)
    assert found(got) == brute(rows, [(99, Vectors.sparse(12, [], []), 0, 0)], 2)


def test_votes_equal_dense_classification(spark):
    from shelfsift.operators.neighbours import knn_classify

    rows, known = points(spark, 9, 50)
    dense = spark.createDataFrame([(i, x.toArray().tolist(), y) for i, x, y, _ in rows], "_no long, v array<double>, _label double")
    near = stage(sn.sparse_nearest(known, known, 5))
    for k, weights in ((1, "uniform"), (5, "uniform"), (4, "distance")):
        want = {tuple(r) for r in knn_classify(dense, dense, "_no", "v", "_label", k, weights).collect()}
        assert {(r["test_id"], r["prediction"]) for r in sn.votes(near, k, weights).collect()} == want


# -- the search ------------------------------------------------------------------------------


def texts(spark, n=40):
    rows = [(i, f"{'red bolt' if i % 2 else 'blue cap'} {'steel' if i % 3 else 'soft'} no{i % 7}", float(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, t string, label double")


def few(n):
    """All seven learners of the category trainer, with few rounds of boosting."""
    known = ln.default_learners(n)
    known["AdaBoost"] = (known["AdaBoost"][0], ln.grid(known["AdaBoost"][0], rounds=[2, 3], learningRate=[0.5, 1.0]))
    return known


@pytest.mark.parametrize("name", ["Logistic Regression", "Decision Tree", "Random Forest", "MultinomialNB", "AdaBoost", "K Nearest", "SVM"])
def test_the_winner_of_any_learner_is_saved_and_says_the_same(spark, tmp_path, name):
    rows = texts(spark)
    best = ln.search_ranges(rows, "t", "id", ranges=((1, 1),), learners=lambda n: {name: few(n)[name]}, folds=2, draws=2, nested=False)
    assert best.name == name and 0 <= best.score <= 1
    save_model(best.model, {"score": best.score, **best.params}, str(tmp_path / "m"))
    loaded, meta = load_model(spark, str(tmp_path / "m"))
    assert meta["score"] == best.score
    want, got = (sorted((r["id"], r["prediction"], round(r["probability"], 9)) for r in ln.score(m, rows, "id").collect()) for m in (best.model, loaded))
    assert got == want and all((p > 0.5) == (y == 1) or p == 0.5 for _, y, p in got)


def test_search_of_shared_work_equals_fits_of_their_own(spark):
    rows = texts(spark)
    vectors = stage(count_features("t", binary=True).fit(rows).transform(rows).select("id", "features", "label"))
    own = {n: l for n, l in few(40).items() if n in ("AdaBoost", "K Nearest")}
    plain = {}
    for name, (estimator, maps) in own.items():
        alone = type("Alone", (type(estimator),), {"rivals": property(lambda self: getattr(self, "none"))})()  # no shared work
        assert not hasattr(alone, "rivals")
        plain[name] = (alone, [{alone.getParam(p.name): v for p, v in m.items()} for m in maps])
    for shared, single in zip(ln.search(vectors, own, "id", folds=2, draws=3), ln.search(vectors, plain, "id", folds=2, draws=3)):
        assert shared.params == single.params and shared.score == pytest.approx(single.score)


def test_search_range_of_all_learners_is_the_trainers(spark):
    known = ln.default_learners(100)
    assert len(known) == 7
    sizes = {name: len(maps) for name, (_, maps) in known.items()}
    assert sizes["AdaBoost"] == 80 * 19 and sizes["K Nearest"] == 16 and sizes["Random Forest"] == 2 * 3 * 7 * 2 * 7 and sizes["Logistic Regression"] == 22


def test_cross_validation_of_a_grid(spark):
    rows = texts(spark)
    vectors = stage(count_features("t").fit(rows).transform(rows).select("id", "features", "label"))
    nb = ln.MultinomialNB()
    model, params, score = ln.cross_validate(vectors, nb, ln.grid(nb, alpha=[0.1, 1.0]), "id", folds=3)
    assert score == 1.0 and params == {"alpha": 0.1} and model.transform(vectors).where("prediction <> label").count() == 0
