"""Supervised models on feature vectors: fitting, search, per-category and multiclass training, scoring.

Every ``fit_*`` takes a table with a vector and a label column and returns a model whose ``transform`` adds
``prediction`` and, where the learner has one, ``probability``.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.operators import boosting, multinomial, trees as forests, wide
from shelfsift.operators.boosting import BoostedStumps
from shelfsift.operators.category_models import CategoryModels, fit_categories
from shelfsift.operators.features import CountTokens, count_features, feature_tokens
from shelfsift.operators.prep import FALSE_POSITIVE, TRUE_POSITIVE, assign_fold, misclassified
from shelfsift.operators.saved import OwnModel
from shelfsift.operators.sparse import filled, hashed, sparse_rows
from shelfsift.operators.sparse_neighbours import Neighbours, sparse_nearest, votes
from shelfsift.session import stage

# The parameter ranges that are searched.
LR_C = (0.001, 0.01, 0.1, 1, 10, 15, 20, 30, 40, 100, 1000)
TREE_DEPTHS = (4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 20, 30)
NB_ALPHAS = (1, 0.1, 0.01, 0.001, 0.0001, 0.00001)
FOREST_LEAVES = (1, 2, 3, 4, 5, 7, 9)
FOREST_FEATURES = ("1", "2", "3", "4", "5", "7", "9")
BOOST_ROUNDS = range(20, 100)
NEIGHBOURS = range(2, 10)
FOURIER_BYTES = 32 << 20  # of rows of the projection that a task keeps
DEEPEST = 30  # Spark trees go no deeper
FOREST_DEPTHS = (3, 5, DEEPEST)
WIDE = 1 << 16  # features from which linear weights and those of a network are a table


def _fitted(train: DataFrame, *stages: Estimator) -> PipelineModel:
    return Pipeline(stages=list(stages)).fit(train)


def reg_param(c: float, rows: int) -> float:
    """Inverse regularisation strength C over n summed losses, as the strength over the mean loss."""
    return 1.0 / (c * max(rows, 1))


class _Wide:
    """A linear learner of Spark that fits as Spark does, and over tables (:mod:`wide`) where features are many."""

    def prepared(self, df: DataFrame) -> tuple[wide.Columns, int] | None:
        """The columns that any number of fits may share, None if Spark is to fit."""
        get, places = self.getOrDefault, vector_size(df, self.getFeaturesCol())
        if places < WIDE or not (get("fitIntercept") and get("standardization")) or not self._sparse():
            return None
        cols = wide.columns(df, self.getFeaturesCol(), self.getLabelCol(), get("weightCol") if self.isSet("weightCol") else None)
        return (cols, places) if set(cols.label[cols.weight > 0].tolist()) == {0.0, 1.0} else None

    def _sparse(self) -> bool:
        return True

    def _fit(self, df: DataFrame) -> Model:
        made = self.prepared(df)
        return super()._fit(df) if made is None else self.fit_prepared(*made)


class Logistic(_Wide, LogisticRegression):
    """Two classes and the squared penalty, if features are many."""

    def _sparse(self) -> bool:
        return self.getOrDefault("elasticNetParam") == 0 or self.getOrDefault("regParam") == 0

    def fit_prepared(self, cols: wide.Columns, places: int) -> wide.WideModel:
        get = self.getOrDefault
        ones, rest = cols.weight[cols.label == 1].sum(), cols.weight[cols.label == 0].sum()
        table, bias = wide.fit_linear(cols, wide.logistic, get("regParam"), get("maxIter"), get("tol"), math.log(ones / rest))
        return wide.WideModel(table, "logistic", [bias], places, 1, get("featuresCol"), get("rawPredictionCol"), get("probabilityCol"), get("predictionCol"))


class Svm(_Wide, LinearSVC):
    def fit_prepared(self, cols: wide.Columns, places: int) -> wide.WideModel:
        get = self.getOrDefault
        table, bias = wide.fit_linear(cols, wide.hinge, get("regParam"), get("maxIter"), get("tol"))
        return wide.WideModel(table, "hinge", [bias], places, 1, get("featuresCol"), get("rawPredictionCol"), "", get("predictionCol"))


def lr_estimator(rows: int, c: float = 1.0, penalty: str = "l2", weight: str | None = None, iters: int = 50, **cols: str) -> LogisticRegression:
    lr = Logistic(
        regParam=reg_param(c, rows), elasticNetParam={"l1": 1.0, "l2": 0.0}[penalty], maxIter=iters, **cols)
    return lr.setWeightCol(weight) if weight else lr


def fit_lr(train: DataFrame, c: float = 1.0, penalty: str = "l2", weight: str | None = None, iters: int = 50, **cols: str) -> PipelineModel:
    return _fitted(train, lr_estimator(train.count(), c, penalty, weight, iters, **cols))


def _depth(wanted: int | None) -> int:
    """``wanted``, or the greatest depth there is if None; more than that is refused."""
    if wanted is not None and wanted > DEEPEST:
        raise ValueError(f"trees end at depth {DEEPEST}")
    return DEEPEST if wanted is None else wanted


def fit_tree(train: DataFrame, criterion: str = "gini", max_depth: int = 5, **cols: str) -> PipelineModel:
    return _fitted(train, Trees(impurity=criterion, maxDepth=_depth(max_depth), **cols))


def fit_forest(
    train: DataFrame, trees: int = 10, max_depth: int | None = 5, max_features: int | str = "auto", min_leaf: int = 1,
    bootstrap: bool = True, criterion: str = "gini", **cols: str,
) -> PipelineModel:
    return _fitted(train, Trees(
        trees, maxDepth=_depth(max_depth), featureSubsetStrategy=str(max_features),
        minInstancesPerNode=min_leaf, bootstrap=bootstrap, impurity=criterion, **cols))


def _fourier_rows(features: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Normal numbers for each feature: its row of the projection, the same in every task and batch."""
    at = features[:, None] * size + np.arange(size)[None, :]
    return np.sqrt(-2 * np.log(hashed(2 * at, seed))) * np.cos(2 * math.pi * hashed(2 * at + 1, seed))


class _FourierRows:
    """Rows of the projection; those of the features that a task's first texts hold most often are made once."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed
        self.known, self.made = np.zeros(0, np.int64), np.zeros((0, size))

    def learn(self, texts: Sequence[Sequence[int]]) -> None:
        if not len(self.known):
            features, held = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(t, "int64") for t in texts)]), return_counts=True)
            most = np.argsort(-held, kind="stable")[: FOURIER_BYTES // (8 * self.size)]
            self.known = np.sort(features[most[held[most] > 1]])
            blocks = [_fourier_rows(self.known[i : i + 4096], self.size, self.seed) for i in range(0, len(self.known), 4096)]
            self.made = np.concatenate([self.made, *blocks])

    def rows(self, features: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return _fourier_rows(features, self.size, self.seed)
        at = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
        out, new = self.made[at], self.known[at] != features
        if new.any():
            out[new] = _fourier_rows(features[new], self.size, self.seed)
        return out


def random_fourier(df: DataFrame, features: str, output: str, gamma: float, size: int = 256, seed: int = 1) -> DataFrame:
    """Features whose dot products approach exp(-gamma * squared distance).

    The projection is never held as a whole: a task makes the rows of the features its texts have, and
    keeps a bounded number of them, so any number of features will do.
    """
    shift = 2 * math.pi * hashed(np.arange(size), seed + 1)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = _FourierRows(size, seed)
        for indices, values in batches:
            made.learn(indices)
            out = []
            for at, x in zip(indices, values):
                total = np.zeros(size)
                for i in range(0, len(at), 4096):
                    total += np.asarray(x[i : i + 4096], "float64") @ made.rows(np.asarray(at[i : i + 4096], "int64"))
                out.append(math.sqrt(2 / size) * np.cos(math.sqrt(2 * gamma) * total + shift))
            yield pd.Series(out)

    parts = F.unwrap_udt(features)
    dense = parts["indices"].isNull()
    numbers = F.transform(parts["values"], lambda _, i: i)
    return df.withColumn(output, array_to_vector(project(F.when(dense, numbers).otherwise(parts["indices"]), parts["values"])))


def fit_svm(train: DataFrame, c: float = 1.0, iters: int = 30, featuresCol: str = "features", labelCol: str = "label") -> PipelineModel:
    """Linear support vector machine with probabilities from a logistic fit on its margin."""
    svc = Svm(
        regParam=reg_param(c, train.count()), maxIter=iters, featuresCol=featuresCol, labelCol=labelCol,
        rawPredictionCol="_margins", predictionCol="_side")
    margin = VectorSlicer(inputCol="_margins", outputCol="_margin", indices=[1])
    return _fitted(train, svc, margin, LogisticRegression(featuresCol="_margin", labelCol=labelCol))


def fit_svm_multiclass(train: DataFrame, c: float = 1.0, iters: int = 20, **cols: str) -> PipelineModel:
    svc = LinearSVC(regParam=reg_param(c, train.count()), maxIter=iters)
    return _fitted(train, OneVsRest(classifier=svc, parallelism=4, **cols))


def fit_nb(train: DataFrame, alpha: float = 1.0, fit_prior: bool = True, **cols: str) -> PipelineModel | FlatPrior:
    """Multinomial Naive Bayes; without ``fit_prior`` every class is equally likely beforehand."""
    if fit_prior:
        return _fitted(train, NaiveBayes(modelType="multinomial", smoothing=alpha, **cols))
    fitted = NaiveBayes(
        modelType="multinomial", smoothing=alpha, rawPredictionCol="_log_scores", probabilityCol="", predictionCol="", **cols).fit(train)
    return FlatPrior(fitted)


class FlatPrior(OwnModel):
    """A fitted Naive Bayes with the class prior taken out of its probabilities."""

    def __init__(self, fitted: Model):
        super().__init__()
        self.fitted = fitted

    def parts(self) -> dict[str, Model]:
        return {"fitted": self.fitted}

    def _transform(self, df: DataFrame) -> DataFrame:
        # From the log scores: the probabilities of long texts are 0 or 1 already.
        prior = F.array(*[F.lit(float(p)) for p in self.fitted.pi.toArray()])
        logs = F.zip_with(vector_to_array("_log_scores"), prior, lambda score, p: score - p)
        odds = F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs")))
        scaled = F.transform("_odds", lambda x: x / F.aggregate("_odds", F.lit(0.0), lambda a, y: a + y))
        return self.fitted.transform(df).withColumn("_logs", logs).withColumn("_odds", odds).select(
            *df.columns, array_to_vector(scaled).alias("probability"),
            (F.array_position("_logs", F.array_max("_logs")) - 1).cast("double").alias("prediction"))


def fit_ada(
    train: DataFrame, rounds: int = 20, learning_rate: float = 1.0, featuresCol: str = "features", labelCol: str = "label"
) -> BoostedStumps:
    """Boosted stumps for two classes, each fitted on rows reweighted by the errors so far.

    Every value of a feature is a possible threshold, so this is for counts and other features of few values.
    """
    setting = boosting.Setting(learning_rate)
    boosting.boost(stage(sparse_rows(train, featuresCol, F.col(labelCol))), [setting], rounds, vector_size(train, featuresCol))
    if not setting.stumps:
        raise ValueError("no stump is better than chance")
    return BoostedStumps(setting.stumps, featuresCol)


def vector_size(df: DataFrame, features: str) -> int:
    first = df.select(features).first()
    return 0 if first is None else first[0].size


def fit_mlp(train: DataFrame, classes: int, hidden: Sequence[int] = (16,), iters: int = 30, **cols: str) -> PipelineModel:
    """A network of sigmoid units under a softmax; first weights are drawn, by hash where features are many."""
    features, label = cols.get("featuresCol", "features"), cols.get("labelCol", "label")
    size = train.select(features).first()[0].size
    if size >= WIDE and len(hidden) == 1:
        made = wide.columns(train, features, label, scaled=False)
        table, rest = wide.fit_network(made, size, hidden[0], classes, iters, 1e-6)
        return PipelineModel([wide.WideModel(table, "network", rest, size, hidden[0], features)])
    return _fitted(train, MultilayerPerceptronClassifier(layers=[size, *hidden, classes], maxIter=iters, seed=1, **cols))


# -- learners of this library as estimators, so that one search can try all ------------------


class _Learner(Estimator, HasFeaturesCol, HasLabelCol):
    """An estimator whose ``rivals`` judge many parameters on many splits of the rows together."""

    def _fit(self, df: DataFrame) -> Model:
        return self.fitted(df, {"featuresCol": self.getFeaturesCol(), "labelCol": self.getLabelCol()})


class AdaBoost(_Learner):
    rounds = Param(Params._dummy(), "rounds", "most stumps", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "weight of each stump's share", TypeConverters.toFloat)

    def __init__(self, rounds: int = 20, learningRate: float = 1.0):
        super().__init__()
        self._setDefault(rounds=rounds, learningRate=learningRate)

    def fitted(self, df: DataFrame, cols: dict[str, str]) -> BoostedStumps:
        return fit_ada(df, self.getOrDefault(self.rounds), self.getOrDefault(self.learningRate), **cols)

    def rivals(self, rows: DataFrame, maps: list[dict], splits: Sequence[Split], label: str) -> Rivals:
        """All learning rates on all splits are settings of one pass, every number of rounds a prefix of one run."""
        features = self.getFeaturesCol()
        tried = [(self.copy(m).getOrDefault("rounds"), self.copy(m).getOrDefault("learningRate")) for m in maps]
        asked = [(rate, split) for rate in sorted({r for _, r in tried}) for split in splits]
        settings = [boosting.Setting(rate, split.train) for rate, split in asked]
        kept = stage(sparse_rows(rows, features, F.col(label), F.col("_cell")))
        boosting.boost(kept, settings, max(n for n, _ in tried), vector_size(rows, features))
        found = dict(zip(asked, boosting.recalls(kept, settings, [split.test for _, split in asked])))
        stumps = {key: setting.stumps for key, setting in zip(asked, settings)}

        def recall(i: int, split: Split) -> float:
            n, rate = tried[i]
            hits, there = found[rate, split]
            return float(hits[min(n, len(hits)) - 1]) / there if there and len(hits) else 0.0

        def model(i: int) -> Model:
            mine = stumps[tried[i][1], splits[0]][: tried[i][0]]
            if not mine:
                raise ValueError("no stump is better than chance")
            return BoostedStumps(mine, features)

        return Rivals(recall, model)


class Trees(_Learner):
    """A decision tree, or with ``numTrees`` above 1 a forest of trees that draw rows (``bootstrap``) and each node's features."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    impurity = Param(Params._dummy(), "impurity", "gini or entropy", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows on each side of a split", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "auto, all, sqrt, log2, onethird, a number or a share", TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether a tree of a forest draws rows", TypeConverters.toBoolean)

    def __init__(
        self, numTrees: int = 1, impurity: str = "gini", maxDepth: int = 5, minInstancesPerNode: int = 1, featureSubsetStrategy: str = "auto",
        bootstrap: bool = True, featuresCol: str = "features", labelCol: str = "label",
    ):
        super().__init__()
        self._setDefault(numTrees=numTrees, impurity=impurity, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode,
                         featureSubsetStrategy=featureSubsetStrategy, bootstrap=bootstrap, featuresCol=featuresCol, labelCol=labelCol)

    def _drawn(self, size: int) -> int | None:
        """How many of ``size`` features a node draws, None: all."""
        asked, many = self.getOrDefault("featureSubsetStrategy"), self.getOrDefault("numTrees") > 1
        if asked.isdigit() and int(asked):
            n = int(asked)
        else:
            share = {"auto": size**0.5 if many else size, "all": size, "sqrt": size**0.5, "log2": math.log2(max(size, 2)), "onethird": size / 3}
            n = share[asked] if asked in share else float(asked) * size
        return None if n >= size else max(1, math.ceil(n))

    def planted(self, size: int, cells: frozenset[int] | None = None, depth: int | None = None) -> list[forests.Tree]:
        get = self.getOrDefault
        many = get("numTrees") > 1
        return [forests.Tree(
            get("impurity"), get("maxDepth") if depth is None else depth, get("minInstancesPerNode"), self._drawn(size),
            many and get("bootstrap"), 1 + t, cells) for t in range(get("numTrees"))]

    def fitted(self, df: DataFrame, cols: dict[str, str]) -> forests.TreeVotes:
        rows, size = forests.tree_rows(df, cols["featuresCol"], F.col(cols["labelCol"])), vector_size(df, cols["featuresCol"])
        grown = self.planted(size)
        forests.grow(rows, grown, size, forests.classes_of(rows))
        return forests.TreeVotes([t.pruned(t.depth) for t in grown], cols["featuresCol"])

    def rivals(self, rows: DataFrame, maps: list[dict], splits: Sequence[Split], label: str) -> Rivals:
        """All parameters on all splits grow in one pass; a tree down to some depth is the top of a deeper one."""
        features = self.getFeaturesCol()
        size, kept = vector_size(rows, features), forests.tree_rows(rows, features, F.col(label), F.col("_cell"))
        tried = [self.copy(m) for m in maps]
        names = ("numTrees", "impurity", "minInstancesPerNode", "featureSubsetStrategy", "bootstrap")
        kind = [tuple(e.getOrDefault(n) for n in names) for e in tried]
        deepest = {k: max(e.getOrDefault("maxDepth") for e, own in zip(tried, kind) if own == k) for k in kind}
        grown = {(k, s): e.planted(size, s.train, deepest[k]) for e, k in zip(tried, kind) for s in splits}
        forests.grow(kept, [t for own in grown.values() for t in own], size, forests.classes_of(kept))

        def shaped(i: int, split: Split) -> list[dict]:
            return [t.pruned(tried[i].getOrDefault("maxDepth")) for t in grown[kind[i], split]]

        judged = [(i, s) for i in range(len(maps)) for s in splits if s.test]
        found = dict(zip(judged, forests.recalls(kept, [(shaped(i, s), s.test) for i, s in judged])))

        def recall(i: int, split: Split) -> float:
            hits, there = found[i, split]
            return hits / there if there else 0.0

        return Rivals(recall, lambda i: forests.TreeVotes(shaped(i, splits[0]), features))


class MultinomialNB(_Learner):
    alpha = Param(Params._dummy(), "alpha", "smoothing", TypeConverters.toFloat)
    fitPrior = Param(Params._dummy(), "fitPrior", "whether classes weigh by their rows", TypeConverters.toBoolean)

    def __init__(self, alpha: float = 1.0, fitPrior: bool = True):
        super().__init__()
        self._setDefault(alpha=alpha, fitPrior=fitPrior)

    def _fit_of(self, cells: frozenset[int] | None = None) -> multinomial.Fit:
        alpha = self.getOrDefault(self.alpha)
        if alpha <= 0:
            raise ValueError("a smoothing above 0 is wanted")
        return multinomial.Fit(alpha, self.getOrDefault(self.fitPrior), cells)

    def fitted(self, df: DataFrame, cols: dict[str, str]) -> multinomial.MultinomialTable:
        rows = stage(sparse_rows(df, cols["featuresCol"], F.col(cols["labelCol"])))
        return multinomial.model(multinomial.summed(rows, vector_size(df, cols["featuresCol"])), self._fit_of(), cols["featuresCol"])

    def rivals(self, rows: DataFrame, maps: list[dict], splits: Sequence[Split], label: str) -> Rivals:
        """The values are summed once by place, cell and class; all parameters on all splits are judged in one join."""
        features = self.getFeaturesCol()
        kept = stage(sparse_rows(rows.withColumn("_no", F.monotonically_increasing_id()), features, F.col(label), F.col("_cell"), "_no"))
        sums = multinomial.summed(kept, vector_size(rows, features))
        judged = [(i, s) for i in range(len(maps)) for s in splits if s.test]
        found = dict(zip(judged, multinomial.recalls(kept, sums, [(self.copy(maps[i])._fit_of(s.train), s.test) for i, s in judged])))

        def recall(i: int, split: Split) -> float:
            hits, there = found[i, split]
            return hits / there if there else 0.0

        return Rivals(recall, lambda i: multinomial.model(sums, self.copy(maps[i])._fit_of(splits[0].train), features))


class KNearest(_Learner):
    k = Param(Params._dummy(), "k", "neighbours asked", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)

    def __init__(self, k: int = 5, weights: str = "uniform"):
        super().__init__()
        self._setDefault(k=k, weights=weights)

    def fitted(self, df: DataFrame, cols: dict[str, str]) -> Neighbours:
        known = stage(sparse_rows(df.withColumn("_no", F.monotonically_increasing_id()), cols["featuresCol"], F.col(cols["labelCol"]), None, "_no"))
        return Neighbours(known, cols["featuresCol"], self.getOrDefault(self.k), self.getOrDefault(self.weights))

    def rivals(self, rows: DataFrame, maps: list[dict], splits: Sequence[Split], label: str) -> Rivals:
        """One search with the largest k answers every k, both ways of voting and all splits."""
        tried = [(self.copy(m).getOrDefault("k"), self.copy(m).getOrDefault("weights")) for m in maps]
        known = stage(sparse_rows(rows.withColumn("_no", F.monotonically_increasing_id()), self.getFeaturesCol(), F.col(label), F.col("_cell"), "_no"))
        judged = [(c, split) for c, split in enumerate(splits) if split.test]
        asks = F.array_compact(F.array(*[F.when(F.col("_cell").isin(sorted(split.test)), F.lit(c)) for c, split in judged]))
        asked = known.where(F.col("_label") == 1).withColumn("_contexts", asks).where(F.size("_contexts") > 0)
        near = stage(sparse_nearest(known, asked, max(k for k, _ in tried), {c: split.train for c, split in judged}))
        hits = None
        for k, weights in sorted(set(tried)):
            mine = votes(near, k, weights).groupBy("context").agg(F.count(F.when(F.col("prediction") == 1, 1)).alias("n"), F.lit(f"{k}/{weights}").alias("voting"))
            hits = mine if hits is None else hits.unionByName(mine)
        found = {(r["voting"], r["context"]): r["n"] for r in hits.collect()}
        there = {r[0]: r[1] for r in asked.select(F.explode("_contexts").alias("c")).groupBy("c").count().collect()}
        number = {split: c for c, split in judged}

        def recall(i: int, split: Split) -> float:
            c, (k, weights) = number[split], tried[i]
            return found.get((f"{k}/{weights}", c), 0) / there[c] if there.get(c) else 0.0

        return Rivals(recall, lambda i: self.copy(maps[i]).fit(rows))


# -- features --------------------------------------------------------------------------------


def merged_features(text: str, output: str = "features", max_features: int | None = None) -> Pipeline:
    """Separate vocabularies of single words and of word pairs, side by side."""
    words, single = feature_tokens(text, "words", (1, 1))
    pairs, double = feature_tokens(text, "pairs", (2, 2))
    return Pipeline(stages=[CountTokens([*words, *pairs], [single, double], output, limit=max_features)])


def count_and_tfidf(text: str, output: str = "features", max_features: int | None = None) -> Pipeline:
    """Counts and their inverse-frequency weighted form, side by side."""
    steps, tokens = feature_tokens(text, "counts")
    return Pipeline(stages=[CountTokens(steps, [tokens], output, limit=max_features, weighted=True)])


# -- selection -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trial:
    name: str
    params: dict[str, object]
    score: float
    model: Model


def recall_of_positives(label: str = "label") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="recallByLabel", metricLabel=1.0)


def grid(estimator: Estimator, **values: Sequence[object]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, choices in values.items():
        builder = builder.addGrid(estimator.getParam(name), list(choices))
    return builder.build()


def probable_svm(iters: int = 20) -> tuple[Pipeline, LinearSVC]:
    """A linear support vector machine whose prediction and probability are a logistic fit on its margin, and its first stage."""
    svc = Svm(maxIter=iters, rawPredictionCol="_margins", predictionCol="_side")
    margin = VectorSlicer(inputCol="_margins", outputCol="_margin", indices=[1])
    return Pipeline(stages=[svc, margin, LogisticRegression(featuresCol="_margin")]), svc


def default_learners(rows: int) -> dict[str, tuple[Estimator, list[dict]]]:
    """The learners and ranges that the category trainer tries."""
    lr, tree, forest = Logistic(maxIter=30), Trees(), Trees(10)
    nb, ada, near = MultinomialNB(), AdaBoost(), KNearest()
    svm, svc = probable_svm()
    strengths = [reg_param(c, rows) for c in LR_C]
    # An exponential distribution by its quantiles.
    rates = [-math.log(1 - q / 20) for q in range(1, 20)]
    return {
        "Logistic Regression": (lr, grid(lr, regParam=strengths, elasticNetParam=[1.0, 0.0])),
        "Decision Tree": (tree, grid(tree, impurity=["gini", "entropy"], maxDepth=TREE_DEPTHS)),
        "Random Forest": (forest, grid(
            forest, impurity=["gini", "entropy"], maxDepth=FOREST_DEPTHS, minInstancesPerNode=FOREST_LEAVES, bootstrap=[True, False],
            featureSubsetStrategy=FOREST_FEATURES)),
        "MultinomialNB": (nb, grid(nb, alpha=[float(a) for a in NB_ALPHAS], fitPrior=[True, False])),
        "AdaBoost": (ada, grid(ada, rounds=BOOST_ROUNDS, learningRate=rates)),
        "K Nearest": (near, grid(near, k=NEIGHBOURS, weights=["uniform", "distance"])),
        "SVM": (svm, grid(svc, regParam=[reg_param(10.0**e, rows) for e in range(-4, 4)])),
    }


@dataclass(frozen=True)
class Split:
    """Cells (numbers of rows that always go together) to learn from and to be judged on; without ``test`` only a model is wanted."""

    train: frozenset[int]
    test: frozenset[int] = frozenset()


@dataclass(frozen=True)
class Rivals:
    """``recall`` of the i-th parameters on a split, and their ``model`` over all rows."""

    recall: Callable[[int, Split], float]
    model: Callable[[int], Model]


def _recall(model: Model, rows: DataFrame, label: str) -> float:
    """The share of the rows with label 1 that are found; 0 if there are none."""
    hit = F.count(F.when(F.col("prediction") == 1, 1))
    found, there = model.transform(rows.where(F.col(label) == 1)).agg(hit, F.count(F.lit(1))).first()
    return found / there if there else 0.0


def _one_by_one(estimator: Estimator, rows: DataFrame, maps: list[dict], label: str) -> Rivals:
    """Rivals of a learner that Spark fits: one fit for each parameters and split."""
    def recall(i: int, split: Split) -> float:
        model = estimator.fit(rows.where(F.col("_cell").isin(sorted(split.train))), maps[i])
        return _recall(model, rows.where(F.col("_cell").isin(sorted(split.test))), label)

    return Rivals(recall, lambda i: estimator.fit(rows, maps[i]))


def search(
    train: DataFrame, learners: Mapping[str, tuple[Estimator, list[dict]]], key: str, folds: int = 5, draws: int = 10,
    seed: int = 1, nested: bool = True, label: str = "label", parallelism: int = 4,
) -> list[Trial]:
    """Randomised search per learner; the score is the recall on folds that the search has not seen.

    The best parameters have the highest mean recall over the inner folds. ``nested`` repeats the
    search without each of the outer folds and scores its winner there. Rows are in one cell for each
    pair of an inner and an outer fold, so all these splits are sets of cells of the same staged rows.
    """
    rng = random.Random(seed)
    keyed = assign_fold(assign_fold(train, key, folds, "_inner").withColumn("_outer_key", F.concat_ws("/", F.lit("outer"), F.col(key))), "_outer_key", folds, "_outer")
    rows = stage(keyed.withColumn("_cell", F.col("_outer") * folds + F.col("_inner")).drop("_inner", "_outer", "_outer_key"))
    whole = frozenset(range(folds * folds))
    outside = {f: frozenset(range(f * folds, (f + 1) * folds)) for f in range(folds)}
    inside = {f: frozenset(range(f, folds * folds, folds)) for f in range(folds)}

    def inner(seen: frozenset[int]) -> list[Split]:
        return [Split(seen - inside[f], seen & inside[f]) for f in range(folds)]

    tuned = [whole, *(whole - outside[f] for f in range(folds) if nested)]
    last = {whole - outside[f]: Split(whole - outside[f], outside[f]) for f in range(folds) if nested}
    trials = []
    with ThreadPoolExecutor(parallelism) as pool:
        for name, (estimator, maps) in learners.items():
            drawn = rng.sample(maps, min(draws, len(maps)))
            splits = [Split(whole), *(s for seen in tuned for s in inner(seen)), *last.values()]
            rivals = estimator.rivals(rows, drawn, splits, label) if hasattr(estimator, "rivals") else _one_by_one(estimator, rows, drawn, label)
            asked = [(i, s) for seen in tuned for i in range(len(drawn)) for s in inner(seen)]
            found = dict(zip(asked, pool.map(lambda a: rivals.recall(*a), asked)))

            def winner(seen: frozenset[int]) -> tuple[float, int]:
                means = [sum(found[i, s] for s in inner(seen)) / folds for i in range(len(drawn))]
                return max(means), means.index(max(means))

            score, best = winner(whole)
            if nested:
                score = sum(pool.map(lambda seen: rivals.recall(winner(seen)[1], last[seen]), tuned[1:])) / folds
            params = {p.name: v for p, v in drawn[best].items()}
            trials.append(Trial(name, params, score, rivals.model(best)))
    return trials


def cross_validate(
    train: DataFrame, estimator: Estimator, maps: list[dict], key: str, folds: int = 5, label: str = "label", parallelism: int = 4
) -> tuple[Model, dict, float]:
    """Best model over a whole grid by mean recall across repeatable folds."""
    best, = search(train, {"": (estimator, maps)}, key, folds, len(maps), nested=False, label=label, parallelism=parallelism)
    return best.model, best.params, best.score


def best_trial(trials: Sequence[Trial], prefer: str = "first") -> Trial:
    """Highest score; among equals the first, or the newest across n-gram ranges."""
    order = list(trials) if prefer == "first" else list(reversed(trials))
    return max(order, key=lambda t: t.score)


def search_ranges(
    train: DataFrame, text: str, key: str, ranges: Sequence[tuple[int, int]] = ((1, 1), (1, 2), (2, 2)),
    max_features: Sequence[int | None] = (None,), learners: Callable[[int], Mapping] = default_learners, **how: object,
) -> Trial:
    """Best over n-gram ranges and vocabulary sizes of the best learner of each.

    The features of one range are fitted once and kept while its learners are compared.
    """
    rows, winners = train.count(), []
    for span, size in itertools.product(ranges, max_features):
        features = count_features(text, ngram_range=span, binary=True, max_features=size, stop_words=True).fit(train)
        vectors = stage(features.transform(train).select(key, "features", "label"))
        best = best_trial(search(vectors, learners(rows), key, **how))
        winners.append(Trial(best.name, {**best.params, "ngram_range": span, "max_features": size}, best.score,
                             PipelineModel([features, best.model])))
    return best_trial(winners, prefer="newest")


# -- training jobs ---------------------------------------------------------------------------


def category_vectors(items: DataFrame, category: str, text: str, features: Pipeline, kind: str = "type") -> tuple[PipelineModel, DataFrame]:
    """Features fitted once over all texts, and one staged row per text: (features, _in), all its categories with their types."""
    rows = items.where(F.col(kind).isin(TRUE_POSITIVE, FALSE_POSITIVE)).groupBy(text).agg(
        F.collect_set(F.struct(F.col(category).alias("category"), (F.col(kind) == TRUE_POSITIVE).alias("true"))).alias("_in"))
    rows = stage(rows)
    fitted = features.fit(rows)
    return fitted, stage(fitted.transform(rows).select("features", "_in"))


def labelled_for(vectors: DataFrame, cat: object) -> DataFrame:
    """(features, label) for one category, as :func:`prep.positives_negatives` labels its texts."""
    positive = F.exists("_in", lambda x: (x["category"] == cat) & x["true"])
    negative = F.exists("_in", lambda x: (x["category"] != cat) == x["true"])
    labels = F.array_compact(F.array(F.when(positive, 1.0), F.when(negative, 0.0)))
    return vectors.select("features", F.explode(labels).alias("label"))


def train_per_category(
    items: DataFrame, category: str, text: str, trainer: Callable[[DataFrame], Model], features: Pipeline, kind: str = "type",
    categories: Sequence[object] | None = None,
) -> tuple[PipelineModel, dict[object, tuple[Model, float]]]:
    """The fitted features, and one two-class model per category with its training recall.

    All categories read the same staged vectors; the loop is over categories, never rows.
    """
    if categories is None:
        categories = [r[0] for r in items.select(category).distinct().orderBy(category).collect()]
    fitted, vectors = category_vectors(items, category, text, features, kind)
    models = {}
    for cat in categories:
        labelled = labelled_for(vectors, cat)
        model = trainer(labelled)
        models[cat] = (model, recall_of_positives().evaluate(model.transform(labelled)))
    return fitted, models


def train_categories_together(
    items: DataFrame, category: str, text: str, features: Pipeline, kind: str = "type", categories: Sequence[object] | None = None, c: float = 1.0,
) -> tuple[PipelineModel, CategoryModels, dict[object, float]]:
    """The fitted features, the logistic models of all categories, and their training recalls; as many jobs for all as for one."""
    if categories is None:
        categories = [r[0] for r in items.select(category).distinct().orderBy(category).collect()]
    fitted, vectors = category_vectors(items, category, text, features, kind)
    models, recalls = fit_categories(vectors, categories, vector_size(vectors, "features"), c)
    return fitted, models, recalls


def train_multiclass(train: DataFrame, category: str, features: Pipeline, estimator: Estimator) -> PipelineModel:
    """One model over all categories, labels in alphabetical order."""
    index = StringIndexer(inputCol=category, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[index, features, estimator]).fit(train)


def predicted_names(model: PipelineModel, scored: DataFrame, name: str = "predicted_category") -> DataFrame:
    """Predicted codes back to category names, by a join with the table of labels."""
    labels = scored.sparkSession.createDataFrame(list(enumerate(model.stages[0].labels)), f"_code int, {name} string")
    return scored.withColumn("_code", F.col("prediction").cast("int")).join(F.broadcast(labels), "_code", "left").drop("_code")


def refit_on_errors(model: Model, estimator: Estimator, train: DataFrame, label: str = "label", repeat: float = 2.0) -> Model:
    """Fit again with the rows the model gets wrong weighing more."""
    scored = model.transform(train)
    weighted = scored.withColumn("_weight", F.when(F.col("prediction") != F.col(label), repeat).otherwise(1.0))
    return estimator.copy({estimator.weightCol: "_weight"}).fit(weighted.select(*train.columns, "_weight"))


def hard_rows(model: Model, train: DataFrame, label: str = "label") -> DataFrame:
    return misclassified(model.transform(train), label, "prediction")


def fit_epochs(
    estimator: Estimator, train: DataFrame, held: DataFrame, rounds: Sequence[int], label: str = "label"
) -> tuple[Model, list[tuple[int, float]]]:
    """Longer and longer training; the model of the best round by held-out accuracy is the one returned."""
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    best, history = None, []
    made = estimator.prepared(train) if hasattr(estimator, "prepared") else None
    for iters in rounds:
        longer = estimator.copy({estimator.maxIter: iters})
        model = longer.fit(train) if made is None else longer.fit_prepared(*made)
        accuracy = judge.evaluate(model.transform(held))
        if best is None or accuracy > max(a for _, a in history):
            best = model
        history.append((iters, accuracy))
    return best, history


# -- scoring ---------------------------------------------------------------------------------


def score(model: Model, df: DataFrame, *keep: str) -> DataFrame:
    """Kept columns with the prediction and the probability of class 1, vectorised once per row."""
    return model.transform(df).select(
        *keep, "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))


#: What an outside model is called with: the rows' places and values one row after another, where each row begins, and the vectors' length.
SparsePredict = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def score_batches(df: DataFrame, features: str, make_predict: Callable[[], SparsePredict], batch: int = 1024, name: str = "probability") -> DataFrame:
    """Score with a model from outside Spark: loaded once per task, called on batches of sparse rows.

    ``predict(places, values, first, size)`` returns a number per row; row i has the entries ``first[i]`` to
    ``first[i + 1]``. A worker holds the entries of ``batch`` rows at a time, never a filled vector.
    """
    @F.pandas_udf("double")
    def predicted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = make_predict()
        for places, values, sizes in batches:
            out = [np.empty(0)]
            for i in range(0, len(places), batch):
                at, x = places.iloc[i : i + batch], values.iloc[i : i + batch]
                first = np.concatenate([[0], np.cumsum(at.map(len))]).astype(np.int64)
                out.append(predict(np.concatenate([*at, []]).astype(np.int64), np.concatenate([*x, []]).astype(np.float64), first, int(sizes.iloc[i])))
            yield pd.Series(np.concatenate(out))

    at, x = filled(features)
    parts = F.unwrap_udt(features)
    return df.withColumn(name, predicted(at, x, F.coalesce(parts["size"], F.size(parts["values"]))))
