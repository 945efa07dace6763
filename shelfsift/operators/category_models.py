"""One logistic model per category, all fitted together and all applied together.

Fitting: every step is one job for all categories. Tasks work out the margins of their rows for all
categories at once and sum the gradients by (place, category); the sums meet by place. Each category
takes its own step (limited-memory quasi-Newton, step halved until the loss falls) and stops by itself.

Scoring: one packed row per place holds the coefficients of all categories; an item's entries meet them
in one join, and grouped sums give its margin for every category.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.operators.joins import broadcast_small, skew_join
from shelfsift.operators.saved import OwnModel
from shelfsift.operators.sparse import Batches, filled
from shelfsift.session import stage

CELLS = 1 << 21  # coefficients fitted together: places times categories
PIECE = 1 << 22  # products worked on at a time
MEMORY = 10
LOSS, INTERCEPT, FOUND, THERE, ROWS = -1, -2, -3, -4, -5  # places of what is no coefficient


def category_rows(vectors: DataFrame, features: str = "features", known: str = "_in") -> DataFrame:
    """(_at, _x, _true, _false): the entries of each row, the categories it is in and those it is wrongly in."""
    at, x = filled(features)

    def those(true: bool) -> Column:
        return F.transform(F.filter(known, lambda s: s["true"] == F.lit(true)), lambda s: s["category"].cast("string"))

    return vectors.select(at.alias("_at"), x.alias("_x"), those(True).alias("_true"), those(False).alias("_false"))


def _marks(lists: pa.Array, code: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(lists), len(code)), bool)
    for i, names in enumerate(lists.to_pylist()):
        for name in names:
            if name in code:
                out[i, code[name]] = True
    return out


def _judged(model: Callable[[], tuple[np.ndarray, np.ndarray]], names: Sequence[str]) -> Callable[[Batches], Batches]:
    """(place, one sum per category): losses, gradients, positives found and there, rows."""
    code = {name: j for j, name in enumerate(names)}

    def run(source: Batches) -> Batches:
        weights, intercepts = model()
        gradient, rest = np.zeros_like(weights), np.zeros((5, len(names)))
        for batch in source:
            sizes = batch["_at"].value_lengths().to_numpy()
            at, x = batch["_at"].flatten().to_numpy(), batch["_x"].flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)])
            # As for one category: in it, and in another or wrongly in it; a row can be both.
            true, false = _marks(batch["_true"], code), _marks(batch["_false"], code)
            all_true = batch["_true"].value_lengths().to_numpy()[:, None]
            positive, negative = true, (all_true - true > 0) | false
            ends = np.searchsorted(first, np.arange(0, first[-1] + 1, max(PIECE // len(names), 1)))
            cuts = np.unique(np.concatenate([[0], ends, [len(sizes)]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                i, j = first[a], first[b]
                row = np.repeat(np.arange(b - a), sizes[a:b])
                margins = np.tile(intercepts, (b - a, 1))
                filled_rows = np.flatnonzero(sizes[a:b])
                if j > i:
                    margins[filled_rows] += np.add.reduceat(x[i:j, None] * weights[at[i:j]], first[a:b][filled_rows] - i, axis=0)
                p, n = positive[a:b], negative[a:b]
                share = 1 / (1 + np.exp(-margins))
                pull = np.where(n, share, 0) - np.where(p, 1 - share, 0)
                rest += [(np.where(p, np.logaddexp(0, -margins), 0) + np.where(n, np.logaddexp(0, margins), 0)).sum(0), pull.sum(0),
                         (p & (margins > 0)).sum(0), p.sum(0), p.sum(0) + n.sum(0)]
                if j > i:
                    order = np.argsort(at[i:j], kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(at[i:j][order]) != 0]))
                    gradient[at[i:j][order][starts]] += np.add.reduceat((x[i:j, None] * pull[row])[order], starts, axis=0)
        used = np.flatnonzero(gradient.any(axis=1))
        sums = np.concatenate([gradient[used], rest])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([used, [LOSS, INTERCEPT, FOUND, THERE, ROWS]])),
             pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * len(names), pa.int32()), pa.array(sums.ravel()))], ["place", "sums"])
    return run


def _added(source: Batches) -> Batches:
    """Sums of the lists of each place of a partition."""
    batches = [b for b in source if len(b)]
    if batches:
        place = np.concatenate([b["place"].to_numpy() for b in batches])
        sums = np.concatenate([b["sums"].flatten().to_numpy() for b in batches]).reshape(len(place), -1)
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0]))
        whole = np.add.reduceat(sums[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place[order][starts]), pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * whole.shape[1], pa.int32()), pa.array(whole.ravel()))], ["place", "sums"])


def _evaluated(rows: DataFrame, names: Sequence[str], weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (places and, last, the intercept; by category) and the other sums: one job, one row per place to the driver."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, intercepts))
    kind = "place bigint, sums array<double>"
    sums = rows.mapInArrow(_judged(lambda: sent.value, names), kind).repartition("place").mapInArrow(_added, kind)
    gradient, rest = np.zeros((len(weights) + 1, len(names))), np.zeros((5, len(names)))
    for place, values in sums.collect():
        if place >= 0:
            gradient[place] = values
        else:
            rest[-1 - place] = values
    gradient[-1] = rest[1]
    sent.unpersist()
    return gradient, rest


def _direction(gradient: np.ndarray, steps: Sequence[np.ndarray], changes: Sequence[np.ndarray]) -> np.ndarray:
    """Quasi-Newton directions, one per column, from the last steps and changes of gradient; columns whose curvature is not positive are passed over."""
    q, used = gradient.copy(), []
    for s, y in zip(reversed(steps), reversed(changes)):
        curve = (s * y).sum(0)
        good = curve > 1e-12
        alpha = np.where(good, (s * q).sum(0) / np.where(good, curve, 1), 0)
        q -= alpha * y
        used.append((s, y, curve, good, alpha))
    if used:
        s, y, curve, good, _ = used[0]
        q *= np.where(good, curve / np.where(good, (y * y).sum(0), 1), 1)
    for s, y, curve, good, alpha in reversed(used):
        q += s * np.where(good, alpha - (y * q).sum(0) / np.where(good, curve, 1), 0)
    return -q


def _fit_block(rows: DataFrame, names: Sequence[str], places: int, c: float, iters: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, intercepts, recalls) of some categories: minima of the mean logistic loss plus |w|^2 / (2 c n), n being a category's rows."""
    at = np.zeros((places + 1, len(names)))

    def evaluate(point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gradient, rest = _evaluated(rows, names, point[:-1], point[-1])
        count = np.maximum(rest[-1 - ROWS], 1)
        decay = 1 / (c * count)
        gradient = gradient / count
        gradient[:-1] += decay * point[:-1]
        return rest[-1 - LOSS] / count + decay / 2 * (point[:-1] ** 2).sum(0), gradient, rest

    loss, gradient, rest = evaluate(at)
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    open_ = np.ones(len(names), bool)
    for _ in range(iters):
        open_ &= np.abs(gradient).max(0) > tol
        if not open_.any():
            break
        move = np.where(open_, _direction(gradient, steps, changes), 0)
        slope = (move * gradient).sum(0)
        uphill = open_ & (slope >= 0)
        move = np.where(uphill, -gradient, move)
        slope = np.where(uphill, -(gradient**2).sum(0), slope)
        size = np.ones(len(names)) if steps else 1 / np.maximum(np.sqrt((gradient**2).sum(0)), 1)
        seeking, new = open_.copy(), at.copy()
        new_loss, new_gradient = loss.copy(), gradient.copy()
        for _ in range(30):
            trial = np.where(seeking, at + size * move, new)
            trial_loss, trial_gradient, rest = evaluate(trial)
            fine = seeking & (trial_loss <= loss + 1e-4 * size * slope + 1e-15)
            new = np.where(fine, trial, new)
            new_loss, new_gradient = np.where(fine, trial_loss, new_loss), np.where(fine, trial_gradient, new_gradient)
            seeking &= ~fine
            if not seeking.any():
                break
            size = np.where(seeking, size / 2, size)
        open_ &= ~seeking  # no step helps: as low as doubles can tell
        steps, changes = [*steps, new - at][-MEMORY:], [*changes, new_gradient - gradient][-MEMORY:]
        at, loss, gradient = new, new_loss, new_gradient
    _, _, rest = evaluate(at)
    return at[:-1], at[-1], rest[-1 - FOUND] / np.maximum(rest[-1 - THERE], 1)


class CategoryModels(OwnModel):
    """``weights``: (place, codes, coefficients), the row ``INTERCEPT`` holding the intercepts; ``categories``: names in the order of their codes."""

    def __init__(self, weights: DataFrame, categories: Sequence[str], features: str = "features"):
        super().__init__()
        self.weights, self.categories, self.features = weights, list(categories), features

    def values(self) -> dict[str, object]:
        return {"categories": self.categories, "features": self.features}

    def parts(self) -> dict[str, DataFrame]:
        return {"weights": self.weights}

    def only(self, code: int) -> CategoryModels:
        """The model of one category alone."""
        mine = F.filter(F.arrays_zip("codes", "coefficients"), lambda p: p["codes"] == code)
        one = self.weights.select("place", F.transform(mine, lambda p: p["codes"]).alias("codes"), F.transform(mine, lambda p: p["coefficients"]).alias("coefficients"))
        return CategoryModels(one.where(F.size("codes") > 0), self.categories, self.features)

    def _transform(self, df: DataFrame) -> DataFrame:
        """One row per row and category: the row's columns, ``category``, ``margin`` and ``probability``."""
        rows = stage(df.withColumn("_no", F.monotonically_increasing_id()))
        at, x = filled(self.features)
        entries = rows.select("_no", F.inline(F.arrays_zip(at.alias("place"), x.alias("x")))).toDF("_no", "place", "x")
        names = df.sparkSession.createDataFrame(list(enumerate(self.categories)), "code int, category string")
        scored = margins(rows.select("_no"), entries.withColumn("place", F.col("place").cast("int")), "_no", self.weights, F.lit(INTERCEPT))
        told = scored.join(broadcast_small(names), "code").withColumn("probability", 1 / (1 + F.exp(-F.col("margin"))))
        return rows.join(told, "_no").select(*df.columns, "category", "margin", "probability")


def margins(rows: DataFrame, entries: DataFrame, id: str, weights: DataFrame, intercept: Column) -> DataFrame:
    """(id, code, margin) of every row for every code that the row ``intercept`` of the weights lists.

    ``entries``: (id, place, x); ``weights``: one packed row (place, codes, coefficients) per place. Every
    row holds the intercept's place once, so rows without entries get margins, too.
    """
    whole = stage(entries.select(id, "place", "x").unionByName(rows.select(id, intercept.alias("place"), F.lit(1.0).alias("x"))))
    met = skew_join(whole, weights, ["place"], whole.groupBy("place").agg(F.count(F.lit(1)).alias("n")))
    each = met.select(id, "x", F.inline(F.arrays_zip("codes", "coefficients"))).toDF(id, "x", "code", "w")
    return each.groupBy(id, "code").agg(F.sum(F.col("x") * F.col("w")).alias("margin"))


def packed_weights(long: DataFrame, place: str, code: str, coefficient: str) -> DataFrame:
    """One row per place: the codes it weighs for and their coefficients."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(code).alias("c"), F.col(coefficient).alias("w"))))
    return long.groupBy(F.col(place).alias("place")).agg(pairs.alias("_p")).select(
        "place", F.transform("_p", lambda p: p["c"]).alias("codes"), F.transform("_p", lambda p: p["w"]).alias("coefficients"))


def fit_categories(
    vectors: DataFrame, categories: Sequence[object], places: int, c: float = 1.0, iters: int = 100, tol: float = 1e-5, features: str = "features",
) -> tuple[CategoryModels, dict[object, float]]:
    """A logistic model per category with ridge penalty |w|^2 / (2 c) over its summed losses, and each one's training recall.

    ``vectors``: staged (features, _in) of :func:`learners.category_vectors`; ``places``: the vectors' length.
    As many categories as make ``CELLS`` coefficients step in the same jobs. A category without rows
    has the model 0.
    """
    spark = vectors.sparkSession
    rows = stage(category_rows(vectors, features))
    names = [str(cat) for cat in categories]
    many = max(CELLS // max(places, 1), 1)
    parts, recall = None, {}
    for i in range(0, len(names), many):
        mine = names[i : i + many]
        weights, intercepts, found = _fit_block(rows, mine, places, c, iters, tol)
        recall |= dict(zip(categories[i : i + many], found.tolist()))
        used = np.flatnonzero(weights.any(axis=1))
        table = pa.table({
            "place": pa.array(np.append(used, INTERCEPT), pa.int32()), "codes": [list(range(i, i + len(mine)))] * (len(used) + 1),
            "coefficients": [*weights[used].tolist(), intercepts.tolist()]})
        block = spark.createDataFrame(table).select("place", F.col("codes").cast("array<int>").alias("codes"), "coefficients")
        parts = block if parts is None else parts.unionByName(block)
    # Codes and coefficients of a place come as pairs, so that blocks stay in step.
    pairs = parts.select("place", F.inline(F.arrays_zip("codes", "coefficients"))).toDF("place", "code", "w")
    return CategoryModels(stage(packed_weights(pairs, "place", "code", "w")), names, features), recall
