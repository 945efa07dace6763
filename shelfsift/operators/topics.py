"""Topics fitted online, by the steps of Spark's online optimiser, without a matrix of topics and words anywhere.

A step shrinks what each word weighs in each topic, adds the same to every word, and adds to the words of its batch what their
texts say. So a word's weight is A * its first weight + E + what its texts have said so far. First weights are numbers by hash,
A and E are two numbers, and only the words of the batches so far have a line in a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.operators.joins import skew_join
from shelfsift.operators.saved import OwnModel
from shelfsift.operators.sparse import Batches, filled, hashed
from shelfsift.session import stage

SHAPE = 100.0  # of the gamma numbers that everything begins with
SHARE, DELAY, DECAY = 0.05, 1024, 0.51  # of the texts in a batch; of the step sizes
ROW = "_topic_row"  # a name that no caller's column has


STEPS = np.arange(8.0)


def digamma(x: np.ndarray) -> np.ndarray:
    z = 1 / (x + 8) ** 2
    return np.log(x + 8) - 0.5 / (x + 8) - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240))) - (1 / (x[..., None] + STEPS)).sum(axis=-1)


def trigamma(x: np.ndarray) -> np.ndarray:
    z = 1 / (x + 8) ** 2
    return 1 / (x + 8) + z / 2 + z / (x + 8) * (1 / 6 - z * (1 / 30 - z / 42)) + (1 / (x[..., None] + STEPS) ** 2).sum(axis=-1)


def begun(numbers: np.ndarray, k: int, seed: int) -> np.ndarray:
    """(number, topic): nearly gamma numbers of mean 1, by hash."""
    at = numbers.astype(np.int64)[:, None] * k + np.arange(k)
    normal = np.sqrt(-2 * np.log(hashed(2 * at, seed))) * np.cos(2 * math.pi * hashed(2 * at + 1, seed))
    return (1 - 1 / (9 * SHAPE) + normal / (3 * math.sqrt(SHAPE))) ** 3


def _expected(x: np.ndarray) -> np.ndarray:
    both = digamma(np.concatenate([x, x.sum(axis=-1, keepdims=True)], axis=-1))
    return both[..., :-1] - both[..., -1:]


def inferred(words: np.ndarray, x: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a text says of its topics, and of its words in each: ``words`` (word, topic) are their exponentiated expectations."""
    topics = np.exp(_expected(gamma))
    norm = words @ topics + 1e-100
    while True:
        last, gamma = gamma, topics * (words.T @ (x / norm)) + alpha
        topics = np.exp(_expected(gamma))
        norm = words @ topics + 1e-100
        if np.abs(gamma - last).mean() <= 1e-3:
            return gamma, np.outer(x / norm, topics)


def _texts(source: Batches, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, places, values, what is said of them) of each row, from lines sorted by row."""
    held: list[tuple[np.ndarray, ...]] = []

    def cut(lines: tuple[np.ndarray, ...], last: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        nonlocal held
        no = lines[0]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(no)) + 1, [len(no)]])
        for a, b in zip(edges[:-1], edges[1:] if last else edges[1:-1]):
            yield int(no[a]), *(v[a:b] for v in lines[1:])
        held = [] if last else [tuple(v[edges[-2] :] for v in lines)]

    for batch in source:
        if len(batch):
            said = batch["s"].fill_null(pa.scalar([0.0] * k, batch["s"].type)).flatten().to_numpy().reshape(-1, k)
            held.append((batch[ROW].to_numpy(), batch["place"].to_numpy(), batch["x"].to_numpy(), said))
            yield from cut(tuple(map(np.concatenate, zip(*held))), False)
    if held:
        yield from cut(tuple(map(np.concatenate, zip(*held))), True)


class TopicModel(OwnModel):
    """``said``: (place, n, s), what the texts have said of a word in each topic; ``first`` and ``every``: A and E; ``sums``: of the words' weights by topic."""

    def __init__(self, said: DataFrame, alpha: list[float], first: float, every: float, sums: list[float], places: int, seed: int, features: str, output: str):
        super().__init__()
        self.said, self.alpha, self.first, self.every, self.sums = said, list(alpha), first, every, list(sums)
        self.places, self.seed, self.features, self.output = places, seed, features, output

    def values(self) -> dict[str, object]:
        return {n: getattr(self, n) for n in ("alpha", "first", "every", "sums", "places", "seed", "features", "output")}

    def parts(self) -> dict[str, DataFrame]:
        return {"said": self.said}

    def weights(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        k, first, every, seed = len(self.alpha), self.first, self.every, self.seed
        return lambda places, said: first * begun(places, k, seed) + every + said

    def lines(self, rows: DataFrame) -> DataFrame:
        """Sorted lines (row, place, x, s) of staged (row, features)."""
        at, x = filled(self.features)
        entries = stage(rows.select(ROW, F.inline(F.arrays_zip(at.alias("place"), x.alias("x")))).toDF(ROW, "place", "x").withColumn("place", F.col("place").cast("int")))
        met = skew_join(entries, self.said.select("place", "s"), ["place"], entries.groupBy("place").agg(F.count(F.lit(1)).alias("n")), how="left")
        return met.select(ROW, "place", "x", "s").repartition(ROW).sortWithinPartitions(ROW)

    def words(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        weights, sums = self.weights(), digamma(np.array(self.sums))
        return lambda places, said: np.exp(digamma(weights(places, said)) - sums)

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = stage(df.withColumn(ROW, F.monotonically_increasing_id()))
        words, alpha, seed, k = self.words(), np.array(self.alpha), self.seed, len(self.alpha)

        def run(source: Batches) -> Batches:
            for no, places, x, said in _texts(source, k):
                gamma, _ = inferred(words(places, said), x, alpha, begun(np.array([no]), k, seed + 1)[0])
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([(gamma / gamma.sum()).tolist()])], [ROW, "_g"])

        told = self.lines(rows.select(ROW, self.features)).mapInArrow(run, f"{ROW} bigint, _g array<double>")
        none = F.array_repeat(F.lit(0.0), k)
        return rows.join(told, ROW, "left").select(*df.columns, array_to_vector(F.coalesce("_g", none)).alias(self.output))

    def heaviest(self, n: int) -> list[tuple[int, int, int, float]]:
        """(topic, rank, place, weight) of the heaviest words of each topic, weights of a topic's words adding up to 1."""
        weights, k = self.weights(), len(self.alpha)

        def run(source: Batches) -> Batches:
            for batch in source:
                if not len(batch):
                    continue
                places, said = batch["place"].to_numpy(), batch["s"].fill_null(pa.scalar([0.0] * k, batch["s"].type)).flatten().to_numpy().reshape(-1, k)
                found = weights(places, said)
                for t in range(k):
                    best = np.lexsort((places, -found[:, t]))[:n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), t)), pa.array(places[best].astype(np.int64)), pa.array(found[best, t])], ["topic", "place", "weight"])

        spark = self.said.sparkSession
        whole = spark.range(self.places).select(F.col("id").cast("int").alias("place")).join(self.said.select("place", "s"), "place", "left")
        some = stage(whole.mapInArrow(run, "topic bigint, place bigint, weight double"))
        out = []
        for t in range(k):
            best = some.where(F.col("topic") == t).orderBy(F.desc("weight"), "place").limit(n).collect()
            out += [(t, i, r["place"], r["weight"] / self.sums[t]) for i, r in enumerate(best)]
        return out


class Topics(Estimator):
    """``iters`` steps, each on a batch of some ``SHARE`` of the texts drawn with repeats."""

    def __init__(self, k: int, iters: int, seed: int, features: str, output: str):
        super().__init__()
        self.k, self.iters, self.seed, self.features, self.output = k, iters, seed, features, output

    def _fit(self, df: DataFrame) -> TopicModel:
        k, seed = self.k, self.seed
        rows = stage(df.select(self.features))
        total, first_row = rows.count(), rows.first()
        places = 0 if first_row is None else first_row[0].size
        spark, alpha, eta = df.sparkSession, np.full(k, 1 / k), 1 / k

        def firsts(source: Batches) -> Batches:
            for batch in source:
                yield pa.RecordBatch.from_arrays([pa.array([begun(batch["id"].to_numpy(), k, seed).sum(axis=0).tolist()])], ["s"])

        added = [F.sum(F.get("s", F.lit(t))) for t in range(k)]
        sums = np.array([x or 0.0 for x in spark.range(places).mapInArrow(firsts, "s array<double>").agg(*added).first()])
        said = spark.createDataFrame([], "place int, n bigint, s array<double>")
        model = TopicModel(said, alpha.tolist(), 1.0, 0.0, sums.tolist(), places, seed, self.features, self.output)
        for step in range(1, self.iters + 1):
            batch = stage(rows.sample(True, SHARE, seed + step).withColumn(ROW, F.monotonically_increasing_id()))
            if batch.isEmpty():
                continue
            words, now = model.words(), np.array(model.alpha)

            def run(source: Batches) -> Batches:
                for no, where, x, known in _texts(source, k):
                    mine = words(where, known)
                    gamma, stats = inferred(mine, x, now, begun(np.array([no]), k, seed + 7919 * step)[0])
                    lines = np.concatenate([stats * mine, _expected(gamma)[None]])
                    ends = pa.array(np.arange(len(lines) + 1) * k, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(lines.ravel()))], ["place", "s"])

            lines = model.lines(batch).mapInArrow(run, "place int, s array<double>")
            told = stage(lines.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.array(*added).alias("s")))
            share, scale = (DELAY + step) ** -DECAY, total / math.ceil(SHARE * total)
            of_texts = told.where("place < 0").first()
            new = told.where("place >= 0").select("place", "n", F.transform("s", lambda v: v * (share * scale)).alias("s"))
            old = model.said.select("place", "n", F.transform("s", lambda v: v * (1 - share)).alias("s"))
            said = stage(old.unionByName(new).groupBy("place").agg(F.sum("n").alias("n"), F.array(*added).alias("s")))
            stats = np.array([x or 0.0 for x in new.agg(*added).first()])
            sums = (1 - share) * np.array(model.sums) + stats + share * eta * places
            if of_texts is not None:
                now = _moved(now, np.array(of_texts["s"]) / of_texts["n"], of_texts["n"], share)
            model = TopicModel(said, now.tolist(), (1 - share) * model.first, (1 - share) * model.every + share * eta, sums.tolist(), places, seed, self.features, self.output)
        return model


def _moved(alpha: np.ndarray, logs: np.ndarray, texts: int, share: float) -> np.ndarray:
    """A Newton step of the topics' weights before any text, as Spark makes it."""
    slope = texts * (logs - _expected(alpha))
    c, q = texts * trigamma(alpha.sum(keepdims=True))[0], -texts * trigamma(alpha)
    b = (slope / q).sum() / (1 / c + (1 / q).sum())
    new = alpha - share * (slope - b) / q
    return new if (new > 0).all() else alpha
