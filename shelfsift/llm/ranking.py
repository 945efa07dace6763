"""Ranked lexical search: exact inner products over sparse ball trees of documents.

Queries and documents are sparse vectors over the terms of the queries: a document's coordinate is the
term's weight times its whole-number impact there, a query's is 1 for each of its terms. Documents are
dealt into shards of at most ``SHARD``; each shard gets one tree of balls. A ball has a centre and, as
terms of like weight spread alike, one radius for the coordinates of each of ``BANDS`` bands of weights. No
document of it scores more than the centre's product with the query plus, summed over the bands, the
radius times the length of the query there, both taken over the terms that occur in the ball at all; this
bound is rounded up, so it errs only towards looking. Trees are searched best ball first. A first search of
one leaf per query and shard gives each query a score that at least k documents reach; with that
floor the second search is complete. Leaves are scored in whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.llm.rows import numbered
from shelfsift.llm.words import folded_column, folded_sql, word_numbers
from shelfsift.operators.joins import broadcast_small
from shelfsift.operators.ranks import first_per_group, with_positions
from shelfsift.session import stage

BLOCK = 200_000  # (query, term) pairs searched at a time
SHARD = 4096  # documents under one tree
LEAF = 64
BANDS = 64
SLACK = 1e-9  # relative; sums of some thousand doubles err by less than a hundredth of it

Batches = Iterator[pa.RecordBatch]
Table = Callable[[], Mapping[bytes, int]]


def _vectors(known: Table) -> Callable[[Batches], Batches]:
    """(_id, n, terms, counts): all terms of a text counted, and those that queries hold."""
    def run(source: Batches) -> Batches:
        table = known()
        for batch in source:
            numbers, starts = word_numbers(batch["_text"].to_pylist(), table)
            at = np.flatnonzero(numbers)
            doc = np.searchsorted(starts, at, "right") - 1
            cells, counts = np.unique(doc * (len(table) + 1) + numbers[at], return_counts=True)
            row, term = cells // (len(table) + 1), cells % (len(table) + 1) - 1
            first = pa.array(np.searchsorted(row, np.arange(len(starts))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(np.diff(starts) - 1), pa.ListArray.from_arrays(first, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(first, pa.array(counts, pa.int64()))], ["_id", "n", "terms", "counts"])
    return run


def weight(docs: int, holding: int) -> int:
    """A term's weight by the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impacts(counts: np.ndarray, n: np.ndarray, sizes: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What each occurrence count is worth; ``n``: terms of each text, of which ``sizes`` are counted, ``length``: terms of all texts."""
    m = np.array([50 + 50 * int(x) * docs // length for x in n], np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 20 * np.repeat(m, sizes))


# -- trees -----------------------------------------------------------------------------------


@dataclass
class Rows:
    """Sparse rows: row i holds terms[first[i]:first[i + 1]] with these values."""

    first: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], sizes)
        return Rows(first, self.terms[at], self.values[at])

    def part(self, a: int, b: int) -> Rows:
        x, y = self.first[a], self.first[b]
        return Rows(self.first[a : b + 1] - x, self.terms[x:y], self.values[x:y])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the values of each row; rows may be empty."""
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def products(self, point: np.ndarray) -> np.ndarray:
        return self.sums(self.values * point[self.terms])


@dataclass
class Tree:
    """Documents in the order of the leaves, their impacts, and balls: rows [a, b), children (-1: a leaf), a radius per band, centres."""

    ids: np.ndarray
    docs: Rows
    a: np.ndarray
    b: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    centres: Rows


def _halves(rows: Rows, size: int) -> np.ndarray | None:
    """Rows in the order of their place between two that lie far apart; None if all are the same."""
    squares = rows.sums(rows.values**2)

    def point(i: int) -> np.ndarray:
        out = np.zeros(size)
        out[rows.terms[rows.first[i] : rows.first[i + 1]]] = rows.values[rows.first[i] : rows.first[i + 1]]
        return out

    mean = np.bincount(rows.terms, rows.values, size) / (len(rows.first) - 1)
    one = point(int((squares - 2 * rows.products(mean)).argmax()))
    away = squares - 2 * rows.products(one)
    other = point(int(away.argmax()))
    if (one == other).all():
        return None
    return np.argsort(away - squares + 2 * rows.products(other), kind="stable")


def weight_bands(weights: np.ndarray) -> np.ndarray:
    """The band of each term: terms in the order of their weights, in equal parts."""
    rank = np.empty(len(weights), np.int64)
    rank[np.argsort(weights, kind="stable")] = np.arange(len(weights))
    return rank * BANDS // max(len(weights), 1)


def grow(ids: np.ndarray, docs: Rows, weights: np.ndarray) -> Tree:
    """A tree over documents given by their impacts."""
    size, band = len(weights), weight_bands(weights)
    scaled = Rows(docs.first, docs.terms, docs.values * weights[docs.terms].astype(np.float64))
    order = np.arange(len(ids))
    a, b, left, right, radius, centres = [], [], [], [], [], []

    def ball(x: int, y: int) -> int:
        here = len(a)
        rows = scaled.take(order[x:y])
        centre = np.bincount(rows.terms, rows.values, size) / (y - x)
        held = np.flatnonzero(np.bincount(rows.terms, minlength=size))
        # Squared distances from the centre, as if all coordinates were held, plus what those held change.
        held_by = np.repeat(np.arange(y - x) * BANDS, np.diff(rows.first)) + band[rows.terms]
        at = centre[rows.terms]
        squares = np.bincount(held_by, (rows.values - at) ** 2 - at**2, (y - x) * BANDS).reshape(-1, BANDS) + np.bincount(band, centre**2, BANDS)
        # Squares cancel: what is lost there is at most a share of the largest square.
        loss = SLACK * np.bincount(held_by, rows.values**2, (y - x) * BANDS).reshape(-1, BANDS).max(axis=0)
        a.append(x), b.append(y), left.append(-1), right.append(-1), centres.append((held, centre[held]))
        radius.append(np.sqrt(np.maximum(squares, 0).max(axis=0) + loss))
        if y - x > LEAF:
            turned = _halves(rows, size)
            if turned is not None:
                order[x:y] = order[x:y][turned]
                middle = (x + y) // 2
                left[here], right[here] = ball(x, middle), ball(middle, y)
        return here

    if len(ids):
        ball(0, len(ids))
    first = np.concatenate([[0], np.cumsum([len(h) for h, _ in centres])]).astype(np.int64)
    together = [np.concatenate([c[i] for c in centres]) if centres else np.empty(0) for i in (0, 1)]
    return Tree(ids[order], docs.take(order), *(np.array(x, np.int64) for x in (a, b, left, right)),
                np.array(radius, np.float64).reshape(-1, BANDS), Rows(first, together[0].astype(np.int64), together[1]))


def search(tree: Tree, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, leaves: float = math.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (-score, id) of one query that score at least ``floor`` (and more than 0), and how many documents were scored.

    ``leaves``: after so many leaves the search ends, and what it has found are some documents, not the best.
    """
    if not len(tree.ids):
        return [], 0
    asked = np.zeros(len(weights), np.int64)
    asked[terms] = weights[terms]
    centres, band = tree.centres, weight_bands(weights)[terms]

    def bound(ball: int) -> float:
        x, y = centres.first[ball], centres.first[ball + 1]
        at = np.minimum(np.searchsorted(centres.terms[x:y], terms), y - x - 1)
        met = centres.terms[x:y][at] == terms
        length = np.sqrt(np.bincount(band[met], minlength=BANDS))
        return (centres.values[x:y][at[met]].sum() + tree.radius[ball] @ length) * (1 + SLACK) + 1

    best: list[tuple[int, int]] = []  # a heap with the worst of the best on top: (score, -id)
    least, scored = max(floor, 1), 0
    open_balls = [(-bound(0), 0)]
    while open_balls and leaves > 0:
        top, ball = heapq.heappop(open_balls)
        if -top < least:
            break
        if tree.left[ball] >= 0:
            for child in (tree.left[ball], tree.right[ball]):
                most = bound(child)
                if most >= least:
                    heapq.heappush(open_balls, (-most, int(child)))
            continue
        leaves -= 1
        a, b = int(tree.a[ball]), int(tree.b[ball])
        rows = tree.docs.part(a, b)
        scores = rows.sums(rows.values * asked[rows.terms])
        scored += b - a
        for i in np.flatnonzero(scores >= least):
            found = (int(scores[i]), -int(tree.ids[a + i]))
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)
        if len(best) == k:
            least = max(least, best[0][0])
    return [(-s, -i) for s, i in best], scored


# -- jobs ------------------------------------------------------------------------------------


TREE = (
    "ids array<bigint>, first array<bigint>, terms array<int>, impacts array<int>, a array<bigint>, b array<bigint>, "
    "l array<bigint>, r array<bigint>, radius array<double>, centre_first array<bigint>, centre_terms array<int>, centre_values array<double>")


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _grown(corpus: Callable[[], tuple[int, int, np.ndarray]]) -> Callable[[Batches], Batches]:
    names = [c.split()[0] for c in TREE.split(", ")]

    def run(source: Batches) -> Batches:
        docs, length, weights = corpus()

        def tree(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(batches).combine_chunks()
            sizes = t["terms"].combine_chunks().value_lengths().to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            counts = t["counts"].combine_chunks().flatten().to_numpy()
            values = impacts(counts, t["n"].to_numpy(), sizes, docs, length)
            grown = grow(t["_id"].to_numpy(), Rows(first, t["terms"].combine_chunks().flatten().to_numpy(), values), weights)
            whole, real, small = pa.int64(), pa.float64(), pa.int32()
            parts = ((grown.ids, whole), (grown.docs.first, whole), (grown.docs.terms, small), (grown.docs.values, small), (grown.a, whole), (grown.b, whole),
                     (grown.left, whole), (grown.right, whole), (grown.radius.ravel(), real), (grown.centres.first, whole), (grown.centres.terms, small), (grown.centres.values, real))
            return pa.RecordBatch.from_arrays([_list(*p) for p in parts], names)

        waiting, rows = [], 0
        for batch in source:
            while len(batch):
                part = batch.slice(0, SHARD - rows)
                batch = batch.slice(len(part))
                waiting.append(part)
                rows += len(part)
                if rows == SHARD:
                    yield tree(waiting)
                    waiting, rows = [], 0
        if waiting:
            yield tree(waiting)
    return run


def _searched(queries: Callable[[], tuple[np.ndarray, list[np.ndarray], list[int]]], k: int, leaves: float) -> Callable[[Batches], Batches]:
    def run(source: Batches) -> Batches:
        weights, asked, floors = queries()
        for batch in source:
            for r in range(len(batch)):
                c = {name: batch[name][r].values.to_numpy() for name in batch.schema.names}
                tree = Tree(c["ids"], Rows(c["first"], c["terms"], c["impacts"].astype(np.int64)), c["a"], c["b"], c["l"], c["r"], c["radius"].reshape(-1, BANDS),
                            Rows(c["centre_first"], c["centre_terms"], c["centre_values"]))
                out, scored = [], 0
                for q, terms in enumerate(asked):
                    found, n = search(tree, terms, weights, k, floors[q], leaves)
                    out += [(q, -s, i) for s, i in found]
                    scored += n
                q, s, i = (np.array(x, np.int64) for x in (zip(*out) if out else ([], [], [])))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s), pa.array(i)], ["q", "score", "_id"])
    return run


def _rank_block(rows: DataFrame, asked: Sequence[Sequence[str]], k: int) -> DataFrame:
    """(q, _id, score): at least the k best rows for each of some queries, q being their number."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    known = {t.encode(): n for n, t in enumerate(sorted({t for terms in asked for t in terms}), 1)}
    table = sc.broadcast(known)
    vectors = stage(rows.select("_id", F.col("_text").cast("binary").alias("_text")).mapInArrow(
        _vectors(lambda: table.value), "_id bigint, n bigint, terms array<int>, counts array<bigint>"))
    docs, length = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row per term of the queries at most
    weights = np.array([weight(docs, holding.get(t, 0)) for t in range(len(known))], np.int64)
    numbers = [np.array(sorted(known[t.encode()] - 1 for t in terms), np.int64) for terms in asked]
    corpus = sc.broadcast((docs, length, weights))
    trees = stage(vectors.where(F.size("terms") > 0).mapInArrow(_grown(lambda: corpus.value), TREE))

    def found(floors: list[int], leaves: float) -> DataFrame:
        sent = sc.broadcast((weights, numbers, floors))
        return trees.mapInArrow(_searched(lambda: sent.value, k, leaves), "q bigint, score bigint, _id bigint")

    # The k-th best of what one leaf of every tree holds: no query's k-th best of all scores less.
    near = first_per_group(found([0] * len(numbers), 1), ["q"], [F.desc("score"), F.col("_id")], k, ["_id"])
    floors = [0] * len(numbers)
    for r in near.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect():  # one row per query
        floors[r["q"]] = r["s"]
    return found(floors, math.inf)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item key, rank, key, score): the k highest-scoring rows of ``docs`` with a score above 0 for each item, equal scores by ascending key.

    Terms are runs of letters, digits and non-ASCII characters, A-Z as a-z, of whole texts; each counts
    once in an item, however often it is there. Null and empty texts have no terms, and items without
    terms, or of terms that no document holds, no rows. Rows of one item key, null included, are one
    item; rows of documents with equal keys are ranked each, in the order of a hash of their texts, and null
    keys come after all others. Other columns are not looked at.
    """
    spread_terms = items.select(F.col(item_key).alias("_item"), F.explode(folded_column(F.col(item_text))).alias("term")).distinct()
    placed = with_positions(spread_terms, [], [F.col("_item").asc_nulls_last(), F.col("term")], "_p")
    asked = placed.groupBy("_item").agg(F.floor(F.min("_p") / BLOCK).alias("_block"), F.min("_p").alias("_first"), F.collect_list("term").alias("terms"))
    asked = stage(with_positions(asked, ["_block"], ["_first"], "q"))
    blocks = sorted(r[0] for r in asked.select("_block").distinct().collect())
    named, _ = numbered(docs, key, text)
    order = [F.desc("score"), F.col("_id")]
    top = spread_terms.sparkSession.createDataFrame([], "_block bigint, q bigint, score bigint, _id bigint")
    for b in blocks:
        mine = asked.where(F.col("_block") == b).orderBy("q").select("terms")
        found = _rank_block(named.select("_id", "_text"), [r["terms"] for r in mine.toLocalIterator()], k)
        top = top.unionByName(stage(first_per_group(found, ["q"], order, k, ["_id"]).withColumn("_block", F.lit(b))))
    placed = stage(top.withColumn("rank", F.row_number().over(Window.partitionBy("_block", "q").orderBy(*order))))
    return named.select("_id", "_key").join(broadcast_small(placed), "_id").join(asked, ["_block", "q"]).select(
        F.col("_item").alias(item_key), "rank", F.col("_key").alias(key), "score")


RANKED_SQL = f"""
WITH d AS (SELECT doc_id, {folded_sql('text')} AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest({folded_sql('text')}) AS t FROM benchmark),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
df AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS weight FROM tf, total GROUP BY t),
m AS (SELECT doc_id, 100 - 50 + ((50 * len(w) * docs) // length) AS m FROM d, total WHERE len(w) > 0),
scored AS (
    SELECT item_id, doc_id, CAST(sum(CAST(weight AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM b JOIN tf USING (t) JOIN df USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
