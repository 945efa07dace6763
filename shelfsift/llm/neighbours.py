"""Approximate nearest neighbours: vantage-point trees per shard and band of lengths, pruned by the triangle inequality.

Shards are cells of vectors around pivots. A first search in one shard bounds the rest: cells beyond the bound are skipped whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.operators.joins import broadcast_small
from shelfsift.session import stage

LEAF = 128
SHARD = 4_096  # vectors per shard, on average
MOST_PIVOTS = 16_384  # vectors picked as pivots; cells of more than SHARD vectors are cut into shards
BLOCK = 2_048  # queries searched together
ASKED = 16_384  # queries for which a shard's trees are built once
PAIRS = 1 << 16  # products taken exactly at once
BAND = 1.1  # lengths in one tree differ by this factor at most
SLACK = 1e-7  # what rounding may add to a distance or product between vectors of length 1

NONE = np.iinfo(np.int64).max

Node = tuple  # ("leaf", places) or (vantage place, radius, inner node, its longest, outer node, its longest)


def usable(vector: str):
    """Not null or empty, without null or non-finite components, not zero."""
    value = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


class Tree:
    """Nearest by inner product, among the places ``own`` of ``ids`` and ``vectors``, whose lengths differ little.

    Vectors are divided by the longest length. A vector no longer than m whose product with a query of length 1
    is above s is nearer to it than sqrt(1 + m^2 - 2s), so the triangle inequality rules out whole subtrees.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, own: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.longest = float(lengths[own].max())
        self.own, self.points, self.lengths = own, vectors[own] / self.longest, lengths[own] / self.longest
        self.rng = np.random.default_rng(len(own))
        self.root = self.build(np.arange(len(own)))

    def build(self, places: np.ndarray) -> Node:
        if len(places) <= LEAF:
            return ("leaf", places)
        vantage = int(places[self.rng.integers(len(places))])
        distance = self.distances(self.points[vantage][None, :], places)[0]
        radius = float(np.median(distance))
        inner = distance <= radius
        if inner.all():  # many at one distance, such as copies of one vector
            inner = distance < radius
            if not inner.any():
                return ("leaf", places)
            radius = float(distance[inner].max())
        near, far = places[inner], places[~inner]
        return (vantage, radius, self.build(near), float(self.lengths[near].max()), self.build(far), float(self.lengths[far].max()))

    def distances(self, queries: np.ndarray, places: np.ndarray) -> np.ndarray:
        points = self.points[places]
        square = (queries**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * (queries @ points.T)
        return np.sqrt(np.maximum(square, 0))

    def search(self, asked: Asked, factor: float) -> None:
        # The lengths alone rule out the whole tree for queries that have k better ones.
        self.visit(self.root, np.flatnonzero(asked.worst() <= self.longest * (1 + SLACK)), asked, factor)

    def visit(self, node: Node, active: np.ndarray, asked: Asked, factor: float) -> None:
        if not len(active):
            return
        if node[0] == "leaf":
            for at in range(0, len(node[1]), 4 * LEAF):
                self.take(active, node[1][at : at + 4 * LEAF], asked)
            return
        vantage, radius, inner, inner_longest, outer, outer_longest = node
        distance = self.distances(asked.units[active], np.array([vantage]))[:, 0]
        near = distance <= radius
        # The other side is out of reach if it begins farther off than any better vector may be, divided by the factor.
        for first, second, longest, side in ((inner, outer, outer_longest, near), (outer, inner, inner_longest, ~near)):
            own_side = active[side]
            self.visit(first, own_side, asked, factor)
            within = np.sqrt(np.maximum(1 + longest**2 - 2 * asked.worst(own_side) / self.longest, 0))
            reach = np.abs(distance[side] - radius) <= within / factor + SLACK
            self.visit(second, own_side[reach], asked, factor)

    def take(self, active: np.ndarray, places: np.ndarray, asked: Asked) -> None:
        product = asked.units[active] @ self.points[places].T
        # Ties by id have to be seen, so what is equal within the rounding is multiplied exactly.
        better = product >= (asked.worst(active) / self.longest - SLACK)[:, None]
        better &= asked.ids[active][:, None] != self.ids[self.own[places]][None, :]
        step = max(1, PAIRS // len(places))
        for at in range(0, len(active), step):
            rows, columns = np.nonzero(better[at : at + step])
            if len(rows):
                asked.offer(active[at : at + step], rows, self.own[places[columns]], self.ids, self.vectors)


class Asked:
    """Queries and the ``k`` best found for each so far, the best first, by product and then by id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray):
        self.ids, self.queries, self.floors = ids, queries, floors
        self.lengths = np.sqrt((queries**2).sum(axis=1))
        self.units = queries / self.lengths[:, None]
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), NONE)

    def worst(self, active: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The k-th score of a query, at least its floor, divided by the query's length."""
        return np.maximum(self.scores[active, -1], self.floors[active]) / self.lengths[active]

    def offer(self, active: np.ndarray, rows: np.ndarray, places: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """``places`` of ``vectors`` for the queries ``active[rows]``; ``rows`` rise."""
        score = (vectors[places] * self.queries[active[rows]]).sum(axis=1)  # exactly the measure asked for
        met, start, n = np.unique(rows, return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(met)), n), np.arange(len(rows)) - np.repeat(start, n)
        scores, found = np.full((len(met), n.max()), -np.inf), np.full((len(met), n.max()), NONE)
        scores[at], found[at] = score, ids[places]
        active = active[met]
        scores, found = np.hstack([self.scores[active], scores]), np.hstack([self.found[active], found])
        order = np.lexsort((found, -scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[active], self.found[active] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)


class Shard:
    """Trees over bands of lengths, the longest vectors first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors**2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        falling, self.trees, at = lengths[order], [], 0
        while at < len(order):
            # A leaf is looked through as a whole, whatever its lengths.
            end = max(at + LEAF, int(np.searchsorted(-falling, -falling[at] / BAND, "right")))
            self.trees.append(Tree(ids, vectors, lengths, order[at:end]))
            at = end

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` nearest of each query but itself, score -inf where there are fewer; those below the floor may be left out."""
        asked = Asked(ids, queries, k, floors)
        for tree in self.trees:
            tree.search(asked, factor)
        return asked.found, asked.scores


class Cells:
    """Pivots of length 1 with the farthest direction, the longest vector and the number of shards of each cell."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.radius, self.longest, self.shards = (np.zeros(len(pivots)) for _ in range(3))

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances of the directions to all pivots, lengths)."""
        lengths = np.sqrt((vectors**2).sum(axis=1))
        return np.sqrt(np.maximum(2 - 2 * ((vectors / lengths[:, None]) @ self.pivots.T), 0)), lengths

    def home(self, distance: np.ndarray) -> np.ndarray:
        return np.where(self.shards > 0, distance, np.inf).argmin(axis=1)

    def reached(self, vectors: np.ndarray, floors: np.ndarray, factor: float) -> list[list[int]]:
        """The cells that may hold a vector better than the floor, and the home cell."""
        distance, lengths = self.distances(vectors)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.shards > 0, (floors / lengths)[:, None] / self.longest, np.inf)
        # A better vector's direction is nearer than this; below a floor of 0 short vectors may be anywhere.
        within = np.where(cosine >= 0, np.sqrt(np.maximum(2 - 2 * cosine, 0)), 2.0)
        hit = (cosine <= 1 + SLACK) & (distance - self.radius <= within / factor + 4 * np.sqrt(SLACK))
        hit[np.arange(len(hit)), self.home(distance)] = True
        return [np.flatnonzero(row).tolist() for row in hit & (self.shards > 0)]


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _search(trees: DataFrame, shards: int, visits: DataFrame, k: int, factor: float, floors_only: bool) -> DataFrame:
    """The k best in the shard of each visit; or just the k-th score.

    A shard goes out once for every ASKED queries that visit it (and often enough to give all cores work); its queries follow it, sorted,
    through one task, which holds one shard and one Arrow batch of queries at a time.
    """
    shard = ["_cell", "_tile"]
    least = -(-2 * trees.sparkSession.sparkContext.defaultParallelism // shards)
    parts = stage(visits.groupBy(*shard).agg(F.greatest(F.ceil(F.count(F.lit(1)) / ASKED), F.lit(least)).cast("int").alias("_parts")))
    groups = parts.agg(F.sum("_parts")).first()[0] or 1
    parts = broadcast_small(parts)
    have = trees.join(parts, shard).select(
        *shard, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), "_ids", "_vectors")
    ask = visits.join(parts, shard).select(
        *shard, F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_kind"), "_row", "_id", "_v", "_floor")
    keys = [*shard, "_part"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_of = None
        for batch in source:
            kind = batch.column("_kind").to_numpy()
            heads = np.flatnonzero(kind == 0)
            for start, end in zip(np.r_[0, heads], np.r_[heads, len(kind)]):
                if start < end and kind[start] == 0:
                    row = batch.slice(int(start), 1)
                    trees_of = Shard(row.column("_ids").flatten().to_numpy(), _matrix(row.column("_vectors").flatten()))
                    start += 1
                for at in range(int(start), int(end), BLOCK):
                    some = batch.slice(at, min(BLOCK, int(end) - at))
                    own, rows = some.column("_id").to_numpy(), some.column("_row").to_numpy()
                    ids, scores = trees_of.search(own, _matrix(some.column("_v")), k, factor, some.column("_floor").to_numpy())
                    if floors_only:
                        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(scores[:, -1])], ["_row", "_floor"])
                        continue
                    has = scores > -np.inf
                    wide = [np.repeat(x, k).reshape(ids.shape)[has] for x in (rows, own)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*wide, ids[has], scores[has])], ["_row", "query_id", "_found", "score"])

    met = have.unionByName(ask, allowMissingColumns=True).repartition(int(groups), *keys).sortWithinPartitions(*keys, "_kind")
    return met.mapInArrow(batches, "_row long, _floor double" if floors_only else "_row long, query_id long, _found long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` rows of ``vectors`` with the largest inner product for each query but itself.

    A cell or a subtree is skipped where the triangle inequality puts it beyond the distance within which a vector
    of its lengths could beat the k-th, divided by ``factor``: 1 gives exact results, more prunes more.
    Vectors of like lengths share a tree, so one that is far longer than the rest changes nothing for them. Ties go to the smaller key. Vectors that are
    null, empty, zero, or hold null or non-finite components take no part, nor do rows without a key;
    fewer candidates than ``k`` give fewer rows; empty tables give none. All vectors must have one length.
    Rows with the same key are one candidate each, and none of them one for a query of that key; each query row gets its own results.

    Every vector belongs to the cell of its nearest pivot by direction; pivots are a sample by hash, one in SHARD and
    MOST_PIVOTS at most. A cell of any size, a cluster of a third of all rows among them, is dealt into shards by a hash of the key. Each query
    searches one shard of its own cell first; the k-th product there is a floor for the second search, which it takes to the shards of
    all cells within reach. Queries travel, trees stay.
    """
    def taken(df: DataFrame) -> DataFrame:
        return df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))

    rows = stage(taken(vectors))
    wanted = stage(taken(queries).withColumn("_row", F.monotonically_increasing_id()))
    count = min(MOST_PIVOTS, -(-rows.count() // SHARD))
    if count == 0:
        return wanted.limit(0).select(F.col("_id").alias("query_id"), F.lit(0).alias("rank"), F.col("_id").alias(key), F.lit(0.0).alias("score"))
    picked = np.array([r["_v"] for r in rows.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(count).collect()], np.float64)
    cells = Cells(picked / np.sqrt((picked**2).sum(axis=1))[:, None])

    @F.pandas_udf("struct<_cell:int,_away:double,_length:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        distance, lengths = cells.distances(_vectors(v))
        cell = distance.argmin(axis=1)
        return pd.DataFrame({"_cell": cell.astype("int32"), "_away": distance[np.arange(len(cell)), cell], "_length": lengths})

    placed = stage(rows.select("_id", "_v", place("_v").alias("_p")).select("_id", "_v", "_p.*"))
    for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_away").alias("far"), F.max("_length").alias("long")).collect():
        at = r["_cell"]
        cells.shards[at], cells.radius[at], cells.longest[at] = -(-r["n"] // SHARD), r["far"], r["long"]
    tiles = F.broadcast(rows.sparkSession.createDataFrame([(c, int(n)) for c, n in enumerate(cells.shards) if n], "_cell int, _tiles int"))

    def tile(id: str) -> Column:
        return F.pmod(F.xxhash64(id, F.lit(7)), F.col("_tiles")).cast("int").alias("_tile")

    trees = placed.join(tiles, "_cell").select("_cell", tile("_id"), "_id", "_v").groupBy("_cell", "_tile").agg(
        F.sort_array(F.collect_list(F.struct("_id", "_v"))).alias("_rows"))
    trees = stage(trees.select("_cell", "_tile", F.col("_rows._id").alias("_ids"), F.col("_rows._v").alias("_vectors")))
    shards = int(cells.shards.sum())

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(cells.home(cells.distances(_vectors(v))[0]).astype("int32"))

    @F.pandas_udf("array<int>")
    def reached(v: pd.Series, floors: pd.Series) -> pd.Series:
        return pd.Series(cells.reached(_vectors(v), floors.to_numpy(), factor))

    lowest = F.lit(float("-inf"))
    first = wanted.withColumn("_cell", home("_v")).join(tiles, "_cell").select("_cell", tile("_row"), "_row", "_id", "_v", lowest.alias("_floor"))
    floors = _search(trees, shards, first, k, factor, True)
    bounded = stage(wanted.join(floors, "_row"))
    visits = bounded.withColumn("_cell", F.explode(reached("_v", "_floor"))).join(tiles, "_cell").select(
        "_cell", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_tile"), "_row", "_id", "_v", "_floor")
    found = _search(trees, shards, visits, k, factor, False)
    order = Window.partitionBy("_row").orderBy(F.desc("score"), "_found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("_found").alias(key), "score")
