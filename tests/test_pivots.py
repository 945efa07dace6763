"""The tree of pivots, and the neighbour searches over it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsift.operators import neighbours, pivots
from shelfsift.session import stage

SCHEMA = "_id bigint, _vec array<double>"


def clusters(n, seed, dim=8, centres=20, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))


def frame(spark, vectors, schema=SCHEMA):
    return stage(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], schema))


def small(monkeypatch, cell=50, fan=12, piece=120, tile=32):
    monkeypatch.setattr(pivots, "CELL", cell)
    monkeypatch.setattr(pivots, "FAN", fan)
    monkeypatch.setattr(pivots, "PIECE", piece)
    monkeypatch.setattr(neighbours, "TILE", tile)


def test_every_row_in_one_leaf_of_bounded_size(spark, monkeypatch):
    small(monkeypatch)
    placed, levels, leaves = pivots.grown(frame(spark, clusters(600, 1)))
    counts = {r["_cell"]: r["count"] for r in placed.groupBy("_cell").count().collect()}
    assert len(levels) > 1 and max(counts.values()) <= 50 and placed.select("_id").distinct().count() == 600
    assert counts == {r["_cell"]: r["_n"] for r in leaves.collect()}
    assert all(2 <= len(r["_pivots"]) <= 12 for level in levels for r in level.collect())


def test_copies_fill_a_leaf_and_end_the_splits(spark, monkeypatch):
    small(monkeypatch)
    vectors = np.vstack([np.ones((200, 3)), np.zeros((100, 3)), -np.zeros((100, 3)), clusters(100, 2, 3)])
    placed, _, leaves = pivots.grown(frame(spark, vectors))
    assert placed.count() == 500 and leaves.groupBy().sum("_n").first()[0] == 500
    by_row = {r["_id"]: r["_cell"] for r in placed.collect()}
    assert len({by_row[i] for i in range(200)}) == 1


@pytest.mark.parametrize("spread, cut", [(0.05, 0.98), (2.0, 0.7)])
def test_pairs_equal_brute_force_with_copies(spark, monkeypatch, spread, cut):
    small(monkeypatch)
    vectors = np.vstack([clusters(350, 3, spread=spread), np.ones((60, 8)), np.zeros((5, 8))])
    df = frame(spark, vectors, "id bigint, v array<double>")
    got = [(r["id_a"], r["id_b"]) for r in neighbours.vector_pairs(df, "id", "v", cut).collect()]
    unit = vectors[:410] / np.linalg.norm(vectors[:410], axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= cut, 1))
    assert len(got) == len(set(got)) and set(got) == set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("skip_same, scale", [(False, 1.0), (True, 1e6)])
def test_nearest_equal_brute_force_with_ties(spark, monkeypatch, skip_same, scale):
    small(monkeypatch)
    vectors = scale * np.vstack([np.round(clusters(300, 4, 4, spread=0.4), 1), np.ones((50, 4))])
    df = frame(spark, vectors, "id bigint, v array<double>")
    got = {}
    for r in neighbours.nearest(df, df, "id", "v", 5, skip_same).collect():
        got.setdefault(r["test_id"], []).append((r["distance"], r["train_id"]))
    for i, v in enumerate(vectors):
        dist = np.sqrt(((vectors - v) ** 2).sum(1))
        want = sorted((float(d), j) for j, d in enumerate(dist) if not (skip_same and i == j))[:5]
        assert sorted(got[i]) == want


def test_fewer_rows_than_asked_and_empty_tables(spark, monkeypatch):
    small(monkeypatch)
    schema = "id string, v array<double>"
    some = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], schema)
    none = spark.createDataFrame([], schema)
    assert neighbours.nearest(some, some, "id", "v", 9).count() == 4
    assert neighbours.nearest(none, some, "id", "v", 3).count() == 0
    assert neighbours.nearest(some, none, "id", "v", 3).count() == 0
    assert neighbours.vector_pairs(none, "id", "v", 0.5).count() == 0


def test_a_larger_table_has_larger_cells(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 8)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(800, 16))
    _, levels, leaves = pivots.grown(frame(spark, vectors))
    placed = frame(spark, vectors).withColumn("_r", F.lit(100.0))
    # Where nothing is pruned, each row visits every cell: as many visits a row in any larger table.
    assert pivots.visits(placed, levels).count() <= 4 * pivots.CELLS * 800
    assert [pivots.cell_rows(n) for n in (0, 100, 1600, 1 << 40)] == [8, 8, 100, pivots.LARGEST]
