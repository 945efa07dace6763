import numpy as np
import pytest

from shelfsift.llm import neighbours
from shelfsift.llm.queries import FACTOR, QUERIES


def brute(rows, wanted, k):
    """{(query, rank): (id, score)} over rows of (id, vector)."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = {}
    for q in wanted:
        for x in v[ids == q]:
            scores = (v * x).sum(axis=1)
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
            out.update({(int(q), n): (int(ids[i]), scores[i]) for n, i in enumerate(order, 1)})
    return out


def got(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("k", [1, 7])
def test_factor_one_is_exact(spark, k, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 4)
    monkeypatch.setattr(neighbours, "SHARD", 150)
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 5))
    v = np.round(centres[rng.integers(6, size=500)] * rng.uniform(0.2, 3, (500, 1)) + rng.normal(scale=0.1, size=(500, 5)), 2)
    v[100:200] = v[0]  # a group of copies: ties go by id
    rows = list(enumerate(v))
    vectors = table(spark, rows)
    assert got(neighbours.nearest(vectors, vectors.where("vec_id % 9 = 0"), k, 1.0)) == brute(rows, range(0, 500, 9), k)


def test_recall_on_embeddings(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    found = got(QUERIES["op3_nearest_vectors"](spark, folder))
    assert found.keys() == want.keys()
    pairs = {(q, v) for (q, _), (v, _) in want.items()}
    assert len(pairs & {(q, v) for (q, _), (v, _) in found.items()}) / len(pairs) >= 0.95
    assert FACTOR > 1


def test_edges(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0], 0), (2, [2.0, 1.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0),
         (7, [float("inf"), 1.0], 0), (8, [], 0), (None, [1.0, 1.0], 0), (9, [1.0, 0.0], 0), (20, [-1.0, 0.5], 0)], "vec_id long, embedding array<double>, score int")
    found = got(neighbours.nearest(rows, rows, 20))
    assert {q for q, _ in found} == {1, 2, 9, 20}
    assert [found[1, n] for n in (1, 2, 3)] == [(2, 2.0), (9, 1.0), (20, -1.0)] and len(found) == 12
    assert neighbours.nearest(rows.limit(0), rows, 20).collect() == []
    assert neighbours.nearest(rows, rows.limit(0), 20).collect() == []


@pytest.mark.parametrize("lengths", ["tenfold", "outlier", "both"])
def test_recall_and_order_where_lengths_differ(spark, lengths):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    v = centres[rng.integers(40, size=6000)] + rng.normal(scale=0.6, size=(6000, 64))
    v /= np.sqrt((v**2).sum(axis=1))[:, None]
    if lengths != "outlier":
        v *= 10 ** rng.uniform(-0.5, 0.5, (6000, 1))
    if lengths != "tenfold":
        v[17] *= 1e6
    rows = list(enumerate(v))
    vectors = table(spark, rows)
    wanted = vectors.where("vec_id % 100 = 0")
    want = brute(rows, range(0, 6000, 100), 20)
    assert got(neighbours.nearest(vectors, wanted, 20, 1.0)) == want
    found = got(neighbours.nearest(vectors, wanted, 20, FACTOR))
    assert found.keys() == want.keys()
    pairs = {(q, i) for (q, _), (i, _) in want.items()}
    assert len(pairs & {(q, i) for (q, _), (i, _) in found.items()}) / len(pairs) >= 0.95
