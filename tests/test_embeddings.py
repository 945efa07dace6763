"""Factors of co-occurrence weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsift.operators import embeddings


@pytest.mark.parametrize("piece", [embeddings.PIECE, 3])
def test_factors_equal_numpy_and_loss_falls(spark, monkeypatch, piece):
    monkeypatch.setattr(embeddings, "PIECE", piece)
    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(100), rng.randrange(100))}" for _ in range(12)) for _ in range(150)] + [None, "", "alone"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    dim, ridge, most = 4, 0.05, 5.0
    words, pairs = embeddings.cooc_pairs(df, F.split("t", " "), 3, most)
    per_word = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    rows = [(r["a"], r["b"], r["share"], r["target"]) for r in pairs.collect()]
    start = embeddings._start(words, dim, 1)
    n = words.count()
    mine = np.zeros((n, dim + 1))
    order = {b: i for i, b in enumerate(sorted(r["no"] for r in words.collect()))}
    for r in start.collect():
        mine[order[r["b"]]] = r["x"]

    def fit(other):
        new = np.zeros_like(other)
        for word in range(n):
            left, right = ridge * np.eye(dim + 1), np.zeros(dim + 1)
            for a, b, share, target in rows:
                if order[a] == word:
                    z = np.r_[other[order[b]][:-1], 1.0]
                    left += share * np.outer(z, z)
                    right += share * (target - other[order[b]][-1]) * z
            new[word] = np.linalg.solve(left, right)
        return new

    def loss(u, v):
        error = sum(s * (u[order[a]][:-1] @ v[order[b]][:-1] + u[order[a]][-1] + v[order[b]][-1] - t) ** 2 for a, b, s, t in rows)
        return error + ridge * ((u**2).sum() + (v**2).sum())

    right, losses = start, []
    for _ in range(2):
        left = embeddings.fit_side(pairs, right, per_word, dim, ridge)
        right = embeddings.fit_side(pairs, left, per_word, dim, ridge)
        first = fit(mine)
        mine = fit(first)
        losses.append(embeddings.cooc_loss(pairs, left, right, per_word, ridge))
        assert losses[-1] == pytest.approx(loss(first, mine), rel=1e-9)
    assert losses[1] < losses[0]
    found = {r["word"]: (r["vector"], r["bias"]) for r in embeddings.cooc_factors(df, F.split("t", " "), 3, dim, 2, most=most, ridge=ridge).collect()}
    assert "alone" not in found and len(found) == n
    for r in words.collect():
        want = first[order[r["no"]]] + mine[order[r["no"]]]
        assert np.allclose(found[r["word"]][0], want[:-1], atol=1e-8) and found[r["word"]][1] == pytest.approx(want[-1], abs=1e-8)


def test_no_texts_have_no_factors(spark):
    assert embeddings.cooc_factors(spark.createDataFrame([], "t string"), F.split("t", " "), 3, 2, 1).collect() == []
