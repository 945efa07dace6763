"""Pairs that are counted or compared in pieces of a bounded size: against plain forms of the same."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shelfsift.functions.vectors import l2, norm
from shelfsift.operators import features, neighbours, similarity


def test_only_texts_with_several_rare_tokens_in_common_are_compared(spark, monkeypatch):
    """Before, each two texts with one rare token in common had their sets brought together."""
    rng, data = random.Random(2), []
    for i in range(60):
        words = [f"w{i}x{j}" for j in range(30)] + [f"pair{min(i, k)}and{max(i, k)}" for k in range(60) if k != i and (i + k) % 3 == 0] + [f"often{j}" for j in range(12)]
        data.append(words)
    for i in range(20):
        near = [w for w in data[i] if rng.random() < 0.9] + [f"new{i}"]
        data.append(near)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(data)], "id bigint, t string")
    met, found = [], similarity._candidates
    monkeypatch.setattr(similarity, "_candidates", lambda *a: met.append(found(*a)) or met[-1])
    got = {(r["id_a"], r["id_b"]) for r in similarity.jaccard_pairs(df, "id", F.split("_text", " "), "t", 0.5).collect()}
    sets = [set(w) for w in data]
    assert got == {(i, j) for i, j in itertools.combinations(range(80), 2) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])} and len(got) == 20
    assert sum(m.count() for m in met) < 2 * len(got)


@pytest.mark.parametrize("least, tile", [(0.2, 16), (0.9, 16), (0.9, 4096)])
def test_lsh_pairs_are_sparks(spark, monkeypatch, least, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    monkeypatch.setattr(neighbours.pivots, "LARGEST", tile)
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 5]]) for i in range(150)] + [(7, [1.0] * 6), (8, [0.0] * 6), (9, None)]
    df = spark.createDataFrame([*rows, rows[3]], "id bigint, v array<double>")
    plain = spark.createDataFrame([r for r in [*rows, rows[3]] if r[1]], "id bigint, v array<double>")
    unit = plain.where(norm("v") > 0).select(F.col("id").alias("_id"), array_to_vector(l2("v")).alias("_unit"))
    reach = (2 - 2 * least) ** 0.5
    model = BucketedRandomProjectionLSH(inputCol="_unit", outputCol="_hash", bucketLength=reach, numHashTables=8, seed=1).fit(unit)
    near = model.approxSimilarityJoin(unit, unit, reach + neighbours.SLACK, "_dist").select(
        F.col("datasetA._id").alias("a"), F.col("datasetB._id").alias("b"), F.round(1 - F.col("_dist") ** 2 / 2, 9)).where("a < b")
    got = neighbours.vector_pairs_lsh(df, "id", "v", least).withColumn("similarity", F.round("similarity", 9))
    want = sorted(map(tuple, near.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_cooccurrence_in_pieces_equals_counting(spark, monkeypatch):
    monkeypatch.setattr(features, "PAIRS", 50)
    rng = random.Random(9)
    words = ["a", "b", "é", "zz", "日"]
    data = [[rng.choice(words) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(" ".join(t),) for t in data] + [(None,)], "t string")
    weights, pairs = Counter(), Counter()
    for t in data:
        for i, j in itertools.combinations(range(len(t)), 2):
            if j - i <= 3:
                key = min(t[i], t[j]), max(t[i], t[j])
                weights[key] += 1 / (j - i)
                pairs[key] += 1
    found = features.cooccurrence(df, F.array_remove(F.split("t", " "), ""), 3)
    assert found.rdd.getNumPartitions() > sum(map(len, data)) * 3 // 60
    got = {(r["first"], r["second"]): (round(r["weight"], 9), r["pairs"]) for r in found.collect()}
    assert got == {k: (round(weights[k], 9), pairs[k]) for k in pairs}
