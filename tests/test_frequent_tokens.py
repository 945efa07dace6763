"""Naive Bayes where frequent tokens meet their weights in place and the others by token."""

import pytest
from pyspark.sql import functions as F

from shelfsift.operators import bayes


def _rows(spark):
    texts = [(i, " ".join(["the", "a" if i % 2 else "b", f"w{i % 7}", f"own{i}"] + ["the"] * (i % 3)), f"c{i % 5}") for i in range(60)]
    return spark.createDataFrame([*texts, (60, "unknown", "c1"), (61, None, "c1"), (62, " ", "c2"), (63, "the the", None)], "id long, t string, c string")


@pytest.mark.parametrize("smoothing", ["laplace", "additive"])
def test_scores_do_not_depend_on_what_is_frequent(spark, monkeypatch, smoothing):
    rows = _rows(spark)
    index = bayes.nb_index(rows.where("id < 50"), "id", "t", "c")
    found = []
    for most in (16 << 20, 2_000, 1):
        monkeypatch.setattr(bayes, "MOST_BROADCAST_BYTES", most)
        scored = bayes.nb_scores(rows, "id", "t", index, smoothing).collect()
        found.append(sorted((r["id"], r["class"], round(r["score"], 9), round(r["probability"], 9)) for r in scored))
    assert found[0] == found[1] == found[2] and len(found[0]) > 250


def test_frequent_tokens_are_the_most_frequent_that_fit(spark, monkeypatch):
    packed = spark.createDataFrame([(t, [1, 2], [0.5, 0.25]) for t in "abcdef"], "token string, _codes array<int>, _weights array<double>")
    frequency = spark.createDataFrame([("a", 3), ("b", 9), ("c", 9), ("d", 1), ("x", 20)], "token string, df long")
    monkeypatch.setattr(bayes, "MOST_BROADCAST_BYTES", 2 * 3 * (1 + 24 + 64))
    assert sorted(r["token"] for r in bayes._frequent(packed, frequency).collect()) == ["b", "c"]  # x is in no class
    assert bayes._frequent(packed.where(F.lit(False)), frequency).count() == 0
