import math
import random
from collections import Counter

import numpy as np
import pytest

from shelfsift.llm import ranking as rk
from shelfsift.llm import words as wd

from .test_decontamination import words


def brute(docs, items, k):
    counted = [(key, Counter(words(text))) for key, text in docs]
    held = [c for _, c in counted if c]
    n, length = len(held), sum(c.total() for c in held)
    df = Counter(t for c in held for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in queries.items():
        scores = []
        for key, c in counted:
            if c:
                m = 100 - 50 + (50 * c.total() * n) // length
                scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms), (key is None, key)))
        out += [(item, r, key[1], -s) for r, (s, key) in enumerate(sorted(x for x in scores if x[0])[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, k):
    left = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    right = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, rank double")
    return sorted(map(tuple, rk.ranked(left, right, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n, vocabulary=60, most=40):
    rng = random.Random(seed)
    terms = [f"t{int(rng.expovariate(0.1))}" for _ in range(vocabulary * 5)]
    return [(i, " ".join(rng.choice(terms) for _ in range(rng.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize("seed, k, leaf, shard", [(1, 5, 2, 16), (2, 1, 1, 50), (3, 50, 4, 4096), (4, 500, 3, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, k, leaf, shard):
    monkeypatch.setattr(rk, "LEAF", leaf)
    monkeypatch.setattr(rk, "SHARD", shard)
    docs, items = corpus(seed, 120), corpus(seed + 10, 9, most=12)
    assert got(spark, docs, items, k) == brute(docs, items, k)


EDGES = [(1, None), (2, ""), (3, "Red bolt"), (3, "red nut"), (None, "red BOLT"), (None, "red"), (4, "red red red bolt"), (5, "É é"), (6, "- . -"), (7, "blue")]


def test_nulls_repeated_keys_and_ties(spark):
    docs = EDGES[:3] + EDGES[4:5] + EDGES[6:] + [(i, "red bolt") for i in range(20, 40)]
    items = [(1, "red bolt"), (1, "blue"), (None, "é"), (2, None), (3, "unknown"), (4, ""), (5, "bolt bolt red")]
    assert got(spark, docs, items, 7) == brute(docs, items, 7)
    repeated = got(spark, EDGES, [(1, "red bolt")], 10)
    assert Counter((d, s) for _, _, d, s in repeated) == Counter((d, s) for _, _, d, s in brute(EDGES, [(1, "red bolt")], 10))
    assert [r for _, r, _, _ in sorted(repeated, key=lambda x: x[1])] == [1, 2, 3, 4, 5]


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(rk, "BLOCK", 10)
    docs, items = corpus(5, 60), corpus(15, 12, most=12)
    assert got(spark, docs, items, 4) == brute(docs, items, 4)


def test_copies_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(rk, "LEAF", 2)
    docs = [(i, "same words here") for i in range(200)]
    assert got(spark, docs, [(1, "words")], 50) == brute(docs, [(1, "words")], 50)
    assert got(spark, [], [(1, "a")], 5) == []
    assert got(spark, [(1, "a")], [], 5) == []
    assert got(spark, [(1, None)], [(1, "a")], 5) == []


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(wd, "SLICE", 64)
    docs = [(1, "many words " * 100_000 + "needle"), (2, "needle " * 3), (3, "w" * 500_000)]
    items = [(1, "needle words")]
    assert got(spark, docs, items, 5) == brute(docs, items, 5)


def test_bounds_skip_documents_and_lose_none():
    """Clusters of texts under one tree: a query about one of them scores few documents, and the best of all are found."""
    rng = np.random.default_rng(1)
    topics, size = 8, 8 * 30
    terms = [np.unique(rng.integers(0, 30, 12) + 30 * (i % topics)) for i in range(4000)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    docs = rk.Rows(first, np.concatenate(terms), rng.integers(1, 900_000, first[-1]))
    weights = rng.integers(500, 9000, size)
    tree = rk.grow(np.arange(4000), docs, weights)
    for topic in range(topics):
        asked = np.arange(30 * topic, 30 * topic + 20)
        mask = np.zeros(size, np.int64)
        mask[asked] = weights[asked]
        scores = docs.sums(docs.values * mask[docs.terms])
        want = sorted((-int(s), i) for i, s in enumerate(scores) if s > 0)[:10]
        found, scored = rk.search(tree, asked, weights, 10, 0)
        assert sorted(found) == want and scored < 2000
        again, fewer = rk.search(tree, asked, weights, 10, -want[-1][0])
        assert sorted(again) == want and fewer <= scored
