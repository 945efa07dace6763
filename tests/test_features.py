"""Vocabularies that stay tables."""

import math
from collections import Counter

import pytest
from pyspark.ml import PipelineModel

from shelfsift.operators import clusters, joins
from shelfsift.operators.features import TokenCounts, count_features
from shelfsift.operators.learners import count_and_tfidf, merged_features

TEXTS = ["red ring red", "gold ring ring", "", "red gold chain", "a ?", None, "gold gold gold"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i % 5, t or "") for i, t in enumerate(TEXTS)], "id int, t string")


def found(df):
    return sorted((r["t"], r["features"].size, dict(zip(r["features"].indices.tolist(), r["features"].values.tolist()))) for r in df.collect())


def words(text):
    return [w for w in (text or "").split() if len(w) > 1]


def places(lists):
    counts = Counter(x for one in lists for x in one)
    return {x: i for i, x in enumerate(sorted(counts, key=lambda x: (-counts[x], x)))}


@pytest.mark.parametrize("most", [1 << 24, 0])
@pytest.mark.parametrize("binary, limit", [(False, None), (True, None), (False, 2)])
def test_counts_equal_brute_force(monkeypatch, rows, most, binary, limit):
    """Copies, empty texts and repeated keys keep their rows, whether the vocabulary is broadcast or not; its table is the model's."""
    monkeypatch.setattr(joins.broadcast_small, "__defaults__", (most,))
    model = count_features("t", binary=binary, max_features=limit).fit(rows)
    at = {w: i for w, i in places([words(t) for t in TEXTS]).items() if limit is None or i < limit}
    want = sorted((t or "", len(at), dict(sorted((at[w], 1.0 if binary else float(n)) for w, n in Counter(words(t)).items() if w in at))) for t in TEXTS)
    assert found(model.transform(rows)) == want
    assert isinstance(model.stages[0], TokenCounts) and model.stages[0].vocabulary.count() == len(at)
    assert not model.transform(rows).schema["features"].metadata  # Spark would list every feature there


def test_other_columns_stay(spark):
    """Whatever they are called."""
    df = spark.createDataFrame([(i + 50, i + 60, t or "") for i, t in enumerate(TEXTS)], "_no int, _vector int, t string")
    got = count_features("t").fit(df).transform(df)
    assert got.columns == [*df.columns, "features"]
    assert sorted((r["_no"], r["_vector"], r["t"]) for r in got.collect()) == sorted(tuple(r) for r in df.collect())


def test_side_by_side(rows, tmp_path):
    pairs = [[f"{a} {b}" for a, b in zip(words(t), words(t)[1:])] for t in TEXTS]
    at, then = places([words(t) for t in TEXTS]), places(pairs)
    want = sorted((t or "", len(at) + len(then), dict(sorted({**{at[w]: float(n) for w, n in Counter(words(t)).items()},
                   **{len(at) + then[w]: float(n) for w, n in Counter(p).items()}}.items()))) for t, p in zip(TEXTS, pairs))
    model = merged_features("t").fit(rows)
    assert found(model.transform(rows)) == want
    model.write().save(f"{tmp_path}/m")
    assert found(PipelineModel.load(f"{tmp_path}/m").transform(rows)) == want


def test_weighted_beside_counts(rows):
    at = places([words(t) for t in TEXTS])
    df = Counter(w for t in TEXTS for w in set(words(t)))
    got = found(count_and_tfidf("t").fit(rows).transform(rows))
    for text, size, x in got:
        want = {at[w]: float(n) for w, n in Counter(words(text)).items()}
        want |= {len(at) + at[w]: n * math.log((len(TEXTS) + 1) / (df[w] + 1)) for w, n in Counter(words(text)).items()}
        assert size == 2 * len(at) and x == pytest.approx(want)


def test_topics_name_their_words(rows):
    from pyspark.sql import functions as F
    model = clusters.topics(rows, F.split("t", " "), 2, 2)
    got = clusters.topic_words(model, 2).collect()
    assert {(r["topic"], r["rank"]) for r in got} == {(t, i) for t in range(2) for i in range(2)}
    assert {r["word"] for r in got} <= {w for t in TEXTS for w in (t or "").split(" ")}
