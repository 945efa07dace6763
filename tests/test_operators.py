"""Operators against brute force and worked examples on small tables, hot groups among them."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfsift.functions import distances
from shelfsift.operators import bayes, components, counts, neighbours, pivots, prep, ranks, similarity, truncation
from shelfsift.operators import sequences as sq
from shelfsift.operators.joins import skew_join
from shelfsift.plans import jobs
from shelfsift.session import spread


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- positions and samples -------------------------------------------------------------------


def _hot_groups(n):
    return [("hot" if i % 3 else f"g{i % 7}", f"t{(i * 7919) % n:05d}", i) for i in range(n)]


def test_positions_with_one_hot_group(spark):
    data = _hot_groups(2000)
    df = spark.createDataFrame(data, "g string, t string, i int").repartition(7)
    got = ranks.with_positions(df, ["g"], ["t", "i"], "pos", "n").collect()
    expected = {}
    for g, members in itertools.groupby(sorted(data), key=lambda r: r[0]):
        members = list(members)
        expected |= {r[2]: (p, len(members)) for p, r in enumerate(members)}
    assert {r["i"]: (r["pos"], r["n"]) for r in got} == expected


def test_positions_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g string, i int")
    assert sorted((r["i"], r["pos"]) for r in ranks.with_positions(df, ["g"], ["i"], "pos").collect()) == [(1, 0), (2, 1), (3, 0)]


@pytest.mark.parametrize(
    "n, k, kept",
    [(59, 30, list(range(30))), (10000, 100, list(range(0, 10000, 100))), (7, 3, [0, 2, 4]), (3, 5, [0, 1, 2])],
)
def test_systematic_sample(spark, n, k, kept):
    df = spark.range(n).select(F.lit("a").alias("g"), "id")
    assert [r["id"] for r in ranks.systematic_sample(df, "g", ["id"], k).orderBy("id").collect()] == kept


def test_cap_per_class(spark):
    df = spark.createDataFrame(_hot_groups(500), "g string, t string, i int")
    capped = ranks.cap_per_class(df, "g", 4, "i").collect()
    by_group = {}
    for r in _hot_groups(500):
        by_group.setdefault(r[0], []).append(r[2])
    assert sorted(r["i"] for r in capped) == sorted(i for g in by_group.values() for i in sorted(g)[:4])
    seeded = [rows(ranks.cap_per_class(df, "g", 4, "i", seed=3)) for _ in range(2)]
    assert seeded[0] == seeded[1] and len(seeded[0]) == len(capped)


def test_doc_ids_go_on_from_the_last(spark):
    used = spark.createDataFrame([(4,), (9,)], "item_no bigint")
    assert ranks.next_doc_id(used) == 10 and ranks.next_doc_id(used.where("false")) == 1
    df = spark.range(100).repartition(5)
    assert [r["item_no"] for r in ranks.assign_doc_id(df, ["id"], 10).orderBy("id").collect()] == list(range(10, 110))


# -- preparation -----------------------------------------------------------------------------


def test_first_copies_then_conflicts(spark):
    df = spark.createDataFrame([(1, "t1", "A"), (2, "t1", "A"), (3, "t2", "A"), (4, "t2", "B"), (5, "t3", "B")], "id int, t string, c string")
    two_steps = prep.dedup_drop_conflicts(prep.dedup_keep_first(df, ["t", "c"], ["id"]), ["t"], ["id"])
    assert rows(two_steps) == [(1, "t1", "A"), (5, "t3", "B")]
    assert rows(prep.dedup_unambiguous(df, "t", "c", ["id"])) == rows(two_steps)
    assert rows(prep.dedup_keep_first(two_steps, ["t", "c"], ["id"])) == rows(two_steps)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from(["A", "B", None])), min_size=1, max_size=12))
def test_one_shuffle_dedup_equals_two_steps(spark, data):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(data)], "id int, t string, c string")
    two_steps = prep.dedup_drop_conflicts(prep.dedup_keep_first(df, ["t", "c"], ["id"]), ["t"], ["id"])
    assert sorted(map(str, prep.dedup_unambiguous(df, "t", "c", ["id"]).collect())) == sorted(map(str, two_steps.collect()))


def test_annotation(spark):
    df = spark.createDataFrame(
        [(None, None), ("Category Include", None), (None, "Miscategorized"), ("Other reason", None), ("Scraped Brand", None)],
        "inc string, exc string")
    kinds = [r["type"] for r in prep.annotate_type(df, "inc", "exc").collect()]
    assert kinds == ["True Positive", "False Negative", "False Positive", "Other", "True Positive"]


def test_text_on_both_sides(spark):
    df = spark.createDataFrame([("A", "x", "True Positive"), ("B", "x", "True Positive"), ("A", "y", "False Positive")], "c string, t string, type string")
    assert rows(prep.positives_negatives(df, "A", "c", "t")) == [("x", 0.0), ("x", 1.0), ("y", 0.0)]


def test_min_tokens(spark):
    df = spark.createDataFrame([("one",), ("one two",), ("",), (None,)], "t string")
    assert rows(prep.min_tokens(df, "t")) == [("one two",)]


def test_small_classes_and_balance(spark):
    df = spark.createDataFrame([(i, f"word {i}", "big" if i < 20 else "small") for i in range(23)], "id int, t string, c string")
    prepared = jobs.prepare_training(df, "id", "t", "c")
    assert prepared.count() == 20 and {r["c"] for r in prepared.collect()} == {"big"}
    balanced = jobs.build_balanced(df, "id", "c", 5)
    assert {(r["c"], r["class_rows"]) for r in balanced.collect()} == {("big", 20), ("small", 3)} and balanced.count() == 8


def test_best_of_ties(spark):
    df = spark.createDataFrame([(1, 0.8, "older"), (2, 0.8, "newer"), (3, 0.1, "low")], "no int, score double, name string")
    assert prep.best_of(df, [], "score", "no", "newest").first()["name"] == "newer"
    assert prep.best_of(df, [], "score", "no", "first").first()["name"] == "older"


# -- joins and counts ------------------------------------------------------------------------


def test_salted_join_equals_plain_join(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    weights = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        expected = many.join(one, "k", how).select("k", "id", "v")
        got = skew_join(many, one, ["k"], weights, how=how).select("k", "id", "v")
        assert expected.exceptAll(got).isEmpty() and got.exceptAll(expected).isEmpty()


def test_itemsets(spark):
    df = spark.createDataFrame([("red big red bolt",)], "t string")
    found = {r["items"]: r["hits"] for r in counts.itemsets(df, "t", (3, 4), 0.0, 100.0, 4).collect()}
    assert found == {"big bolt red": 3, "big red": 1, "bolt red": 1}
    texts = ["a b b", "a", "b c a c"]
    every = spark.createDataFrame([(t,) for t in texts], "t string")
    expected = {}
    for t in texts:
        words = t.split()
        for size in range(1, len(words) + 1):
            for chosen in itertools.combinations(words, size):
                key = " ".join(sorted(set(chosen)))
                expected[key] = expected.get(key, 0) + 1
    assert {r["items"]: r["hits"] for r in counts.itemsets_all(every, "t", 0.0).collect()} == expected


@pytest.mark.parametrize("sizes, support, shortest", [((3, 4), 0.0, 0), ((1, 2), 0.1, 0), ((2, 4), 0.3, 3), ((3,), 0.5, 5)])
def test_itemsets_equal_listing(spark, sizes, support, shortest):
    rng = random.Random(len(sizes) + shortest)
    texts = [" ".join(rng.choice("aabbbcdefg") for _ in range(rng.randint(0, 9))) for _ in range(40)] + [None]
    expected = {}
    for t in texts:
        words = (t or "").split()
        if len(words) < max(shortest, min(sizes)):
            continue
        for size in sizes:
            for chosen in itertools.combinations(words, size):
                key = " ".join(sorted(set(chosen)))
                expected[key] = expected.get(key, 0) + 1
    expected = {k: n for k, n in expected.items() if n / len(texts) >= support}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["items"]: r["hits"] for r in counts.itemsets(rows, "t", sizes, support, 1e9, shortest).collect()} == expected
    assert counts.itemsets(rows.limit(0), "t", sizes, support, 1e9, shortest).collect() == []


def test_itemsets_of_a_row_of_200_tokens(spark):
    """Its 64,684,950 choices of four are never listed."""
    rows = spark.createDataFrame([(" ".join(f"t{i}" for i in range(200)),)] + [("t1 t2 t2 t3",)] * 30, "t string")
    got = {r["items"]: r["hits"] for r in counts.itemsets(rows, "t", (3, 4), 0.5, 100.0).collect()}
    assert got == {"t1 t2": 30, "t2 t3": 30, "t1 t2 t3": 2 * 30 + 30 + 1}


def test_truncated_items_example(spark):
    df = spark.createDataFrame([(1, "c", "red bolt"), (2, "c", "red bolt 5mm"), (3, "c", "red bolt"), (4, "d", "red")], "id int, c string, t string")
    assert [r["id"] for r in truncation.truncated_items(df, "c", "t", "id").orderBy("id").collect()] == [1, 3]


@pytest.mark.parametrize("common", [1000, 0])
def test_truncated_items_equal_brute_force(spark, monkeypatch, common):
    """With ``common`` 0 every longer text goes through the finer keys."""
    monkeypatch.setattr(truncation, "COMMON", common)
    rng = random.Random(5)
    words = ["a", "ab", "b", "ba", "abc", ""]
    data = [(i, rng.choice("xy"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    got = {r["id"] for r in truncation.truncated_items(spark.createDataFrame(data, "id int, c string, t string"), "c", "t", "id").collect()}
    assert got == {i for i, c, t in data if any(c == d and t in u and t != u for _, d, u in data)}


# -- Naive Bayes -----------------------------------------------------------------------------

TRAIN = [(1, "red bolt", "A"), (2, "red widget", "B"), (3, "red red nut", "A")]


def _predict(spark, text, smoothing="laplace", prior="count"):
    train = spark.createDataFrame(TRAIN, "id bigint, t string, c string")
    items = spark.createDataFrame([(7, text)], "id bigint, t string")
    r = bayes.nb_predict(items, "id", "t", bayes.nb_index(train, "id", "t", "c"), smoothing, prior).first()
    return r["predicted_category"], round(r["probability"], 6)


@pytest.mark.parametrize(
    "text, smoothing, prior, expected",
    [
        ("red bolt", "laplace", "span", ("A", 0.842105)),
        ("red bolt", "laplace", "count", ("A", 0.780488)),
        ("red bolt", "additive", "span", ("A", 0.683544)),
        ("zzz", "laplace", "count", ("NA", 0.0)),
        ("zzz", "additive", "count", ("NA", -1.0)),
        ("bolt", "laplace", "count", ("A", 1.0)),
    ],
)
def test_naive_bayes_examples(spark, text, smoothing, prior, expected):
    assert _predict(spark, text, smoothing, prior) == expected


PROBES = [
    ("cordless drill 18v", "tools"), ("drill bit set", "tools"), ("hammer 16 oz", "tools"), ("screw driver", "tools"),
    ("baby diaper size 4", "diapers"), ("newborn diaper pack", "diapers"), ("diaper size 4 count 80", "diapers"),
    ("driver seat cover", "car"), ("car seat baby", "car"), ("seat belt pad", "car"),
]


def test_probe_items_keep_their_category(spark):
    train = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(PROBES)], "id bigint, t string, c string")
    index = bayes.nb_index(train, "id", "t", "c")
    got = {r["id"]: r["predicted_category"] for r in bayes.nb_predict(train, "id", "t", index).collect()}
    assert [got[i] for i in range(len(PROBES))] == [c for _, c in PROBES]
    sums = bayes.nb_scores(train, "id", "t", index).groupBy("id").agg(F.sum("probability").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)


def test_explained_factors_multiply_to_the_score(spark):
    train = spark.createDataFrame(TRAIN, "id bigint, t string, c string")
    index = bayes.nb_index(train, "id", "t", "c")
    items = spark.createDataFrame([(7, "red red bolt zzz")], "id bigint, t string")
    logs = bayes.nb_explain(items, "id", "t", index).groupBy("class").agg(F.sum(F.col("n") * F.log("p")).alias("s")).collect()
    prior = {"A": 2 / 3, "B": 1 / 3}
    scores = {r["class"]: r["score"] for r in bayes.nb_scores(items, "id", "t", index).collect()}
    assert {r["class"]: round(r["s"] + math.log(prior[r["class"]]), 9) for r in logs} == {c: round(s, 9) for c, s in scores.items()}


# -- sequences -------------------------------------------------------------------------------


def test_word_index_orders(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c a d")], "id int, t string")
    by_freq = {r["token"]: r["idx"] for r in sq.word_index(df, "t", "freq", ["id"]).collect()}
    first = {r["token"]: r["idx"] for r in sq.word_index(df, "t", "first", ["id"]).collect()}
    assert by_freq == {"b": 1, "a": 2, "c": 3, "d": 4} and first == {"b": 1, "a": 2, "c": 3, "d": 4}


def test_to_sequence_unknown_words(spark):
    index = sq.word_index(spark.createDataFrame([(1, "a b")], "id int, t string"), "t", "first", ["id"])
    df = spark.createDataFrame([(1, "b x a"), (2, "x"), (3, "")], "id int, t string")
    assert rows(sq.to_sequence(df, "id", "t", index, "drop")) == [(1, [2, 1]), (2, []), (3, [])]
    assert rows(sq.to_sequence(df, "id", "t", index, "zero")) == [(1, [2, 0, 1]), (2, [0]), (3, [])]


def test_random_vectors_repeat(spark):
    words = spark.createDataFrame([("a",), ("b",)], "token string")
    one, two = (sq.random_vectors(words, "token", 50, 3).orderBy("token").collect() for _ in range(2))
    assert one == two and one[0]["vector"] != one[1]["vector"]
    assert all(-0.5 <= x < 0.5 for r in one for x in r["vector"])


# -- vectors ---------------------------------------------------------------------------------


def _points(n, seed, clustered):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6)) * (5 if clustered else 0)
    return [(i, [float(x) for x in centres[i % 5 if i % 3 else 0] + rng.normal(size=6)]) for i in range(n)]


@pytest.mark.parametrize("clustered", [True, False])
def test_vector_pairs_equal_brute_force(spark, monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "TILE", 40)
    monkeypatch.setattr(pivots, "CELL", 100)
    data = _points(300, 1, clustered)
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    m = np.array([v for _, v in data])
    m /= np.linalg.norm(m, axis=1)[:, None]
    similar = m @ m.T
    for cut in (0.6, 0.98):
        got = {(r["id_a"], r["id_b"]) for r in neighbours.vector_pairs(df, "id", "v", cut).collect()}
        assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if similar[i, j] >= cut}


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_equals_brute_force(spark, monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "TILE", 40)
    monkeypatch.setattr(pivots, "CELL", 100)
    train, test = _points(300, 2, clustered), _points(50, 3, clustered)
    schema = "id bigint, v array<double>"
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), "id", "v", 4).collect():
        got.setdefault(r["test_id"], []).append((round(r["distance"], 9), r["train_id"]))
    points = np.array([v for _, v in train])
    for i, v in test:
        dist = np.sqrt(((points - np.array(v)) ** 2).sum(1))
        assert sorted(got[i]) == [(round(float(dist[j]), 9), int(j)) for j in np.argsort(dist)[:4]]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 400), 500]], "id bigint")
    found = components.connected_components(nodes, spark.createDataFrame(edges, "id_a bigint, id_b bigint"))
    assert {r["id"]: r["component"] for r in found.collect()} == {
        **{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 400)}, 500: 500}


def test_text_distances():
    assert distances.fuzzy("red bolt", "bolt red") == 0.0
    assert distances.fuzzy("red bolt", "red bolt 5mm") == 0.0
    assert distances.jaro(["a", "b", "c"], ["a", "b", "c"]) == 0.0
    assert distances.jaro(["a"], ["b"]) == 1.0
    assert round(distances.jaro(list("martha"), list("marhta")), 6) == 0.055556
    assert round(distances.jaro(list("dixon"), list("dicksonx")), 6) == 0.233333


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["the"] * 6 + list("abcdefgh")
    data = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(120)})
    df = spark.createDataFrame(list(enumerate(data)), "id bigint, t string")
    got = {(r["id_a"], r["id_b"]) for r in similarity.jaro_pairs(df, "id", "t", 0.25).collect()}
    assert got == {
        (i, j) for i, j in itertools.combinations(range(len(data)), 2)
        if distances.jaro(data[i].split(), data[j].split()) <= 0.25 + 1e-12}
    sets = [set(t.split()) for t in data]
    near = {(r["id_a"], r["id_b"]) for r in similarity.jaccard_pairs(df, "id", F.split("_text", " "), "t", 0.5).collect()}
    assert near == {
        (i, j) for i, j in itertools.combinations(range(len(data)), 2)
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}


def test_short_texts_meet_by_several_tokens(spark, monkeypatch):
    data = [f"b{i} s{j} c{k} d{m} t" for i in range(6) for j in range(6) for k in range(6) for m in range(6)]
    df = spark.createDataFrame(list(enumerate([*data, "b1 s1", " ".join(f"b{i % 6} x{i}" for i in range(40))])), "id bigint, t string")
    met, pairs = [], similarity.self_pairs

    def counted(*args):
        met.append(pairs(*args))
        return met[-1]

    monkeypatch.setattr(similarity, "self_pairs", counted)
    got = [(r["id_a"], r["id_b"]) for r in similarity.jaccard_pairs(df, "id", F.split("_text", " "), "t", 0.6).collect()]
    n = len(data)
    # Texts that differ in one token, 20 for each.
    assert len(got) == len(set(got)) == n * 20 // 2 and all(len(set(data[a].split()) & set(data[b].split())) == 4 for a, b in got)
    assert sum(m.count() for m in met) <= 3 * len(got)


def test_spread_leaves_wide_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, cores + 3)).rdd.getNumPartitions() == cores + 3


def test_fuzzy_pairs_lose_nothing(spark):
    import random

    rng = random.Random(5)
    words = ["bluetooth", "speaker", "speakers", "red", "blue", "tooth", "superlongtoken", "a", "b", "x", "y", "z", "5mm", "bolt", "steel"]
    data = {1: "bluetooth speakers", 2: "blue tooth speaker", 3: "superlongtoken a b", 4: "superlongtoken x y z", 5: "Red-Bolt, 5mm", 6: "5mm red bolt", 7: "---"}
    for i in range(8, 90):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "q", " "]) + text[at + 1 :]
        data[i] = text
    df = spark.createDataFrame(list(data.items()), "id bigint, t string")
    first = {}
    for i, t in sorted(data.items()):
        first.setdefault(t, i)
    ids = sorted(first.values())
    for most in (0.1, 0.3):
        want = {(i, j) for i in ids for j in ids if i < j and distances.fuzzy(data[i], data[j]) <= most}
        got = {(r["id_a"], r["id_b"]) for r in similarity.fuzzy_pairs(df, "id", "t", most).collect()}
        assert got == want
    assert {(1, 2), (3, 4)} <= got


def test_self_pairs_of_a_frequent_key(spark):
    rows = spark.createDataFrame([("hot", i, i % 3) for i in range(1300)] + [("cold", 5, 0), ("cold", 9, 1), ("one", 3, 2)], "k string, no int, v int")
    got = similarity.self_pairs(rows, ["k"], "no", ["v"]).select("k", "no_a", "no_b").collect()
    assert len(got) == len(set(got)) == 1300 * 1299 // 2 + 1


def test_itemsets_of_a_long_row(spark):
    rows = spark.createDataFrame([(" ".join(f"t{i}" for i in range(40)),)] + [("t1 t2 t2",)] * 30, "t string")
    got = {r["items"]: r["hits"] for r in counts.itemsets_all(rows, "t", 0.5).collect()}
    assert got == {"t1": 31, "t2": 91, "t1 t2": 91}


def test_minibatch_uses_every_row(spark):
    from pyspark.ml.linalg import Vectors

    from shelfsift.operators import clusters

    rows = spark.createDataFrame([(i, Vectors.dense([float(i % 2) * 10 + i / 1000, 0.0])) for i in range(400)], ["id", "v"])
    centres = clusters.minibatch_kmeans(rows, "id", "v", 2, batches=4, epochs=3, seed=3)
    found = centres.transform(rows).collect()
    assert len({(r["id"] % 2, r["cluster"]) for r in found}) == len({r["cluster"] for r in found})


def test_depth_is_refused_not_cut():
    import pytest

    from shelfsift.operators import learners

    with pytest.raises(ValueError):
        learners._depth(31)


def test_sparse_and_dense_fourier_features_agree(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    from shelfsift.operators import learners

    rows = spark.createDataFrame([(1, Vectors.sparse(300_000, [1, 299_999], [1.0, 2.0])), (2, Vectors.sparse(300_000, [1, 299_999], [1.0, 2.1]))], ["id", "v"])
    got = [r["o"] for r in learners.random_fourier(rows, "v", "o", 0.5, 2048).orderBy("id").select(vector_to_array("o").alias("o")).collect()]
    assert abs(sum(a * b for a, b in zip(*got)) - 2.718281828 ** (-0.5 * 0.01)) < 0.05
    short = spark.createDataFrame([(1, Vectors.dense([0.0, 3.0])), (2, Vectors.sparse(2, [1], [3.0]))], ["id", "v"])
    a, b = [r["o"] for r in learners.random_fourier(short, "v", "o", 0.5, 16).orderBy("id").select(vector_to_array("o").alias("o")).collect()]
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-12


def test_rows_of_the_projection_are_made_once(monkeypatch):
    import numpy as np

    from shelfsift.operators import learners

    made, plain = [], learners._fourier_rows
    monkeypatch.setattr(learners, "_fourier_rows", lambda at, size, seed: made.extend(at.tolist()) or plain(at, size, seed))
    monkeypatch.setattr(learners, "FOURIER_BYTES", 30 * 8 * 16)
    texts = [np.unique(np.arange(i, i + 200, 7) % 45) for i in range(60)]
    rows = learners._FourierRows(16, 1)
    rows.learn(texts)
    assert len(made) == 30
    for t in texts:
        assert (rows.rows(t) == plain(t, 16, 1)).all()
    assert len(made) < 0.5 * sum(map(len, texts))


def test_wanted_text_is_taken_literally(spark):
    from shelfsift.operators import prep

    rows = spark.createDataFrame([("100% wool",), ("100 wool",), ("a_b",), ("axb",), ("c\\d",)], "label string")
    assert [r[0] for r in prep.label_contains(rows, "label", "100%").collect()] == ["100% wool"]
    assert [r[0] for r in prep.label_contains(rows, "label", "A_B").collect()] == ["a_b"]
    assert [r[0] for r in prep.label_contains(rows, "label", "\\").collect()] == ["c\\d"]


@pytest.mark.parametrize("block, pooled", [(1 << 16, 1 << 14), (2, 3)])
def test_pooled_vectors_in_blocks(spark, monkeypatch, block, pooled):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "POOLED", pooled)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [(i % 25 or None, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for i in range(40)] + [(99, ["unknown"]), (98, None)]
    vectors = [(w, [rng.gauss(0, 1), -1.0 - i]) for i, w in enumerate([*words[:8], "w1", "w1"])]  # one word has three
    df = spark.createDataFrame(texts, "id bigint, t array<string>")
    vecs = spark.createDataFrame([*vectors, ("w2", None)], "w string, v array<float>")
    known = {r["w"]: [] for r in vecs.collect()}
    for r in vecs.where("v IS NOT NULL").collect():
        known[r["w"]].append(r["v"])
    met = {}
    for i, t in texts:
        for w in t or []:
            met.setdefault(i, []).extend(known.get(w, []))
    want = {"mean": lambda x: sum(x) / len(x), "max": max}
    for how, by in want.items():
        got = {r["id"]: r["vector"] for r in neighbours.pooled_vector(df, "id", F.col("t"), vecs, "w", "v", how).collect()}
        assert set(got) == {i for i, vs in met.items() if vs}
        for i, v in got.items():
            assert v == pytest.approx([by(x) for x in zip(*met[i])])
