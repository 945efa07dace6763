"""Files, models, warehouse options and streams."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from shelfsift.operators import learners
from shelfsift.operators.features import count_features
from shelfsift.session import shared_dir
from shelfsift.sources import files, models, warehouse
from shelfsift.streaming import tables


def test_category_counts_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "counts.csv").write_text('﻿"category_id","count"\n"1,234","5,678"\n"7","80"\n', encoding="utf-8")
    found = files.read_category_counts(spark, str(tmp_path / "counts.csv"))
    assert sorted(map(tuple, found.collect())) == [(7, 80), (1234, 5678)]


def test_header_repair(spark):
    df = spark.createDataFrame([("a", 1)], ['﻿"description"', "category_id"])
    assert files.repair_header(df).columns == ["description", "category_id"]


def test_node_folder(spark, tmp_path):
    (tmp_path / "12-2.csv").write_text(',category_id,description,category_path\n0,12,"bolt, red",Tools\n1,12,nut,Tools\n')
    (tmp_path / "1-332.csv").write_text(",category_id,description,category_path\n0,1,x,\n")
    found = files.read_node_dir(spark, str(tmp_path), exclude=["1-332.csv"])
    assert sorted(map(tuple, found.collect())) == [(12, "bolt, red", "Tools", 12, 2), (12, "nut", "Tools", 12, 2)]


def test_other_encoding_and_limit(spark, tmp_path):
    (tmp_path / "items.csv").write_bytes("id,name\n1,café\n2,thé\n".encode("iso-8859-1"))
    read = files.read_items_csv(spark, str(tmp_path / "items.csv"), "id int, name string", encoding="ISO-8859-1")
    assert sorted(map(tuple, read.collect())) == [(1, "café"), (2, "thé")]
    first = files.read_items_csv(spark, str(tmp_path / "items.csv"), "id int, name string", "ISO-8859-1", limit=1)
    assert first.count() == 1


def test_snapshot_is_read_again(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert files.cache_table(spark.range(3).toDF("id"), path).count() == 3
    assert files.cache_table(spark.range(9).toDF("id"), path).count() == 3
    assert files.cache_table(spark.range(9).toDF("id"), path, refresh=True).count() == 9


def test_nodes_are_sorted_in_their_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{(i * 37) % 100:02d}", "ab"[i % 2]) for i in range(100)], "id int, t string, node string")
    files.write_nodes_partitioned(df, str(tmp_path / "nodes"), "node", ["t", "id"])
    for part in (tmp_path / "nodes").rglob("*.parquet"):
        texts = [r["t"] for r in spark.read.parquet(str(part)).collect()]
        assert texts == sorted(texts)


def test_warehouse_options():
    options = warehouse.read_options("jdbc:postgresql://host/db", "select a from t", "a", (0, 10), 4, {"user": "u"})
    assert options["dbtable"] == "(select a from t) as source_rows" and options["numPartitions"] == "4"
    with pytest.raises(ValueError):
        warehouse.read_options("jdbc:x", "t", "a")


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("red bolt", 1.0), ("blue nut", 0.0), ("red nut", 1.0), ("blue cap", 0.0)], "t string, label double")
    model = learners.Pipeline(stages=[count_features("t", ngram_range=(1, 2)), LogisticRegression(maxIter=10)]).fit(df)
    models.save_model(model, {"score": 1.0, "ngram_range": [1, 2]}, str(tmp_path / "m"))
    loaded, meta = models.load_model(spark, str(tmp_path / "m"))
    assert meta == {"score": 1.0, "ngram_range": [1, 2]}
    assert [r["prediction"] for r in loaded.transform(df).collect()] == [1.0, 0.0, 1.0, 0.0]


def _learnable(spark):
    data = [(i, "red bolt steel" if i % 3 else "blue cap soft", float(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, t string, label double")
    return count_features("t").fit(df).transform(df).select("id", "features", "label")


@pytest.mark.parametrize(
    "fit", [learners.fit_lr, learners.fit_tree, learners.fit_forest, learners.fit_svm, learners.fit_nb,
            lambda t: learners.fit_nb(t, fit_prior=False), lambda t: learners.fit_ada(t, 3), lambda t: learners.fit_mlp(t, 2)])
def test_learners_beat_the_majority(spark, fit):
    rows = _learnable(spark)
    scored = learners.score(fit(rows), rows, "label").collect()
    assert sum(r["prediction"] == r["label"] for r in scored) > 40
    assert all(0 <= r["probability"] <= 1 and (r["probability"] > 0.5) == (r["prediction"] == 1) for r in scored)


def test_best_trial_ties():
    trials = [learners.Trial(n, {}, s, None) for n, s in (("a", 0.8), ("b", 0.8), ("c", 0.1))]
    assert learners.best_trial(trials).name == "a" and learners.best_trial(trials, "newest").name == "b"


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    schema = "id int, t string, c string"
    arriving, sink, progress = (str(tmp_path / n) for n in ("in", "sink", "progress"))
    first = spark.createDataFrame([(1, "a b a", "x"), (2, "b", "y")], schema)
    second = spark.createDataFrame([(3, "a c", "x")], schema)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(arriving)
        stream = tables.read_arriving(spark, arriving, part.schema, files=1)
        tables.stream_token_counts(stream, "t", "c", sink, progress).awaitTermination()
    found = {(r["class"], r["token"]): r["n_wc"] for r in tables.token_counts(spark, sink).collect()}
    assert found == {("x", "a"): 3, ("x", "b"): 1, ("x", "c"): 1, ("y", "b"): 1}


def _arrive(spark, folder, numbers):
    """One small file per number; its texts hold a token of their own and common ones."""
    os.makedirs(folder)
    for i in numbers:
        pq.write_table(pa.table({"t": [f"a t{i} a", "b", None], "c": ["x", "y", "y"]}), f"{folder}/{i}.parquet")


def _counted(spark, sink):
    return {(r["class"], r["token"]): r["n_wc"] for r in tables.token_counts(spark, sink).collect()}


def _expected(n):
    return {("x", "a"): 2 * n, ("y", "b"): n, **{("x", f"t{i}"): 1 for i in range(n)}}


def test_lost_batches_and_progress_count_once_in_few_folders(spark, tmp_path, monkeypatch):
    arriving, sink, progress = (str(tmp_path / n) for n in ("in", "sink", "progress"))
    _arrive(spark, arriving, range(50))
    swap, calls = tables.CountFolders.swap, []

    def crash(self, version, folders):
        calls.append(version)
        if len(calls) in (4, 20):  # the first of them between a merge and its swap
            raise RuntimeError("lost")
        swap(self, version, folders)

    monkeypatch.setattr(tables.CountFolders, "swap", crash)
    for attempt in range(3):
        # The third run has lost its progress, and reads all files again under other batch numbers.
        stream = tables.read_arriving(spark, arriving, spark.read.parquet(arriving).schema, files=2 if attempt < 2 else 7)
        started = tables.stream_token_counts(stream, "t", "c", sink, progress if attempt < 2 else f"{progress}-new", fan=3)
        if attempt < 2:
            with pytest.raises(Exception, match="lost"):
                started.awaitTermination()
        else:
            started.awaitTermination()
    folders = tables.CountFolders(spark, sink)
    assert len(calls) > 20 and len(folders.in_use()) <= 3 * 2
    assert _counted(spark, sink) == _expected(50)
    assert sorted(r["n"] for r in folders.read(folders.in_use(), "files", tables.FILES).groupBy("file").count().toDF("f", "n").collect()) == [1] * 50
    retired = [f for f, n in folders.manifest()[1] if n == tables.RETIRED]
    assert len(retired) in (0, 3)


def test_a_broken_manifest_leaves_the_one_before(spark, tmp_path):
    arriving, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    assert _counted(spark, sink) == {}
    _arrive(spark, arriving, range(3))
    stream = tables.read_arriving(spark, arriving, spark.read.parquet(arriving).schema, files=1)
    tables.stream_token_counts(stream, "t", "c", sink, str(tmp_path / "p")).awaitTermination()
    folders = tables.CountFolders(spark, sink)
    version, listed = folders.manifest()
    # A crash while the next one is written leaves its place without rows.
    spark.createDataFrame([], tables.MANIFEST).write.mode("overwrite").parquet(f"{sink}/manifest-{(version + 1) % 2}")
    assert folders.manifest() == (version, listed) and _counted(spark, sink) == _expected(3)


def test_streamed_scores(spark, tmp_path):
    arriving, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    rows = spark.range(10).withColumn("probability", F.col("id") / 10)
    rows.write.parquet(arriving)
    stream = tables.read_arriving(spark, arriving, rows.schema)
    tables.stream_score(stream, lambda b: b, sink, str(tmp_path / "progress")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [7, 8, 9]


@pytest.mark.parametrize("kind", ["file", "folder", "missing"])
def test_a_table_arrives_as_a_file_or_as_a_folder(spark, tmp_path, kind):
    os.makedirs(tmp_path / "in")
    at = tmp_path / "in" / "rows.parquet"
    if kind == "folder":
        _arrive(spark, str(at), range(3))
    elif kind == "file":
        pq.write_table(pa.table({"t": ["a t0 a", "b", None], "c": ["x", "y", "y"]}), at)
    _arrive(spark, str(tmp_path / "in" / "other.parquet"), range(5))
    n = {"file": 1, "folder": 3, "missing": 0}[kind]
    stream = tables.read_arriving(spark, str(tmp_path / "in"), "t string, c string", "rows.parquet")
    tables.stream_token_counts(stream, "t", "c", str(tmp_path / "counts"), str(tmp_path / "p")).awaitTermination()
    assert _counted(spark, str(tmp_path / "counts")) == (_expected(n) if n else {})
    tables.stream_score(stream.withColumn("probability", F.lit(1.0)), lambda b: b, str(tmp_path / "scored"), str(tmp_path / "q")).awaitTermination()
    assert tables.scored_rows(spark, str(tmp_path / "scored"), "t string, c string, probability double").count() == 3 * n


def test_shared_folder_is_set(spark):
    assert shared_dir(spark) and spark.sparkContext.getCheckpointDir()


def test_models_of_categories_are_saved_and_score(spark, tmp_path):
    from shelfsift.plans import jobs

    rows = [(f"red ring {i}", "rings", "True Positive") for i in range(12)] + [(f"blue bolt {i}", "bolts", "True Positive") for i in range(12)] + [
        ("red ring box", "rings", "False Positive"), ("blue bolt 1", "rings", "True Positive")]
    items = spark.createDataFrame(rows, "item string, node string, type string")
    saved = jobs.train_node_models(items, "node", "item", str(tmp_path / "models"))
    found = {r["category"]: r for r in saved.collect()}
    assert set(found) == {"rings", "bolts"} and found["bolts"]["recall"] == 1.0
    asked = spark.createDataFrame([("red ring 99",), ("blue bolt 77",)], "name string")
    sink = str(tmp_path / "sink")
    for name in ("rings", "bolts"):
        told = jobs.score_with_model(spark, str(tmp_path / "models"), found[name]["path"], asked, "name", sink, cut=0.5)
    got = {(r["description_mod1"], r["predicted_category"]) for r in told.collect()}
    assert got == {("red ring 99", "rings"), ("blue bolt 77", "not rings"), ("red ring 99", "not bolts"), ("blue bolt 77", "bolts")}


def test_labels_of_shared_vectors_equal_positives_negatives(spark):
    from pyspark.sql import functions as F

    from shelfsift.operators import learners, prep

    rows = [("a", 1, "True Positive"), ("a", 2, "True Positive"), ("b", 1, "False Positive"), ("b", 2, "True Positive"), ("c", 2, "False Positive"), ("c", 1, "other")]
    items = spark.createDataFrame(rows, "text string, cat int, type string")
    gathered = items.where(F.col("type") != "other").groupBy("text").agg(
        F.collect_set(F.struct(F.col("cat").alias("category"), (F.col("type") == "True Positive").alias("true"))).alias("_in"))
    for cat in (1, 2, 3):
        want = sorted((r["text"], r["label"]) for r in prep.positives_negatives(items, cat, "cat", "text").collect())
        got = learners.labelled_for(gathered.withColumnRenamed("text", "features"), cat)
        assert sorted((r["features"], r["label"]) for r in got.collect()) == want


def test_csv_with_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, "plain"), (3, "x\n\ny,z")], "id int, text string")
    path = str(tmp_path / "csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    back = files.read_items_csv(spark, path, rows.schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_own_learners_are_estimators(spark):
    rows = _learnable(spark)
    for estimator in (learners.AdaBoost(rounds=2), learners.MultinomialNB(0.5, False), learners.KNearest(3, "distance")):
        model = estimator.fit(rows, {estimator.getParam("featuresCol"): "features"})
        scored = model.transform(rows).collect()
        assert len(scored) == 60 and all(r["prediction"] == r["label"] for r in scored)
