"""Models fitted and applied on the test tables. Model output has no SQL twin."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions import text as tx
from shelfsift.operators import category_models as cm
from shelfsift.operators import clusters as cl
from shelfsift.operators import embeddings as em
from shelfsift.operators import learners as ln
from shelfsift.operators.counts import confusion, scores
from shelfsift.operators.features import class_log_odds, count_features, term_counts
from shelfsift.operators.neighbours import pooled_vector
from shelfsift.operators.prep import assign_fold
from shelfsift.operators.sequences import label_encode
from shelfsift.operators.sparse import sparse_rows
from shelfsift.operators.sparse_neighbours import sparse_nearest
from shelfsift.plans import jobs
from shelfsift.queries import query, table
from shelfsift.queries.fragments import documents, items, long_words, words
from shelfsift.session import scratch_path, stage
from shelfsift.sources.models import load_model, save_model


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: id, text, label (quality)."""
    marks = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return documents(spark, folder, "doc_id", "text").join(marks, "doc_id")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = _judged(spark, folder)
    pipeline = count_features("text", binary=True, stop_words=True)
    return stage(pipeline.fit(rows).transform(rows).select("doc_id", "features", "label"))


def _scored(model, rows: DataFrame) -> DataFrame:
    return ln.score(model, rows, "doc_id", "label")


@query()
def logistic_regression(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_lr(rows, c=1.0, penalty="l2"), rows)


@query()
def logistic_regression_l1(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_lr(rows, c=10.0, penalty="l1"), rows)


@query()
def decision_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_tree(rows, "entropy", 6), rows)


@query()
def random_forest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_forest(rows, trees=10, max_depth=5, max_features=9, min_leaf=2), rows)


@query()
def linear_svm(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_svm(rows), rows)


@query()
def rbf_svm(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(ln.random_fourier(_vectors(spark, folder), "features", "projected", gamma=0.01).select("doc_id", "projected", "label"))
    return _scored(ln.fit_svm(rows, featuresCol="projected"), rows)


@query()
def multinomial_nb(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_nb(rows, 0.1), rows)


@query()
def multinomial_nb_flat_prior(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_nb(rows, 0.1, fit_prior=False), rows)


@query()
def ada_boost(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_ada(rows, rounds=8), rows)


@query()
def neural_net(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _scored(ln.fit_mlp(rows, 2, iters=15), rows)


@query()
def merged_word_and_pair_model(spark: SparkSession, folder: str) -> DataFrame:
    rows = _judged(spark, folder)
    vectors = stage(ln.merged_features("text").fit(rows).transform(rows).select("doc_id", "features", "label"))
    return _scored(ln.fit_lr(vectors), vectors)


@query()
def count_and_tfidf_model(spark: SparkSession, folder: str) -> DataFrame:
    rows = _judged(spark, folder)
    vectors = stage(ln.count_and_tfidf("text").fit(rows).transform(rows).select("doc_id", "features", "label"))
    return _scored(ln.fit_lr(vectors), vectors)


@query()
def multiclass_model(spark: SparkSession, folder: str) -> DataFrame:
    named = items(spark, folder).select("p_partkey", "p_name", "p_type")
    features = count_features("p_name")
    model = ln.train_multiclass(named, "p_type", features, NaiveBayes(smoothing=1.0))
    return ln.predicted_names(model, model.transform(named)).select("p_partkey", "p_type", "predicted_category")


@query()
def multiclass_svm(spark: SparkSession, folder: str) -> DataFrame:
    named = label_encode(items(spark, folder).select("p_partkey", "item", "p_type"), "p_type")
    rows = count_features("item").fit(named).transform(named).withColumn("label", F.col("code").cast("double"))
    kept = stage(rows.select("p_partkey", "p_type", "label", "features"))
    return ln.fit_svm_multiclass(kept, iters=5).transform(kept).select("p_partkey", "p_type", "prediction")


def _annotated(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("item", "p_type").withColumn("type", F.lit("True Positive"))


@query()
def category_models(spark: SparkSession, folder: str) -> DataFrame:
    """One model per part type, all fitted together and saved, with its training recall."""
    path = scratch_path(spark, "models")
    return jobs.train_node_models(_annotated(spark, folder), "p_type", "item", path).drop("path")


@query()
def score_with_model(spark: SparkSession, folder: str) -> DataFrame:
    """The models of all part types read back; all items scored once for all of them, the confident rows appended and reported."""
    path, sink = scratch_path(spark, "models"), scratch_path(spark, "scored")
    jobs.train_node_models(_annotated(spark, folder), "p_type", "item", path)
    return jobs.score_with_models(spark, path, items(spark, folder).select("item"), "item", sink)


@query(
    f"""WITH w AS (SELECT p_partkey, p_type, {words('p_name')} AS w FROM part),
tokens AS (SELECT p_partkey, p_type AS class, unnest(w) AS token FROM w),
cell AS (SELECT class, token, count(*) AS n_wc FROM tokens GROUP BY class, token),
tok AS (SELECT token, sum(n_wc) AS n_w FROM cell GROUP BY token),
cls AS (SELECT class, sum(n_wc) AS n_c FROM cell GROUP BY class),
tot AS (SELECT sum(n_wc) AS n, count(DISTINCT token) AS v FROM cell),
weight AS (SELECT class, token, ln(((n_wc + 1) / (n_c + v)) / ((n_w - n_wc + 1) / (n - n_c + v))) AS w
  FROM cell JOIN tok USING (token) JOIN cls USING (class), tot),
bias AS (SELECT p_type AS category, ln(count(*) / (any_value(rows) - count(*))) AS b FROM part, (SELECT count(*) AS rows FROM part) GROUP BY p_type),
entry AS (SELECT p_partkey, token, count(*) AS x FROM tokens GROUP BY p_partkey, token),
met AS (SELECT p_partkey, class AS category, sum(x * w) AS m FROM entry JOIN weight USING (token) GROUP BY p_partkey, class),
margin AS (SELECT p_partkey, category, b + coalesce(m, 0) AS margin FROM part CROSS JOIN bias LEFT JOIN met USING (p_partkey, category))
SELECT p_partkey, category, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS probability FROM margin"""
)
def all_category_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every item's probability for every part type from given coefficients, here the log odds of its words, in one pass."""
    named = items(spark, folder).select("p_partkey", "p_type", "p_name")
    tokens = tx.tokens_ws("p_name")
    odds = stage(class_log_odds(named, tokens, "p_type").select(F.col("token").alias("place"), F.col("class").alias("code"), F.col("log_odds").alias("w")))
    sizes = named.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    bias = sizes.select(F.lit("").alias("place"), F.col("p_type").alias("code"), F.log(F.col("n") / (sizes.agg(F.sum("n")).scalar() - F.col("n"))).alias("w"))
    weights = cm.packed_weights(odds.unionByName(bias), "place", "code", "w")
    entries = term_counts(named, "p_partkey", tokens).select("p_partkey", F.col("token").alias("place"), F.col("n").cast("double").alias("x"))
    scored = cm.margins(named.select("p_partkey"), entries, "p_partkey", weights, F.lit(""))
    return scored.select("p_partkey", F.col("code").alias("category"), F.round("margin", 6).alias("margin"), F.round(1 / (1 + F.exp(-F.col("margin"))), 6).alias("probability"))


@query()
def every_model_kind_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Each kind of model saved and read back: rows on which it then says something else (none), and rows in all."""
    rows = _vectors(spark, folder)
    kinds = {
        "logistic regression": ln.fit_lr(rows, iters=5), "flat prior": ln.fit_nb(rows, 0.1, fit_prior=False), "boosted stumps": ln.fit_ada(rows, rounds=2),
    }
    parts = []
    for name, model in kinds.items():
        path = scratch_path(spark, "model")
        save_model(model, {"name": name}, path)
        loaded, meta = load_model(spark, path)
        again = _scored(loaded, rows).select("doc_id", F.col("prediction").alias("_p"), F.col("probability").alias("_q"))
        same = (F.col("prediction") == F.col("_p")) & (F.abs(F.col("probability") - F.col("_q")) < 1e-9)
        parts.append(_scored(model, rows).join(again, "doc_id").agg(
            F.lit(meta["name"]).alias("model"), F.count(F.lit(1)).alias("rows"), F.count(F.when(~same, 1)).alias("different")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query()
def hard_example_refit(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    first = ln.Logistic(maxIter=3, regParam=0.5).fit(rows)
    second = ln.refit_on_errors(first, ln.Logistic(maxIter=10, regParam=0.1), rows)
    return _scored(second, rows)


@query()
def epoch_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = assign_fold(_vectors(spark, folder), "doc_id")
    _, history = ln.fit_epochs(
        ln.Logistic(regParam=0.05), rows.where("fold <> 0"), rows.where("fold = 0"), [1, 2, 4, 8])
    return spark.createDataFrame([(i, float(a)) for i, a in history], "iterations int, accuracy double")


@query()
def learner_search(spark: SparkSession, folder: str) -> DataFrame:
    """Randomised search over all learners, judged on folds unseen by the search."""
    rows = _vectors(spark, folder)
    trials = ln.search(rows, ln.default_learners(rows.count()), "doc_id", folds=2, draws=2)
    best = ln.best_trial(trials)
    return spark.createDataFrame(
        [(t.name, str(sorted(t.params.items())), float(t.score), t.name == best.name) for t in trials],
        "learner string, params string, recall double, best boolean")


@query()
def search_of_all_learners(spark: SparkSession, folder: str) -> DataFrame:
    """All seven learners over their whole ranges, on the texts."""
    rows = _vectors(spark, folder)
    trials = ln.search(rows, ln.default_learners(rows.count()), "doc_id", folds=2, nested=False)
    best = ln.best_trial(trials)
    return spark.createDataFrame(
        [(t.name, str(sorted(t.params.items())), float(t.score), t.name == best.name) for t in trials],
        "learner string, params string, recall double, best boolean")


@query()
def range_search(spark: SparkSession, folder: str) -> DataFrame:
    """Best of all seven learners over n-gram ranges."""
    best = ln.search_ranges(_judged(spark, folder), "text", "doc_id", folds=2, nested=False)
    return spark.createDataFrame(
        [(best.name, str(best.params["ngram_range"]), float(best.score))], "learner string, ngram_range string, recall double")


@query(
    f"""WITH entry AS (SELECT p_partkey, token, count(*) AS x FROM (SELECT p_partkey, unnest({long_words('p_name')}) AS token FROM part) GROUP BY p_partkey, token),
size AS (SELECT p_partkey, coalesce(sum(x * x), 0) AS s FROM part LEFT JOIN entry USING (p_partkey) GROUP BY p_partkey),
dot AS (SELECT a.p_partkey AS a, b.p_partkey AS b, sum(a.x * b.x) AS d FROM entry a JOIN entry b USING (token) GROUP BY 1, 2),
pair AS (SELECT a.p_partkey AS test_id, b.p_partkey AS train_id, sqrt(a.s + b.s - 2 * coalesce(d, 0)) AS distance
  FROM size a JOIN size b ON a.p_partkey <> b.p_partkey LEFT JOIN dot ON dot.a = a.p_partkey AND dot.b = b.p_partkey)
SELECT test_id, train_id, round(distance, 9) AS distance,
  CAST(row_number() OVER (PARTITION BY test_id ORDER BY distance, train_id) AS INTEGER) AS rank
FROM pair QUALIFY rank <= 3"""
)
def nearest_names(spark: SparkSession, folder: str) -> DataFrame:
    """Each part's three nearest others by the counts of the words of its name, as sparse vectors."""
    named = items(spark, folder).select(F.col("p_partkey").alias("_no"), "p_name")
    rows = stage(sparse_rows(ln.count_features("p_name").fit(named).transform(named), "features", None, None, "_no"))
    near = sparse_nearest(rows, rows, 3, skip_same=True)
    return near.select("test_id", "train_id", F.round("distance", 9).alias("distance"), "rank")


@query()
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    train, held = documents(spark, folder, "doc_id", "source").randomSplit([0.7, 0.3], seed=1)
    return train.withColumn("side", F.lit("train")).unionByName(held.withColumn("side", F.lit("test")))


@query()
def model_confusion(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return confusion(_scored(ln.fit_nb(rows), rows), "label", "prediction", True)


@query()
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return scores(_scored(ln.fit_nb(rows), rows), "label", "prediction", 1.0)


@query()
def external_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A model's weights applied outside Spark ML, in batches inside the tasks."""
    rows = _vectors(spark, folder)
    fitted = ln.fit_lr(rows, iters=5).stages[0]
    weights, bias = fitted.coefficients.toArray(), float(fitted.intercept)

    def make_predict():
        def predict(places: np.ndarray, values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values * weights[places])])
            return 1.0 / (1.0 + np.exp(-(sums[first[1:]] - sums[first[:-1]] + bias)))
        return predict

    return ln.score_batches(rows, "features", make_predict).select("doc_id", "label", "probability")


# -- clusters and topics ---------------------------------------------------------------------


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query()
def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return cl.kmeans(points, "features", 20).transform(points).select("vec_id", "cluster")


@query()
def minibatch_kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return cl.minibatch_kmeans(points, "vec_id", "features", 10).transform(points).select("vec_id", "cluster")


@query()
def cluster_tree(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return cl.cluster_tree(points, "features", 8, 5).transform(points).select("vec_id", "cluster")


@query()
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return cl.cluster_sizes(cl.kmeans(points, "features", 20).transform(points))


@query()
def cluster_representatives(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    named = cl.kmeans(points, "features", 8).transform(points).select("vec_id", "cluster")
    return cl.cluster_sample(named, "cluster", ["vec_id"], 5)


@query()
def document_topics(spark: SparkSession, folder: str) -> DataFrame:
    model = cl.topics(documents(spark, folder), tx.split_tokens(tx.process_string("text")), 5, 5)
    return cl.topic_words(model, 8)


# -- vectors of words and texts --------------------------------------------------------------


def _word_model(corpus: DataFrame):
    return em.word2vec(corpus, "tokens", size=16, window=3, iters=1)


@query()
def word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    corpus = items(spark, folder).select(tx.tokens_ws("item").alias("tokens"))
    return em.vectors_table(_word_model(corpus))


@query()
def class_word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return em.vectors_table(_word_model(em.class_corpus(items(spark, folder), "p_name", "p_type")))


@query()
def interrelated_word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return em.vectors_table(_word_model(em.interrelation_corpus(items(spark, folder), "item")))


@query()
def text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    corpus = items(spark, folder).select("p_partkey", tx.tokens_ws("item").alias("tokens"))
    return em.doc_vectors(_word_model(corpus), corpus, "p_partkey")


@query()
def word_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    corpus = items(spark, folder).select(tx.tokens_ws("item").alias("tokens"))
    return _word_model(corpus).findSynonyms("ring", 5)


@query()
def cooccurrence_factors(spark: SparkSession, folder: str) -> DataFrame:
    return em.cooc_factors(items(spark, folder), tx.tokens_ws("item"), 5, 8, 3)


@query()
def pooled_vector_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Mean word vectors under a softmax over all part types."""
    named = items(spark, folder).select("p_partkey", "item", "p_type")
    words = em.vectors_table(_word_model(named.select(tx.tokens_ws("item").alias("tokens"))))
    pooled = pooled_vector(named, "p_partkey", tx.tokens_ws("item"), words, "word", "vector")
    rows = named.join(pooled, "p_partkey").select("p_partkey", "p_type", array_to_vector("vector").alias("features"))
    index = ln.StringIndexer(inputCol="p_type", outputCol="label", stringOrderType="alphabetAsc")
    model = ln.Pipeline(stages=[index, LogisticRegression(maxIter=10)]).fit(rows)
    return ln.predicted_names(model, model.transform(rows)).select("p_partkey", "p_type", "predicted_category")
