"""Token statistics: counts, TF-IDF, co-occurrence, class log odds, phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions import text as tx
from shelfsift.operators import bayes
from shelfsift.operators import features as ft
from shelfsift.queries import query
from shelfsift.queries.fragments import TURNS, documents, items, long_words, pairs, turns, words

_LONG = f"SELECT doc_id, unnest({long_words('text')}) AS token FROM documents"
_TOKENS = f"SELECT doc_id, source, unnest({words('text')}) AS token FROM documents"


@query(f"SELECT doc_id, token, count(*) AS n FROM ({_LONG}) GROUP BY doc_id, token")
def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ft.term_counts(documents(spark, folder), "doc_id", tx.feature_words("text"))


@query(
    f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, {pairs('w')})) AS token FROM "
    f"(SELECT doc_id, {long_words('text')} AS w FROM documents)) GROUP BY doc_id, token"
)
def term_counts_with_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    grams = tx.token_ngrams(tx.feature_words("text"), 1, 2)
    return ft.term_counts(documents(spark, folder), "doc_id", grams)


@query(f"SELECT token, count(DISTINCT doc_id) AS df FROM ({_LONG}) GROUP BY token")
def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return ft.document_frequency(documents(spark, folder), tx.feature_words("text"))


@query(
    f"""WITH tf AS (SELECT doc_id, token, count(*) AS n FROM ({_LONG}) GROUP BY doc_id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
w AS (SELECT doc_id, token, (1 + ln(n)) * (ln((1 + (SELECT count(text) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token))
SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""
)
def tfidf_sublinear(spark: SparkSession, folder: str) -> DataFrame:
    return ft.tfidf_sublinear(documents(spark, folder), "doc_id", "text").withColumn("weight", F.round("weight", 6))


_SPOTS = f"""WITH s AS (SELECT turn_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM
  (SELECT turn_id, {words('text')} AS w FROM {TURNS}))"""


@query(
    _SPOTS + " SELECT least(a.t, b.t) AS first, greatest(a.t, b.t) AS second, round(sum(1.0 / (b.i - a.i)), 6) AS weight, "
    "count(*) AS pairs FROM s a JOIN s b ON a.turn_id = b.turn_id AND b.i - a.i BETWEEN 1 AND 4 GROUP BY 1, 2"
)
def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    pairs_ = ft.cooccurrence(turns(spark, folder), tx.tokens_ws("text"), 4)
    return pairs_.withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH cell AS (SELECT source AS class, token, count(*) AS n_wc FROM ({_TOKENS}) GROUP BY source, token),
tok AS (SELECT token, sum(n_wc) AS n_w FROM cell GROUP BY token), cls AS (SELECT class, sum(n_wc) AS n_c FROM cell GROUP BY class),
tot AS (SELECT sum(n_wc) AS n, count(DISTINCT token) AS v FROM cell)
SELECT class, token, n_wc, round(ln(((n_wc + 1) / (n_c + v)) / ((n_w - n_wc + 1) / (n - n_c + v))), 6) AS log_odds
FROM cell JOIN tok USING (token) JOIN cls USING (class), tot"""
)
def class_log_odds(spark: SparkSession, folder: str) -> DataFrame:
    odds = ft.class_log_odds(documents(spark, folder), tx.tokens_ws("text"), "source")
    return odds.withColumn("log_odds", F.round("log_odds", 6))


@query(
    f"""WITH w AS (SELECT {words('text')} AS w FROM documents),
one AS (SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM w) GROUP BY token),
two AS (SELECT p[1] AS first, p[2] AS second, count(*) AS n_ab FROM (SELECT unnest(list_zip(w[:-2], w[2:])) AS p FROM w) GROUP BY 1, 2)
SELECT first, second, n_ab, round(score, 6) AS score FROM (SELECT first, second, n_ab,
  (n_ab - 5) / (a.n * b.n) * (SELECT count(*) FROM one) AS score
  FROM two JOIN one a ON first = a.token JOIN one b ON second = b.token WHERE n_ab > 5) WHERE score > 2"""
)
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    found = ft.phrases(documents(spark, folder), tx.tokens_ws("text"), 5, 2.0)
    return found.withColumn("score", F.round("score", 6))


@query()
def hash_subwords(spark: SparkSession, folder: str) -> DataFrame:
    return ft.hash_subwords(items(spark, folder), "item", 3, 5, 4096).select("p_partkey", "subwords")


@query()
def count_features(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    pipeline = ft.count_features("text", ngram_range=(1, 2), binary=True, stop_words=True)
    return pipeline.fit(docs).transform(docs).select("doc_id", "features")


# -- the token index -------------------------------------------------------------------------


def _index(spark: SparkSession, folder: str) -> bayes.TokenIndex:
    return bayes.nb_index(documents(spark, folder), "doc_id", "text", "source")


@query(f"SELECT source AS class, token, count(*) AS n_wc FROM ({_TOKENS}) GROUP BY source, token")
def index_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).counts


@query(
    f"SELECT source AS class, count(*) AS n_c, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_id, max(doc_id) AS last_id "
    f"FROM ({_TOKENS}) GROUP BY source"
)
def index_classes(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).classes


@query(
    f"SELECT source AS class, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({_TOKENS}) GROUP BY source UNION ALL "
    f"SELECT '*', min(doc_id), max(doc_id) FROM ({_TOKENS})"
)
def index_id_range(spark: SparkSession, folder: str) -> DataFrame:
    return bayes.id_range(_index(spark, folder))


@query(f"SELECT count(DISTINCT token) AS V FROM ({_TOKENS})")
def vocabulary_size(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).vocabulary_size()


@query()
def approximate_vocabulary_size(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).approximate_vocabulary_size()


@query(
    f"SELECT token, source AS class, count(*) AS n_wc FROM ({_TOKENS}) WHERE source = 'src3' GROUP BY ALL ORDER BY n_wc DESC, token LIMIT 50"
)
def top_class_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return bayes.top_tokens(_index(spark, folder), "src3", 50)


@query(
    f"WITH c AS (SELECT source, count(DISTINCT doc_id) AS d FROM ({_TOKENS}) GROUP BY source) "
    "SELECT source AS class, round(d / (SELECT sum(d) FROM c), 6) AS prior FROM c"
)
def class_prior_count(spark: SparkSession, folder: str) -> DataFrame:
    return bayes.class_prior(_index(spark, folder)).select("class", F.round("prior", 6).alias("prior"))


@query(
    f"WITH c AS (SELECT source, min(doc_id) AS a, max(doc_id) AS b FROM ({_TOKENS}) GROUP BY source) "
    "SELECT source AS class, round((b - a + 1) / (SELECT max(b) - min(a) + 1 FROM c), 6) AS prior FROM c"
)
def class_prior_span(spark: SparkSession, folder: str) -> DataFrame:
    return bayes.class_prior(_index(spark, folder), "span").select("class", F.round("prior", 6).alias("prior"))
