"""Word indexes, id sequences, training pairs and label codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions import text as tx
from shelfsift.operators import sequences as sq
from shelfsift.queries import query, table
from shelfsift.queries.fragments import ITEM, TURNS, documents, items, pairs, processed, raw_words, turns, words

SEEN = f"""
seen AS (SELECT doc_id, unnest({words('text')}) AS token, generate_subscripts({words('text')}, 1) AS spot FROM documents),
found AS (SELECT token, count(*) AS n, min(doc_id * 1000000 + spot) AS first FROM seen GROUP BY token)
"""
BY_FREQ = "SELECT token, row_number() OVER (ORDER BY n DESC, first) AS idx, n FROM found"


@query(f"WITH {SEEN} SELECT token, row_number() OVER (ORDER BY first) AS idx, n FROM found")
def word_index_first(spark: SparkSession, folder: str) -> DataFrame:
    return sq.word_index(documents(spark, folder), "text", "first", ["doc_id"])


@query(f"WITH {SEEN} {BY_FREQ}")
def word_index_freq(spark: SparkSession, folder: str) -> DataFrame:
    return sq.word_index(documents(spark, folder), "text", "freq", ["doc_id"])


def _turn_sequences(spark: SparkSession, folder: str, oov: str) -> DataFrame:
    """Conversation turns numbered with the words of the documents, some of which are unknown there."""
    index = sq.word_index(documents(spark, folder), "text", "freq", ["doc_id"])
    return sq.to_sequence(turns(spark, folder), "turn_id", "text", index, oov)


def _numbers(c, sep: str = " "):
    return F.array_join(F.transform(c, lambda i: i.cast("string")), sep)


_TURN_WORDS = f"""
WITH {SEEN}, idx AS ({BY_FREQ}),
tok AS (SELECT turn_id, unnest({words('text')}) AS token, generate_subscripts({words('text')}, 1) AS spot FROM {TURNS}),
"""
_DROP = _TURN_WORDS + """
seqs AS (SELECT turn_id, array_agg(idx ORDER BY spot) AS s FROM tok JOIN idx USING (token) GROUP BY turn_id),
every AS (SELECT t.turn_id, coalesce(s, []) AS s FROM """ + TURNS + """ t LEFT JOIN seqs ON t.turn_id = seqs.turn_id)
"""


@query(_DROP + "SELECT turn_id, array_to_string(s, ' ') AS sequence FROM every")
def to_sequence_drop(spark: SparkSession, folder: str) -> DataFrame:
    return _turn_sequences(spark, folder, "drop").withColumn("sequence", _numbers("sequence"))


@query(
    _TURN_WORDS + "seqs AS (SELECT turn_id, array_agg(coalesce(idx, 0) ORDER BY spot) AS s FROM tok LEFT JOIN idx USING (token) "
    f"GROUP BY turn_id) SELECT t.turn_id, array_to_string(coalesce(s, []), ' ') AS sequence FROM {TURNS} t "
    "LEFT JOIN seqs ON t.turn_id = seqs.turn_id"
)
def to_sequence_zero(spark: SparkSession, folder: str) -> DataFrame:
    return _turn_sequences(spark, folder, "zero").withColumn("sequence", _numbers("sequence"))


@query(
    _DROP + "SELECT turn_id, array_to_string(list_concat(list_transform(range(30), lambda i: 0), s)[-30:], ' ') AS padded FROM every"
)
def pad_left(spark: SparkSession, folder: str) -> DataFrame:
    return _turn_sequences(spark, folder, "drop").select(
        "turn_id", _numbers(tx.pad_left("sequence", 30)).alias("padded"))


@query(
    _DROP + """, g AS (SELECT turn_id, list_transform(list_zip(s[:-2], s[2:])[1:29], lambda p: p[1] || ' ' || p[2]) AS g FROM every)
    SELECT turn_id, array_to_string(list_concat(g, list_transform(range(29 - len(g)), lambda i: '0 0')), '|') AS matrix FROM g"""
)
def nested_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    matrix = F.transform(tx.nested_ngrams("sequence", 2, 29), lambda r: _numbers(r))
    return _turn_sequences(spark, folder, "drop").select("turn_id", F.array_join(matrix, "|").alias("matrix"))


@query(
    f"WITH t AS (SELECT p_partkey, unnest({raw_words(ITEM)}) AS w, generate_subscripts({raw_words(ITEM)}, 1) AS i FROM part) "
    "SELECT a.p_partkey, a.w AS first, b.w AS second FROM t a JOIN t b ON a.p_partkey = b.p_partkey AND a.i < b.i"
)
def token_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return sq.token_pairs(items(spark, folder), "p_partkey", tx.split_tokens("item"))


_CLEAN_WORDS = f"(SELECT {raw_words(processed('text'))} AS w, source FROM documents)"


@query(f"SELECT unnest(w) AS token, source AS class FROM {_CLEAN_WORDS}")
def class_unigram_pairs(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = documents(spark, folder).withColumn("text", tx.process_string("text"))
    return sq.class_pairs(cleaned, "text", "source")


@query(f"SELECT unnest({pairs('w', '_')}) AS token, source AS class FROM {_CLEAN_WORDS}")
def class_bigram_pairs(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = documents(spark, folder).withColumn("text", tx.process_string("text"))
    return sq.class_pairs(cleaned, "text", "source", 2)


@query(f"SELECT array_to_string(list_append({raw_words(ITEM)}, p_type), ' ') AS tokens FROM part")
def class_appended(spark: SparkSession, folder: str) -> DataFrame:
    return sq.class_appended(items(spark, folder), "item", "p_type").select(F.array_join("tokens", " ").alias("tokens"))


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents")
def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    return sq.label_encode(documents(spark, folder, "doc_id", "source"), "source").select("doc_id", "source", "code")


@query("SELECT doc_id, source AS label FROM documents")
def label_decode(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "source")
    codes = sq.label_codes(docs, "source")
    coded = sq.label_encode(docs, "source", codes).select("doc_id", "code")
    return sq.label_decode(coded, "code", codes, "source", "label").select("doc_id", "label")


@query(
    f"WITH {SEEN}, ranked AS ({BY_FREQ}) SELECT token, idx, n, list_transform(range(1, 33), lambda d: "
    "CAST(CAST('0x' || substr(md5('12345/' || d || '/' || token), 1, 10) AS BIGINT) AS DOUBLE) / 1099511627776 - 0.5) AS vector FROM ranked"
)
def random_vectors(spark: SparkSession, folder: str) -> DataFrame:
    index = sq.word_index(documents(spark, folder), "text", "freq", ["doc_id"])
    return sq.random_vectors(index, "token", 32, 12345)
