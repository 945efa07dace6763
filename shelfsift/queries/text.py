"""Normalisation, tokens, n-grams and encodings over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions import text as tx
from shelfsift.queries import query, table
from shelfsift.queries.fragments import (
    ITEM, TURNS, alnum_words, documents, items, kept_words, line, pairs, processed, raw_words, turns, words,
)


def _joined(c, sep: str = "|"):
    return F.array_join(c, sep)


@query(f"SELECT doc_id, {processed('text')} AS clean FROM documents")
def process_string(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tx.process_string("text").alias("clean"))


@query(f"SELECT doc_id, regexp_replace({processed('text')}, ' +', ' ', 'g') AS clean FROM documents")
def collapse_spaces(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tx.collapse_spaces(tx.process_string("text")).alias("clean"))


@query(f"SELECT turn_id, {line(alnum_words('text'))} AS tokens FROM {TURNS}")
def tokens_replace(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).select("turn_id", _joined(tx.tokens_replace("text")).alias("tokens"))


@query(f"SELECT doc_id, {line(kept_words('text'))} AS tokens FROM documents")
def tokens_delete(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", _joined(tx.tokens_delete("text")).alias("tokens"))


@query(f"SELECT doc_id, {line(words('text'))} AS tokens FROM documents")
def tokens_ws(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", _joined(tx.tokens_ws("text")).alias("tokens"))


@query(
    "WITH spaced AS (SELECT doc_id, lower(regexp_replace(text, '[0-9]+|[[:punct:]]|ï|½|®', ' ', 'g')) AS t FROM documents) "
    "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), "
    "lambda w: w <> '' AND NOT regexp_full_match(w, '\\p{L}{1,2}')), ' ') AS clean FROM spaced"
)
def r_clean(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tx.r_clean("text").alias("clean"))


_SPACED = "rtrim(regexp_replace({}, '(.)', '\\1 ', 'g'))"


@query(f"SELECT turn_id, {_SPACED.format(line(raw_words('text'), ''))} AS chars FROM {TURNS}")
def char_tokens_all(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).select("turn_id", tx.char_tokens("text", "all").alias("chars"))


@query("SELECT turn_id, " + _SPACED.format("regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')") + f" AS chars FROM {TURNS}")
def char_tokens_alnum(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).select("turn_id", tx.char_tokens("text", "alnum").alias("chars"))


@query("SELECT turn_id, " + _SPACED.format("regexp_replace(lower(text), '[^a-z0-9]', '', 'g')") + f" AS chars FROM {TURNS}")
def char_tokens_ascii(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).select("turn_id", tx.char_tokens("text", "ascii").alias("chars"))


@query(
    f"SELECT p_partkey, array_to_string(list_transform({raw_words(ITEM)}, "
    "lambda t: concat_ws(' ', t, t, t, t, t)), ' ') AS cloned FROM part"
)
def clone_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("p_partkey", tx.clone_tokens("item", 5).alias("cloned"))


@query("SELECT p_partkey, replace(p_name, ' ', '') AS dense FROM part")
def strip_spaces(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("p_partkey", tx.strip_spaces("p_name").alias("dense"))


@query("SELECT o_orderkey, CAST(replace(format('{:,}', o_orderkey * 1000), ',', '') AS BIGINT) AS id FROM orders")
def clean_category_id(spark: SparkSession, folder: str) -> DataFrame:
    written = F.format_number(F.col("o_orderkey") * 1000, 0)
    return table(spark, folder, "orders").select("o_orderkey", tx.clean_category_id(written).alias("id"))


@query(
    "SELECT doc_id, CASE WHEN quality = 1 THEN CAST(doc_id AS VARCHAR) ELSE 'not ' || CAST(doc_id AS VARCHAR) END "
    "AS prediction FROM labels"
)
def prediction_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        "doc_id", tx.prediction_label(F.col("quality") == 1, "doc_id").alias("prediction"))


_PATH = "(SELECT p_partkey, p_type || ' > ' || p_brand || ' > ' || p_name AS path FROM part)"


@query(
    "SELECT p_partkey, CAST(len(string_split(path, ' > ')) AS INTEGER) AS depth, string_split(path, ' > ')[1] AS top, "
    f"string_split(path, ' > ')[-1] AS leaf FROM {_PATH}"
)
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws(tx.PATH_SEPARATOR, "p_type", "p_brand", "p_name")
    split = tx.path_parts(path)
    return table(spark, folder, "part").select(
        "p_partkey", F.size(split).alias("depth"), F.element_at(split, 1).alias("top"),
        F.element_at(split, -1).alias("leaf"))


def _substrings(w: str, longest: str) -> str:
    return (
        f"flatten(list_transform(range(1, {longest} + 1), lambda n: "
        f"list_transform(range(1, len({w}) - n + 2), lambda i: substr({w}, i, n))))"
    )


@query(f"SELECT p_partkey, {line(_substrings('w', 'len(w)'))} AS grams FROM (SELECT p_partkey, replace(p_name, ' ', '') AS w FROM part)")
def char_ngrams_all(spark: SparkSession, folder: str) -> DataFrame:
    named = items(spark, folder).select("p_partkey", tx.strip_spaces("p_name").alias("w"))
    return named.select("p_partkey", _joined(tx.char_ngrams_all("w")).alias("grams"))


@query(f"SELECT p_partkey, {line('flatten(list_transform(' + raw_words(ITEM) + ', lambda w: ' + _substrings('w', 'len(w)') + '))')} AS grams FROM part")
def sentence_char_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("p_partkey", _joined(tx.sentence_char_ngrams("item")).alias("grams"))


@query(f"SELECT p_partkey, {line(_substrings('w', '3'))} AS grams FROM (SELECT p_partkey, replace(p_name, ' ', '') AS w FROM part)")
def char_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    named = items(spark, folder).select("p_partkey", tx.strip_spaces("p_name").alias("w"))
    return named.select("p_partkey", _joined(tx.char_ngrams("w", 1, 3)).alias("grams"))


@query(
    f"WITH t AS (SELECT p_partkey, {alnum_words(ITEM)} AS w FROM part) SELECT p_partkey, "
    "array_to_string(flatten(list_transform(range(len(w), 0, -1), lambda n: list_transform(range(1, len(w) - n + 2), "
    "lambda i: array_to_string(w[i:i + n - 1], ' ')))), '|') AS grams FROM t"
)
def word_ngrams_all(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("p_partkey", _joined(tx.word_ngrams_all("item")).alias("grams"))


@query(
    f"WITH t AS (SELECT doc_id, {words('text')} AS w FROM documents) SELECT doc_id, "
    f"array_to_string(list_concat({pairs('w')}, w), '|') AS grams FROM t"
)
def word_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", _joined(tx.word_ngrams("text", 1, 2)).alias("grams"))


@query(
    f"WITH t AS (SELECT doc_id, {raw_words(processed('text'))} AS w FROM documents) "
    f"SELECT doc_id, array_to_string({pairs('w', '_')}, ' ') AS bigrams FROM t"
)
def bigramize(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tx.bigramize(tx.process_string("text")).alias("bigrams"))


_CHAR_CODES = (
    "list_transform(string_split(d, ''), lambda c: strpos('0123456789abcdefghijklmnopqrstuvwxyz', c))"
)


@query(
    f"WITH t AS (SELECT doc_id, array_to_string({words('text')}, '') AS d FROM documents), "
    f"s AS (SELECT doc_id, list_concat(list_transform(range(100), lambda i: 0), CASE WHEN d = '' THEN [] ELSE {_CHAR_CODES} END) AS s FROM t) "
    "SELECT doc_id, array_to_string(s[-100:], ' ') AS codes FROM s"
)
def char_sequence(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.transform(tx.char_sequence("text", 100), lambda i: i.cast("string"))
    return documents(spark, folder).select("doc_id", _joined(codes, " ").alias("codes"))


_BAG = " || ' ' || ".join(
    f"CAST(len(t) - len(replace(t, '{c}', '')) AS VARCHAR)" for c in tx.CHAR_ALPHABET
)


@query(f"SELECT doc_id, {_BAG} AS bag FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def bag_of_chars(spark: SparkSession, folder: str) -> DataFrame:
    bag = F.transform(tx.bag_of_chars("text"), lambda i: i.cast("string"))
    return documents(spark, folder).select("doc_id", _joined(bag, " ").alias("bag"))


@query(
    "SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ' ') AS bits "
    "FROM embeddings"
)
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    bits = F.transform(tx.one_hot(F.col("label") + 1, 10), lambda b: b.cast("int").cast("string"))
    return table(spark, folder, "embeddings").select("vec_id", _joined(bits, " ").alias("bits"))
