"""The queries of the ten operators, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm import (
    bpe, chat, decontamination, licenses, mixing, neighbours, passages, quality, ranking, simhash, spelling, suffixes, templates,
)
from shelfsift.llm.words import n_words
from shelfsift.queries import Query, table
from shelfsift.session import stage

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query, sql: str | None = None) -> Query:
    QUERIES[fn.__name__] = fn
    if sql is not None:
        SQL[fn.__name__] = sql
    return fn


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def token_digests(docs: DataFrame, path: str = VOCABULARY, *more: str) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them; ``more``: ids, decoded."""
    return bpe.round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole document encoded and decoded again, as digests."""
    return token_digests(table(spark, folder, "documents"))


query(op1_bpe_round_trip)


def op2_license_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the license sentences they hold and the licenses read from them."""
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("sentences", " ").alias("sentences"), F.array_join("licenses", " ").alias("licenses"))


query(op2_license_sentences, licenses.scan_sql())


FACTOR = 4.0  # recall 0.996 to 0.999 on the test tables, see tests/llm/test_neighbours.py


def op3_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all vectors."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=FACTOR)


query(op3_nearest_vectors)


def op4_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their fingerprint over 3-word shingles and their component at 2 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=2).withColumn(
        "fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


query(op4_simhash_near_duplicates)


def op5_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents judged by rules weighed without labels."""
    return quality.quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


query(op5_quality_votes, quality.QUALITY_SQL)


def op6_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn as a call for a reply, the assistant turn after it as the result."""
    turns = table(spark, folder, "conversations")
    call_id = F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", call_id.alias("call_id"), F.lit("reply").alias("tool"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return chat.link_calls(calls, results, chat.REPLY).select("conv_id", "call_id", "turn", "level", "status", "json")


query(op6_tool_calls, chat.LINK_SQL)


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op7_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """All pages by rules and by the labelled purity of their path template; labels of the same number stand for the page's."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("good"))
    found = templates.judge(table(spark, folder, "pages"), labels, URL_RULES, label_key="doc_id")
    return found.select("page_id", "host", "path", "rule", "template", F.round("purity", 9).alias("purity"), "verdict")


query(op7_url_templates)


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source, weights 1, 2, 3 in turn, at most three epochs."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, n_words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


query(op8_mix_sources, mixing.MIX_SQL)


def op9_remove_passages(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the passages of 50 and more words that an earlier document holds."""
    found = passages.remove_passages(table(spark, folder, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


query(op9_remove_passages)


def op10_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that begin earlier in the corpus."""
    found = suffixes.remove_repeats(table(spark, folder, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


query(op10_remove_repeats)


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the number of words inside windows of benchmark items, and those items."""
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10, shingle=5)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


query(op11_decontaminate, decontamination.CONTAMINATION_SQL)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """All words of the documents with the more frequent word one edit away, and where such steps end."""
    words = stage(spelling.word_counts(table(spark, folder, "documents")))
    return spelling.with_roots(stage(spelling.variants(words))).select("word", "form", "root", "n", "n_near", "form_n")


query(op12_spelling_variants)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return ranking.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


query(op13_ranked_search, ranking.RANKED_SQL)
