"""From raw documents to token ids: filter, thin out, cut repeats, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the documents of the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm import mixing, quality, simhash, suffixes
from shelfsift.llm.queries import VOCABULARY, token_digests
from shelfsift.session import configure, scratch_path, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_ready
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the weighed votes of the quality rules."""
    return quality.keep_good(docs)


@_ready
def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates."""
    return simhash.keep_first(docs, shingle=3, radius=2)


@_ready
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that come earlier."""
    return suffixes.without_repeats(docs, length=100).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_ready
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed at weights 1, 2, 3 in turn, at most three epochs; documents appear as often as they are taken."""
    return mixing.mixed_rows(docs)


@_ready
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the text decoded from them."""
    return token_digests(docs, VOCABULARY, "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_first_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("bpe_encoding", encode),
]

#: Iterated links between fingerprints and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
