"""Streaming jobs run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.operators import bayes
from shelfsift.queries import query, table
from shelfsift.queries.fragments import documents, words
from shelfsift.queries.naive_bayes import _DOCS, _scored
from shelfsift.session import scratch_path
from shelfsift.streaming import tables


@query(
    f"SELECT class, token, CAST(count(*) AS BIGINT) AS n_wc FROM (SELECT source AS class, unnest({words('text')}) AS token FROM documents) GROUP BY class, token"
)
def stream_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "documents").schema
    stream = tables.read_arriving(spark, folder, schema, "documents.parquet")
    sink = scratch_path(spark, "tokens")
    tables.stream_token_counts(stream, "text", "source", sink, scratch_path(spark, "tokens-progress")).awaitTermination()
    return tables.token_counts(spark, sink)


_TALK = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


@query(
    _scored(_DOCS, _TALK) + "SELECT id AS turn_id, predicted_category, round(probability, 6) AS probability FROM every WHERE probability >= 0.7"
)
def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    scorer = bayes.scorer(bayes.nb_index(documents(spark, folder), "doc_id", "text", "source"))
    schema = table(spark, folder, "conversations").schema
    stream = tables.read_arriving(spark, folder, schema, "conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    sink = scratch_path(spark, "scored")
    tables.stream_score(
        stream, lambda batch: scorer.predict(batch, "turn_id", "text"), sink, scratch_path(spark, "scored-progress")
    ).awaitTermination()
    scored = tables.scored_rows(spark, sink, "turn_id bigint, predicted_category string, probability double")
    return scored.select("turn_id", "predicted_category", F.round("probability", 6).alias("probability"))
