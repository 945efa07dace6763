"""Pieces of SQL and sample columns used by several queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.functions.text import FEATURE_WORD, WHITESPACE, WORD_GAP
from shelfsift.queries import table
from shelfsift.session import spread

# A part described like a shop item: all its attributes in one line of text.
ITEM = "concat_ws(' ', p_brand, p_type, p_name, CAST(p_size AS VARCHAR))"


def item_text() -> Column:
    return F.concat_ws(" ", "p_brand", "p_type", "p_name", F.col("p_size").cast("string"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_type", "p_brand", "p_name", item_text().alias("item"))


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    chosen = table(spark, folder, "documents").select(*(columns or ("doc_id", "text", "source")))
    return spread(chosen) if "text" in chosen.columns else chosen


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with one key."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    return spread(table(spark, folder, "conversations").select(key.alias("turn_id"), "role", "text"))


TURNS = "(SELECT conv_id * 1000 + turn AS turn_id, role, text FROM conversations)"


NOT_KEPT = "[^a-z0-9 ]"


def processed(x: str) -> str:
    return f"regexp_replace(lower({x}), '{NOT_KEPT}', '', 'g')"


def parts(x: str, pattern: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{pattern}'), lambda t: t <> '')"


def words(x: str) -> str:
    """White-space tokens in lower case."""
    return parts(f"lower({x})", WHITESPACE)


def raw_words(x: str) -> str:
    return parts(x, WHITESPACE)


def alnum_words(x: str) -> str:
    return parts(x, WORD_GAP)


def kept_words(x: str) -> str:
    return parts(f"regexp_replace({x}, '{NOT_KEPT}', '', 'g')", " ")


def long_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{FEATURE_WORD}')"


def line(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, '{sep}')"


def pairs(t: str, sep: str = " ") -> str:
    """Adjacent tokens of a list, joined."""
    return f"list_transform(list_zip({t}[:-2], {t}[2:]), lambda p: p[1] || '{sep}' || p[2])"


# Training rows as `prepare_training` makes them, as a chain of common table expressions ending in `prepared`.
CLEANED = f"""
cleaned AS (SELECT doc_id, {processed('text')} AS text, source FROM documents WHERE text IS NOT NULL),
long_enough AS (SELECT * FROM cleaned WHERE len({parts('text', ' ')}) > 1),
once AS (SELECT *, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS copy FROM long_enough),
firsts AS (SELECT doc_id, text, source, count(*) OVER (PARTITION BY text) AS sources FROM once WHERE copy = 1),
agreed AS (SELECT doc_id, text, source FROM firsts WHERE sources = 1)
"""
PREPARED = CLEANED + """,
prepared AS (SELECT doc_id, text, source FROM (
  SELECT *, count(*) OVER (PARTITION BY source) AS class_rows FROM agreed) WHERE class_rows >= 5)
"""
