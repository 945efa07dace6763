"""Row numbers for operators that say which of two texts comes first, and joins with slim results."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.operators.ranks import with_positions
from shelfsift.session import stage

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MOST_BROADCAST_BYTES = 48 << 20


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return what this process has freed to the system: a Python worker lives on and would keep it while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # another C library


def thrifty(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` on the batches of a task, that gives its memory back at the end of it."""
    @wraps(work)
    def run(source: Batches) -> Batches:
        try:
            yield from work(source)
        finally:
            give_back()

    return run


def positional(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns _c0, _c1, ..., whatever they were called, and these names."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def numbered(docs: DataFrame, key: str, text: str, rest: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """(_id long, _key, _text, and the columns of ``rest``) in the order of the keys, and the bytes of all texts.

    Whole-number keys without nulls and repeats are the numbers themselves. Other rows are numbered by
    key - nulls last - and then by a hash of the text, so rows with the same key follow one another.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *rest)
    found = slim.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("_key").alias("keys"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    if isinstance(docs.schema[key].dataType, WHOLE) and found["rows"] == found["keys"]:
        return slim.withColumn("_id", F.col("_key").cast("bigint")), found["bytes"]
    order = [F.col("_key").asc_nulls_last(), F.xxhash64("_text"), F.col("_text")]
    return with_positions(slim, [], order, "_id").withColumn("_id", F.col("_id").cast("bigint")), found["bytes"]


def with_slim(rows: DataFrame, slim: DataFrame, size: str, how: str) -> DataFrame:
    """``rows`` joined by ``_id`` with a staged table of at most one small row per id.

    ``size`` is SQL for the bytes of one slim row; the table is broadcast if their sum has been found
    small enough, else both sides are shuffled.
    """
    total = slim.agg(F.coalesce(F.sum(F.expr(f"32 + {size}")), F.lit(0))).first()[0]
    return rows.join(F.broadcast(slim) if total <= MOST_BROADCAST_BYTES else slim, "_id", how)


def release(staged: DataFrame) -> DataFrame:
    """Tell the driver's cleaner that the shuffles behind a staged table are done with.

    Shuffle files go when the driver's JVM collects its garbage, which it may not do for half an hour.
    """
    staged.sparkSession.sparkContext._jvm.System.gc()
    return staged


def settled(df: DataFrame) -> DataFrame:
    return release(stage(df))
