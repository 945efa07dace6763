"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.llm.rows import numbered, positional, with_slim
from shelfsift.llm.words import n_words
from shelfsift.session import stage

def source_targets(sizes: DataFrame, source: str, weights: Sequence[float], most_epochs: int) -> DataFrame:
    """(source, source_size, source_no, target) from one row per source (``source``, ``source_size``).

    Sources take the weights in turn, by code point, null last. A target never exceeds ``most_epochs``
    times its source; what is cut off goes to the others by weight. With the sources in order of
    cap / weight, the first k are capped and the rest share one level; the right k is the one whose
    level the next source can still hold, so no repeated sharing is needed.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    whole = Window.partitionBy()
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("source_no", F.row_number().over(by_name)).select(
        "*",
        F.element_at(turn, F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1).alias("_w"),
        (F.col("source_size") * most_epochs).alias("_cap"),
    )
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), "source_no")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*",
        ((F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))).alias("_level"),
        (F.col("_cap") / F.col("_w")).alias("_room"),
    )
    level = F.coalesce(
        F.max(F.when(F.col("_level") <= F.col("_room"), F.col("_level"))).over(whole), F.max("_room").over(whole))
    return levels.select(
        source, "source_size", "source_no", F.least(F.col("_cap").cast("double"), level * F.col("_w")).alias("target"))


def mix(
    docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source",
    weights: Sequence[float] = (1, 2, 3), most_epochs: int = 3,
) -> DataFrame:
    """(key, source, size, source_size, target, taken, copies) of every row of ``docs``.

    ``taken`` is the number of words the mix takes from the row, repeats counted: every whole epoch of
    the source's target, then rows in the order of md5(key) until the rest is used up to the word, so
    the rows of a source take floor(target) in all. ``copies`` counts the row's appearances, the last
    one perhaps cut short. Null keys share one place in that order; null sources are one source, last;
    null sizes count as 0; rows of size 0 and sources without words take nothing; equal rows are taken
    each on its own; an empty table gives no rows. Only the three named columns are read.

    One range shuffle sorts slim rows by (source, hash); a source of any size spreads over many
    partitions, and the sums of the sorted runs (at most sources + partitions rows) give each run its
    offset.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("_size"))
    slim = stage(slim.withColumn("_hash", F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("")))))
    sizes = slim.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    targets = stage(source_targets(sizes, "_source", weights, most_epochs)).withColumnRenamed("_source", "_of")

    order = ["source_no", "_hash", "_key", "_size"]
    placed = slim.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    placed = stage(placed.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    runs = placed.groupBy("source_no", "_part").agg(F.sum("_size").alias("_run"))
    earlier = Window.partitionBy("source_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("source_no", "_part", F.coalesce(F.sum("_run").over(earlier), F.lit(0)).alias("_offset"))

    in_run = Window.partitionBy("source_no", "_part").orderBy("_hash", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_in_run", F.coalesce(F.sum("_size").over(in_run), F.lit(0)))
    cut = summed.join(offsets, ["source_no", "_part"]).select(
        "*",
        F.floor("target").alias("_budget"),
        F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).alias("_epochs"),
    )
    rest = F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_offset") - F.col("_in_run")
    more = F.greatest(F.lit(0), F.least(F.col("_size"), rest))
    return cut.select(
        F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_epochs") * F.col("_size") + more).cast("bigint").alias("taken"),
        F.when(F.col("_size") > 0, F.col("_epochs") + F.when(more > 0, 1).otherwise(0)).otherwise(0).cast("int").alias("copies"),
    )


def mixed_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (1, 2, 3), most_epochs: int = 3,
) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them by their words, with all their columns.

    The row in which a source's budget ends is there as a whole; rows not taken are left out. Rows with
    null or repeated keys are numbered first, so each is taken on its own.
    """
    plain, names = positional(docs)
    of = dict(zip(docs.columns, names))
    rows, _ = numbered(plain, of[key], of[text], names)
    taken = stage(mix(rows, n_words(F.col("_text")), "_id", of[source], weights, most_epochs).where("copies > 0").select("_id", "copies"))
    repeated = with_slim(rows, taken, "8", "inner").select(F.explode(F.sequence(F.lit(1), F.col("copies"))), *names)
    return repeated.select(*names).toDF(*docs.columns)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS source_no FROM sources
), weighed AS (
  SELECT *, CAST((source_no - 1) % 3 + 1 AS DOUBLE) AS w, 3 * source_size AS cap FROM numbered
), levels AS (
  SELECT *, cap / w AS room,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
  FROM weighed WINDOW earlier AS (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level <= room THEN level END) OVER (), max(room) OVER ()) * w) AS target
  FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM cut
"""
