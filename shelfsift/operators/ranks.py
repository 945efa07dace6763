"""Positions, samples and first-n picks inside groups of any size.

A plain window sorts a whole group in one task. Here a group may hold most of the table: positions
come from a range shuffle over (group, order), so a large group spreads over many tasks, and first-n
picks run in two levels over salted sub-groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.session import stage

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _columns(items: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def with_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    position: str = "position",
    group_rows: str | None = None,
) -> DataFrame:
    """Add the zero-based position of each row in its group (and, if named, the group's row count).

    ``order`` must end in a unique key. One range shuffle sorts the table by (group, order); each
    sorted partition then holds one run per group, and the runs' sizes (at most groups + partitions
    rows) give the offset every run starts from.
    """
    group, keys = list(group), _columns(list(group) + list(order))
    ranged = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    row_id = F.monotonically_increasing_id()
    placed = ranged.withColumn("_row", row_id).select(
        "*", F.shiftright("_row", ROW_BITS).alias("_part")
    ).withColumn("_row", F.col("_row").bitwiseAND((1 << ROW_BITS) - 1))

    runs = placed.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    )
    same_run = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same_run = same_run & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(offsets, same_run)
    added = [(F.col("_row") + F.col("_shift")).alias(position)]
    if group_rows:
        added.append(F.col("_total").alias(group_rows))
    return joined.select(*df.columns, *added)


def systematic_sample(df: DataFrame, group: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """At most ``k`` rows per group at equal steps through its order.

    A group of at most ``k`` rows is kept whole; otherwise the step is floor(n / k) and positions
    0, step, ..., (k - 1) * step are kept.
    """
    ranked = with_positions(df, [group], order, "_pos", "_rows")
    step = F.floor(F.col("_rows") / k)
    on_step = (F.col("_pos") % step == 0) & (F.floor(F.col("_pos") / step) < k)
    return ranked.where((F.col("_rows") <= k) | on_step).select(*df.columns)


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int,
    spread: Sequence[str] = (), parts: int = 32,
) -> DataFrame:
    """The first ``n`` rows of each group.

    The pick runs inside ``parts`` salted pieces of every group first, so the last step sees at
    most ``n * parts`` rows of a group, whatever its size. ``spread`` names the columns to salt by
    (all columns if empty).
    """
    keys = _columns(order)
    salt = F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(parts))
    inner = Window.partitionBy(*group, "_salt").orderBy(*keys)
    outer = Window.partitionBy(*group).orderBy(*keys)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(outer)).where(F.col("_rank") <= n)
        .select(*df.columns)
    )


def cap_per_class(df: DataFrame, cls: str, n: int, key: str, seed: int | None = None) -> DataFrame:
    """At most ``n`` rows of each class: the first by ``key``, or by a seeded shuffle of ``key``."""
    order = [F.col(key)] if seed is None else [F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    return first_per_group(df, [cls], order, n, [key])


def assign_doc_id(df: DataFrame, order: Sequence[Column | str], start: int = 1, name: str = "item_no") -> DataFrame:
    """Dense running number by ``order``, going on from ``start``."""
    return with_positions(df, [], order, name).withColumn(name, F.col(name) + F.lit(start).cast("bigint"))


def next_doc_id(indexed: DataFrame, name: str = "item_no") -> int:
    """The number after the highest one in use, 1 for an empty table."""
    return indexed.agg(F.coalesce(F.max(name), F.lit(0)) + 1).first()[0]
