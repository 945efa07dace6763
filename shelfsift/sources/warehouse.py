"""Warehouse tables over JDBC. Address, user and password come from the caller."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 500


def read_options(
    url: str, table: str, column: str | None = None, bounds: tuple[object, object] | None = None, parts: int = 1,
    props: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; a query in parentheses or starting with select is wrapped as a subquery."""
    source = table.strip()
    if source.lower().startswith("select"):
        source = f"({source}) as source_rows"
    options = {**(props or {}), "url": url, "dbtable": source}
    if column is not None:
        if bounds is None:
            raise ValueError("a split column needs its bounds")
        options |= {
            "partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
            "numPartitions": str(parts),
        }
    return options


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str | None = None,
    bounds: tuple[object, object] | None = None, parts: int = 1, props: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table or query, read in ``parts`` parallel ranges of ``column``; filters are pushed down."""
    return spark.read.format("jdbc").options(**read_options(url, table, column, bounds, parts, props)).load()


def write_jdbc(
    df: DataFrame, url: str, table: str, mode: str = "append", batchsize: int = BATCH_ROWS,
    props: Mapping[str, str] | None = None,
) -> None:
    """Insert rows in batches, one connection per partition; values are bound, not quoted."""
    df.write.format("jdbc").options(**(props or {}), url=url, dbtable=table, batchsize=str(batchsize)).mode(mode).save()
