"""Item tables in CSV, TSV, text and Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.functions.text import clean_category_id

# The layouts item files come in.
NODE_FILE_SCHEMA = "row_no bigint, category_id bigint, description string, category_path string"
COUNTS_SCHEMA = "category_id string, count string"
NODE_FILE_NAME = r"([0-9]+)-([0-9]+)\.csv$"
BYTE_ORDER_MARK = "\ufeff"


def _schema(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def read_items_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, encoding: str = "UTF-8",
    sep: str = ",", header: bool = True, limit: int | None = None, multi_line: bool = False,
) -> DataFrame:
    """CSV items with an explicit schema, no inference.

    Columns go by position, so a byte order mark in front of the first header does no harm.
    ``limit`` is for a first look at a file. With ``multi_line`` quoted values may hold line breaks; a
    file is then read by one task, so large tables should come as many files.
    """
    df = (
        spark.read.schema(_schema(schema))
        .option("header", header).option("enforceSchema", True).option("encoding", encoding).option("sep", sep)
        .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
        .csv(path)
    )
    return df if limit is None else df.limit(limit)


def repair_header(df: DataFrame) -> DataFrame:
    """Take byte order marks and stray quotes out of column names read from a header."""
    return df.toDF(*[c.replace(BYTE_ORDER_MARK, "").strip('"') for c in df.columns])


def read_category_counts(spark: SparkSession, path: str) -> DataFrame:
    """Node sizes; both columns may carry thousands separators."""
    raw = read_items_csv(spark, path, COUNTS_SCHEMA)
    return raw.select(clean_category_id("category_id").alias("category_id"), clean_category_id("count").alias("count"))


def read_node_dir(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """All per-node CSV files ``<id>-<rows>.csv`` of a folder as one table, some file names left out.

    The file name's id and row count come along as file_category_id and file_rows.
    """
    rows = read_items_csv(spark, f"{path.rstrip('/')}/*.csv", NODE_FILE_SCHEMA)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    named = rows.withColumn("_file", file)
    if exclude:
        named = named.where(~F.col("_file").isin(*exclude))
    return named.select(
        "category_id", "description", "category_path",
        F.regexp_extract("_file", NODE_FILE_NAME, 1).cast("bigint").alias("file_category_id"),
        F.regexp_extract("_file", NODE_FILE_NAME, 2).cast("bigint").alias("file_rows"),
    )


def write_node_file(df: DataFrame, path: str) -> None:
    """One node's rows as a single CSV file of that name; a node file is small, as the layout asks for."""
    spark = df.sparkSession
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{path}.parts")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = fs_path(f"{path}.parts")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    fs.rename(part, fs_path(path))
    fs.delete(folder, True)


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = False) -> DataFrame:
    """Tab-separated text in which quotes mean nothing."""
    return (
        spark.read.schema(_schema(schema)).option("sep", "\t").option("quote", "").option("header", header).csv(path)
    )


def cache_table(df: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """A Parquet snapshot of ``df``: written the first time, read back ever after."""
    spark = df.sparkSession
    if refresh or not path_exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_nodes_partitioned(df: DataFrame, path: str, node: str, order: Sequence[str], format: str = "parquet") -> None:
    """One folder per node, rows in order inside each file.

    The range shuffle over (node, order) lets a large node fill several files, whose names follow
    the order, and gathers small nodes.
    """
    keys = [node, *order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(node).format(format).save(path)


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append (description, predicted category, probability) rows to a Parquet table."""
    df.write.mode(mode).parquet(path)


def label_lines(df: DataFrame, label: str, text: str) -> DataFrame:
    """Training lines ``__label__<id> ,<text>``."""
    return df.select(F.concat(F.lit("__label__"), F.col(label).cast("string"), F.lit(" ,"), F.col(text)).alias("value"))


def write_label_text(df: DataFrame, label: str, text: str, path: str) -> None:
    label_lines(df, label, text).write.mode("overwrite").text(path)


def write_matrix_coo(df: DataFrame, path: str, i: str = "id_a", j: str = "id_b", value: str = "value") -> None:
    """A sparse matrix as (i, j, value) rows."""
    df.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(value).cast("double").alias("value")).write.mode(
        "overwrite").parquet(path)


def write_truth_and_predictions(df: DataFrame, path: str, columns: Sequence[str], format: str = "csv") -> None:
    """Truth and predictions side by side."""
    writer = df.select(*columns).write.mode("overwrite")
    (writer.option("header", True).option("escape", '"').csv(path) if format == "csv" else writer.parquet(path))
