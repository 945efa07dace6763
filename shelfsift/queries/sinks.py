"""Writers checked by reading back what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.operators.neighbours import vector_pairs
from shelfsift.queries import query, table
from shelfsift.queries.fragments import documents
from shelfsift.session import scratch_path
from shelfsift.sources import files


@query("SELECT '__label__' || p_type || ' ,' || p_name AS value FROM part")
def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    files.write_label_text(table(spark, folder, "part"), "p_type", "p_name", path)
    return spark.read.text(path)


@query("SELECT doc_id, text, source FROM documents")
def nodes_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "nodes")
    files.write_nodes_partitioned(documents(spark, folder), path, "source", ["text", "doc_id"])
    return spark.read.schema("doc_id bigint, text string, source string").parquet(path)


@query("SELECT p_partkey AS category_id, p_name AS description, p_type || ' > ' || p_brand AS category_path FROM part")
def items_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "items")
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("category_id"), F.col("p_name").alias("description"),
        F.concat_ws(" > ", "p_type", "p_brand").alias("category_path"))
    rows.write.option("header", True).csv(path)
    return files.read_items_csv(spark, path, rows.schema)


@query("SELECT doc_id, text, source FROM documents")
def documents_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with line breaks and quotes, written as CSV and read back."""
    path = scratch_path(spark, "documents")
    rows = documents(spark, folder)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_items_csv(spark, path, rows.schema, multi_line=True)


@query("SELECT p_partkey AS category_id, p_name || ' éü' AS description FROM part")
def items_csv_latin(spark: SparkSession, folder: str) -> DataFrame:
    """Another encoding and separator, headers with a byte order mark and quotes repaired."""
    path = scratch_path(spark, "latin")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("category_id"), F.concat("p_name", F.lit(" éü")).alias("description"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").option("sep", ";").csv(path)
    read = files.read_items_csv(spark, path, rows.schema, encoding="ISO-8859-1", sep=";")
    return files.repair_header(read.toDF('\ufeff"category_id"', '"description"'))


@query(
    "SELECT CAST(n_regionkey AS BIGINT) AS category_id, n_name AS description, 'All > ' || n_regionkey AS category_path, CAST(n_regionkey AS BIGINT) AS file_category_id, "
    "count(*) OVER (PARTITION BY n_regionkey) AS file_rows FROM nation WHERE n_regionkey <> 3"
)
def node_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per node, named by id and row count, read as one table but for one file."""
    path, sizes = scratch_path(spark, "node-files"), {}
    nodes = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("row_no"), F.col("n_regionkey").cast("bigint").alias("category_id"), F.col("n_name").alias("description"),
        F.concat(F.lit("All > "), F.col("n_regionkey")).alias("category_path"))
    for r in nodes.groupBy("category_id").count().collect():
        sizes[r["category_id"]] = f"{r['category_id']}-{r['count']}.csv"
        files.write_node_file(nodes.where(F.col("category_id") == r["category_id"]), f"{path}/{sizes[r['category_id']]}")
    return files.read_node_dir(spark, path, [sizes[3]])


@query("SELECT p_partkey AS category_id, p_size * 1000 AS count FROM part")
def category_counts_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "counts")
    table(spark, folder, "part").select(
        F.format_number("p_partkey", 0).alias("category_id"), F.format_number(F.col("p_size") * 1000, 0).alias("count")
    ).write.option("header", True).csv(path)
    return files.read_category_counts(spark, path).withColumn("count", F.col("count").cast("int"))


@query("SELECT p_name || ' \"x' AS review, p_size AS label FROM part")
def reviews_tsv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "reviews")
    table(spark, folder, "part").select(F.concat_ws("\t", F.concat("p_name", F.lit(' "x')), F.col("p_size").cast("string"))).write.text(path)
    return files.read_tsv(spark, path, "review string, label int")


@query("SELECT doc_id, source, n_chars FROM documents")
def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    rows = documents(spark, folder, "doc_id", "source", "n_chars")
    files.cache_table(rows, path)
    return files.cache_table(rows, path)


@query(
    "SELECT p_name AS description_mod1, p_type AS predicted_category, p_retailprice / 1000 AS probability FROM part WHERE p_retailprice / 1000 >= 0.91"
)
def prediction_table(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions appended category by category."""
    path = scratch_path(spark, "predictions")
    rows = table(spark, folder, "part").select(
        F.col("p_name").alias("description_mod1"), F.col("p_type").alias("predicted_category"),
        (F.col("p_retailprice") / 1000).alias("probability")).where("probability >= 0.91")
    files.write_predictions(rows.where("predicted_category < 'M'"), path)
    files.write_predictions(rows.where("predicted_category >= 'M'"), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT doc_id, CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS pred FROM labels")
def truth_and_predictions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "truth")
    rows = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("pred"))
    files.write_truth_and_predictions(rows, path, ["doc_id", "truth", "pred"])
    return files.read_items_csv(spark, path, "doc_id bigint, truth string, pred string")


@query(
    "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS value "
    "FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id "
    "WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4"
)
def matrix_coo(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "matrix")
    files.write_matrix_coo(vector_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.4), path, value="similarity")
    return spark.read.schema("i bigint, j bigint, value double").parquet(path).withColumn("value", F.round("value", 6))
