"""Labels, filters, deduplication, samples and the preparation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.operators import prep, ranks
from shelfsift.operators.counts import step_report
from shelfsift.plans import jobs
from shelfsift.queries import query, table
from shelfsift.queries.fragments import CLEANED, PREPARED, documents, items

# Order rows told as annotated items: the same CASE on both sides.
_REASONS = """(SELECT o_orderkey, o_orderpriority AS description, o_custkey % 7 + 209 AS category_id,
  o_orderdate AS order_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Category Include' WHEN '2-HIGH' THEN 'Scraped Category'
    WHEN '4-NOT SPECIFIED' THEN 'Other reason' WHEN '5-LOW' THEN 'Category Include Description' END AS inclusion_reason,
  CASE o_orderstatus WHEN 'O' THEN 'Miscategorized' WHEN 'P' THEN 'Excluded' END AS exclusion_reason,
  CASE WHEN o_totalprice > 400000 THEN 'N' WHEN o_totalprice > 200000 THEN NULL ELSE 'Y' END AS do_use
  FROM orders)"""
_TYPE = """CASE WHEN inclusion_reason IN ('Category Include', 'Category Include Description') AND exclusion_reason IS NULL
    THEN 'False Negative' WHEN exclusion_reason = 'Miscategorized' THEN 'False Positive'
  WHEN (inclusion_reason IS NULL OR inclusion_reason IN ('Scraped Category', 'Scraped Category & Brand', 'Scraped Brand'))
    AND exclusion_reason IS NULL THEN 'True Positive' ELSE 'Other' END"""


def _reasons(spark: SparkSession, folder: str) -> DataFrame:
    priority, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey", priority.alias("description"), (F.col("o_custkey") % 7 + 209).alias("category_id"),
        F.col("o_orderdate").alias("order_date"),
        F.when(priority == "1-URGENT", "Category Include").when(priority == "2-HIGH", "Scraped Category")
        .when(priority == "4-NOT SPECIFIED", "Other reason").when(priority == "5-LOW", "Category Include Description")
        .alias("inclusion_reason"),
        F.when(status == "O", "Miscategorized").when(status == "P", "Excluded").alias("exclusion_reason"),
        F.when(price > 400000, "N").when(price > 200000, None).otherwise("Y").alias("do_use"),
    )


def _annotated(spark: SparkSession, folder: str) -> DataFrame:
    return prep.annotate_type(_reasons(spark, folder), "inclusion_reason", "exclusion_reason")


_ANNOTATED = f"(SELECT *, {_TYPE} AS type FROM {_REASONS})"


@query(f"SELECT o_orderkey, type FROM {_ANNOTATED}")
def annotate_type(spark: SparkSession, folder: str) -> DataFrame:
    return _annotated(spark, folder).select("o_orderkey", "type")


@query(
    f"SELECT DISTINCT type, description, category_id FROM {_ANNOTATED} WHERE category_id IN (209, 210, 211, 212) "
    "AND order_date >= TIMESTAMP '1997-01-01' AND (exclusion_reason IS NULL OR exclusion_reason = 'Miscategorized') "
    "AND (do_use IS NULL OR do_use = 'Y')"
)
def annotated_training_rows(spark: SparkSession, folder: str) -> DataFrame:
    since = F.lit("1997-01-01").cast("timestamp_ntz")
    return prep.annotated_training_rows(
        _reasons(spark, folder), ["description", "category_id"], [209, 210, 211, 212], "category_id",
        F.col("order_date") >= since, "inclusion_reason", "exclusion_reason", "do_use")


@query(
    f"SELECT DISTINCT description, category_id, strftime(order_date, '%Y-%m-%d') AS order_day, inclusion_reason, exclusion_reason "
    f"FROM {_REASONS} WHERE order_date >= TIMESTAMP '1998-06-01'"
)
def recent_slice(spark: SparkSession, folder: str) -> DataFrame:
    rows = prep.recent_slice(
        _reasons(spark, folder), "order_date", F.lit("1998-06-01").cast("timestamp_ntz"),
        ["description", "category_id", "order_date", "inclusion_reason", "exclusion_reason"])
    return rows.withColumn("order_day", F.date_format("order_date", "yyyy-MM-dd")).drop("order_date")


_TEXTS = f"(SELECT category_id, type, description || ' ' || CAST(o_orderkey % 50 AS VARCHAR) AS text FROM {_ANNOTATED})"


@query(
    f"SELECT DISTINCT text, 1.0::DOUBLE AS label FROM {_TEXTS} WHERE category_id = 211 AND type = 'True Positive' UNION ALL "
    f"SELECT DISTINCT text, 0.0::DOUBLE AS label FROM {_TEXTS} WHERE (category_id <> 211 AND type = 'True Positive') "
    "OR (category_id = 211 AND type = 'False Positive')"
)
def positives_negatives(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat("description", F.lit(" "), (F.col("o_orderkey") % 50).cast("string"))
    return prep.positives_negatives(
        _annotated(spark, folder).withColumn("text", text), 211, "category_id", "text")


@query(f"SELECT o_orderkey, CASE WHEN type = 'False Positive' THEN 'False' ELSE 'Positive' END AS target FROM {_ANNOTATED}")
def binary_target(spark: SparkSession, folder: str) -> DataFrame:
    return prep.binary_target(_annotated(spark, folder)).select("o_orderkey", "target")


@query("SELECT doc_id, source, 'False' AS target FROM documents WHERE source <> 'src3'")
def mark_negative(spark: SparkSession, folder: str) -> DataFrame:
    return prep.mark_negative(documents(spark, folder, "doc_id", "source"), "src3", "source")


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'Positive' ELSE 'False' END AS target FROM documents")
def mark_positive(spark: SparkSession, folder: str) -> DataFrame:
    return prep.mark_positive(documents(spark, folder, "doc_id", "source"), "src3", "source").drop("source")


@query("SELECT doc_id, text AS description_mod1, source AS category_full_path_mod1 FROM documents")
def rename_canonical(spark: SparkSession, folder: str) -> DataFrame:
    raw = documents(spark, folder).withColumnsRenamed({"text": "description", "source": "category_path"})
    return prep.rename_canonical(raw)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_helper_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").drop("o_orderstatus", "o_orderpriority", "o_orderdate")


@query("SELECT p_name, p_type FROM part")
def column_pick(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_name", "p_type")


@query(
    "SELECT p_partkey, p_type FROM part WHERE NOT contains(p_type, 'ECO') AND p_type <> 'PROMO' "
    "AND regexp_matches(p_type, 'STANDARD|SMALL|MEDIUM|LARGE')"
)
def drop_categories(spark: SparkSession, folder: str) -> DataFrame:
    return prep.drop_categories(
        table(spark, folder, "part").select("p_partkey", "p_type"), "p_type", ["ECO"], ["PROMO"],
        "STANDARD|SMALL|MEDIUM|LARGE")


@query(f"WITH {CLEANED} SELECT doc_id FROM long_enough")
def min_tokens(spark: SparkSession, folder: str) -> DataFrame:
    from shelfsift.functions.text import process_string

    cleaned = documents(spark, folder).withColumn("text", process_string("text"))
    return prep.min_tokens(cleaned, "text").select("doc_id")


# Events told as predictions: the value is the probability, the event type the label.
@query("SELECT event_id, event_type, value / 20 AS probability FROM events WHERE value / 20 >= 0.7")
def confident(spark: SparkSession, folder: str) -> DataFrame:
    scored = table(spark, folder, "events").select("event_id", "event_type", (F.col("value") / 20).alias("probability"))
    return prep.confident(scored)


@query(
    "SELECT doc_id, CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS pred FROM labels WHERE quality <> 1 AND toxic = 1"
)
def candidates(spark: SparkSession, folder: str) -> DataFrame:
    marked = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("pred"))
    return prep.candidates(marked, "truth", "pred", "1")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE '%BRAND#1%' AND p_brand NOT ILIKE '%#12%'")
def label_contains(spark: SparkSession, folder: str) -> DataFrame:
    return prep.label_contains(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_brand", "BRAND#1", "#12")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic")
def misclassified(spark: SparkSession, folder: str) -> DataFrame:
    return prep.misclassified(table(spark, folder, "labels"), "quality", "toxic")


@query(
    "SELECT doc_id, text, source FROM (SELECT *, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS copy "
    "FROM documents) WHERE copy = 1"
)
def dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return prep.dedup_keep_first(documents(spark, folder), ["text", "source"], ["doc_id"])


@query("SELECT doc_id, text, source FROM (SELECT *, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE copies = 1")
def dedup_drop_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return prep.dedup_drop_conflicts(documents(spark, folder), ["text"], ["doc_id"])


@query(f"WITH {CLEANED} SELECT doc_id, text, source FROM agreed")
def dedup_unambiguous(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.clean_items(documents(spark, folder), "doc_id", "text", "source")


@query(
    "SELECT p_partkey, p_name, p_brand FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part) WHERE n >= 3"
)
def drop_small_classes(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    keyed = parts.withColumn("cls", F.concat_ws("|", "p_name", "p_brand"))
    return prep.drop_small_classes(keyed, "cls", 3).drop("cls")


@query(f"WITH {PREPARED} SELECT doc_id, text, source FROM prepared")
def prepare_training(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.prepare_training(documents(spark, folder), "doc_id", "text", "source")


_SAMPLE = """SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS pos,
  count(*) OVER (PARTITION BY {group}) AS n FROM {src}) WHERE n <= {k}
  OR (pos % (n // {k}) = 0 AND pos // (n // {k}) < {k})"""


@query(_SAMPLE.format(cols="doc_id, source", group="source", order="text, doc_id", src="documents", k=17))
def systematic_sample(spark: SparkSession, folder: str) -> DataFrame:
    return ranks.systematic_sample(documents(spark, folder), "source", ["text", "doc_id"], 17).select("doc_id", "source")


@query(
    "WITH dim AS (SELECT DISTINCT source, 'All > ' || lang || ' > ' || source AS category_path FROM documents WHERE lang = 'en'), s AS ("
    + _SAMPLE.format(cols="doc_id, text, source", group="source", order="text, doc_id", src="documents", k=30)
    + ") SELECT doc_id, text, s.source, category_path FROM s LEFT JOIN dim ON s.source = dim.source"
)
def sample_nodes(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    paths = documents(spark, folder, "source", "lang").where("lang = 'en'").select(
        "source", F.concat(F.lit("All > "), "lang", F.lit(" > "), "source").alias("category_path"))
    dim = paths.withColumnRenamed("source", "category_id")
    sampled = jobs.sample_nodes(docs, "doc_id", "text", "source", 30).withColumnRenamed("source", "category_id")
    return jobs.with_category_path(sampled, dim).withColumnRenamed("category_id", "source")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 25")
def cap_per_class(spark: SparkSession, folder: str) -> DataFrame:
    return ranks.cap_per_class(documents(spark, folder, "doc_id", "source"), "source", 25, "doc_id")


@query(
    "SELECT p_partkey, p_type, class_rows FROM (SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS class_rows, "
    "row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part WHERE NOT contains(p_type, 'ECO') "
    "AND p_type <> 'PROMO') WHERE r <= 100"
)
def build_balanced(spark: SparkSession, folder: str) -> DataFrame:
    parts = items(spark, folder).select("p_partkey", "p_type")
    return jobs.build_balanced(parts, "p_partkey", "p_type", 100, ["ECO"], ["PROMO"])


@query(
    "SELECT p_partkey, p_type, class_rows FROM (SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS class_rows, "
    "row_number() OVER (PARTITION BY p_type ORDER BY md5('7/' || p_partkey), p_partkey) AS r FROM part WHERE NOT contains(p_type, 'ECO') "
    "AND p_type <> 'PROMO') WHERE r <= 100"
)
def build_balanced_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    parts = items(spark, folder).select("p_partkey", "p_type")
    return jobs.build_balanced(parts, "p_partkey", "p_type", 100, ["ECO"], ["PROMO"], seed=7)


@query(
    "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) + (SELECT max(p_partkey) FROM part) AS item_no FROM documents"
)
def assign_doc_id(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "part").select(F.col("p_partkey").alias("item_no"))
    start = ranks.next_doc_id(used)
    return ranks.assign_doc_id(documents(spark, folder, "doc_id", "source"), ["source", "doc_id"], start).drop("source")


_TRIALS = """(SELECT p_type AS category, p_size AS trial, round(avg(p_retailprice), 0) AS score FROM part GROUP BY p_type, p_size)"""


def _trials(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").groupBy(F.col("p_type").alias("category"), F.col("p_size").alias("trial")).agg(
        F.round(F.avg("p_retailprice"), 0).alias("score"))


@query(
    f"SELECT category, trial, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, trial) AS r "
    f"FROM {_TRIALS}) WHERE r = 1"
)
def best_of_first(spark: SparkSession, folder: str) -> DataFrame:
    return prep.best_of(_trials(spark, folder), ["category"], "score", "trial", "first")


@query(
    f"SELECT category, trial, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, trial DESC, category DESC) AS r "
    f"FROM {_TRIALS}) WHERE r = 1"
)
def best_of_newest(spark: SparkSession, folder: str) -> DataFrame:
    return prep.best_of(_trials(spark, folder), [], "score", "trial", "newest")


@query(
    "SELECT doc_id, source, 1 AS label FROM documents WHERE source = 'src1' UNION ALL "
    "SELECT doc_id, source, 0 AS label FROM documents WHERE source <> 'src1'"
)
def union_labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "source")
    return prep.union_labelled(
        docs.where("source = 'src1'").withColumn("label", F.lit(1)),
        docs.where("source <> 'src1'").withColumn("label", F.lit(0)))


@query(
    "SELECT p_name AS text, p_type AS category, CAST(NULL AS VARCHAR) AS lang FROM part UNION ALL "
    "SELECT text, source, lang FROM documents"
)
def union_pools(spark: SparkSession, folder: str) -> DataFrame:
    """An annotated set and a sampled pool whose columns differ."""
    return prep.union_labelled(
        table(spark, folder, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("category")),
        documents(spark, folder, "text", "source", "lang").withColumnRenamed("source", "category"))


@query("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic")
def with_hard_rows(spark: SparkSession, folder: str) -> DataFrame:
    return prep.with_hard_rows(table(spark, folder, "labels"), "quality", "toxic")


_BUCKET = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INTEGER)"


@query(f"SELECT doc_id, {_BUCKET} < 45875 AS is_train FROM documents")
def split_hash(spark: SparkSession, folder: str) -> DataFrame:
    return prep.split_hash(documents(spark, folder, "doc_id"), "doc_id", 0.7)


@query(f"SELECT doc_id, {_BUCKET} % 5 AS fold FROM documents")
def assign_fold(spark: SparkSession, folder: str) -> DataFrame:
    return prep.assign_fold(documents(spark, folder, "doc_id"), "doc_id")


@query(
    f"WITH {PREPARED} SELECT 1 AS step_no, 'all' AS step, count(*) AS rows FROM documents UNION ALL "
    "SELECT 2, 'clean', count(*) FROM agreed UNION ALL SELECT 3, 'prepared', count(*) FROM prepared"
)
def step_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return step_report({
        "all": docs,
        "clean": jobs.clean_items(docs, "doc_id", "text", "source"),
        "prepared": jobs.prepare_training(docs, "doc_id", "text", "source"),
    })
