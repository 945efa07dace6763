"""Counts, crosstabs and token statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.functions.text import term_runs, tokens_replace
from shelfsift.operators.joins import broadcast_small
from shelfsift.session import stage


def category_counts(df: DataFrame, cls: str) -> DataFrame:
    """Rows per category, largest first; rows without one are left out."""
    return (
        df.where(F.col(cls).isNotNull()).groupBy(cls).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), cls)
    )


def token_frequencies(df: DataFrame, text: str) -> DataFrame:
    """How often each token occurs when texts are split at every single space, empty tokens included."""
    return (
        df.select(F.explode(F.split(text, " ", -1)).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "token")
    )


def _choices(n: Column, k: int) -> Column:
    """Ways to choose ``k`` of ``n`` places."""
    ways = F.lit(1.0)
    for i in range(k):
        ways = ways * F.greatest(n - i, F.lit(0)) / (i + 1)
    return ways


def _covering(k: int) -> float:
    """The greatest part of all n^k that choosing ``k`` places from tokens of n places each, some of every token, can be.

    For d tokens it is at most the number of ways to deal k things to d heaps, none empty, divided by k!.
    """
    heaps = lambda d: sum((-1) ** i * math.comb(d, i) * (d - i) ** k for i in range(d + 1))
    return max(heaps(d) for d in range(k + 1)) / math.factorial(k)


def itemsets(
    df: DataFrame, text: str, sizes: Sequence[int], min_support: float, max_support: float = 1.0, min_row_tokens: int = 0
) -> DataFrame:
    """Support of token sets met when choosing ``sizes`` positions of each row.

    Repeated tokens count as often as they are chosen. The denominator is the number of all rows,
    also of those too short to be counted. Rows without a token of their own (null, empty) only count there;
    an empty table has no sets.

    No row lists its choices. What a row gives a set of tokens that occur m1, m2, ... times in it is a
    coefficient of ((1 + x)^m1 - 1) ((1 + x)^m2 - 1) ..., kept up to the largest size. A set can grow into nothing that gets
    more from a row than its own coefficients times those of the fittest further tokens, each as frequent as the row's
    most frequent one. Where the sum of these bounds stays below the support, the set and all that hold it are
    dropped; the others meet, two of a row that differ in their last token alone, to make the next level.
    Counts are exact up to 2^53.
    """
    largest = max(sizes)
    rows = df.select(tokens_replace(F.lower(text)).alias("_tokens"))
    total = rows.agg(F.count(F.lit(1)).cast("double")).first()[0]
    least = min_support * total * (1 - 1e-9)
    kept = rows.where(F.size("_tokens") >= max(min_row_tokens, min(sizes))).select(
        F.monotonically_increasing_id().alias("_row"), term_runs("_tokens").alias("_runs"))
    # What one way to choose j places may still become. Further tokens that occur once each can only be taken whole.
    often = F.col("_m")
    more = F.when(often == 1, F.array(*[F.lit(1.0) for _ in range(1, largest + 1)])).otherwise(
        F.array(*[sum((_covering(k - j) * F.pow(often, F.lit(k - j)) for k in sizes if k >= j), F.lit(0.0)) for j in range(1, largest + 1)]))
    single = kept.select("_row", F.array_max(F.transform("_runs", lambda r: r["n"])).alias("_m"), F.explode("_runs").alias("_t")).select(
        "_row", F.array(F.col("_t.token")).alias("items"), F.array(*[_choices(F.col("_t.n"), j) for j in range(1, largest + 1)]).alias("_p"),
        more.alias("_more"))
    # Coefficient j is at place j - 1.
    at = lambda values, j: F.element_at(values, j)
    grown = single.withColumn("_c", F.col("_p"))
    found = None
    for level in range(1, largest + 1):
        grown = stage(grown)
        sums = stage(
            grown.groupBy("items").agg(
                F.sum(sum(at("_p", k) for k in sizes)).alias("_hits"),
                F.sum(sum(at("_p", j) * at("_more", j) for j in range(level, largest + 1))).alias("_most"))
            .where(F.col("_most") >= least))
        here = sums.where(F.col("_hits") > 0).select("items", "_hits")
        found = here if found is None else found.unionByName(here)
        if level == largest or sums.isEmpty():
            break
        names = broadcast_small(sums.select("items", F.array_join("items", " ").alias("_name"))).drop("_name")
        open_ = grown.join(names, "items", "left_semi")
        first = open_.select("_row", "_more", "items", "_p", F.slice("items", 1, level - 1).alias("_head"))
        second = open_.select("_row", F.slice("items", 1, level - 1).alias("_head"), F.element_at("items", -1).alias("_last"), "_c")
        grown = first.join(second, ["_row", "_head"]).where(F.element_at("items", -1) < F.col("_last")).select(
            "_row", F.array_append("items", F.col("_last")).alias("items"),
            F.array(*[
                sum((at("_p", i) * at("_c", j - i) for i in range(1, j)), F.lit(0.0)) for j in range(1, largest + 1)]).alias("_p"),
            "_more", "_c")
    return (
        found.withColumn("support", F.col("_hits") / total)
        .where(F.col("support").between(min_support, max_support))
        .select(F.array_join("items", " ").alias("items"), F.col("_hits").cast("bigint").alias("hits"), "support")
    )


def itemsets_all(df: DataFrame, text: str, min_support: float = 0.05) -> DataFrame:
    """Support of token sets of every size.

    A set chosen from positions with repeats is met prod(2^m - 1) times when its tokens occur m times
    each, so a row counts for a set with that weight. Sets grow by one token at a time. A set, however it
    grows, gets no more from a row than its own weight times prod(2^m - 1) over the row's later tokens;
    where the sum of these bounds over all rows that hold it is below the support, the set is dropped
    with all that would grow from it. So a row never lists its subsets, only the few that may be frequent.
    """
    rows = df.select(tokens_replace(F.lower(text)).alias("_tokens"))
    total = rows.agg(F.count(F.lit(1)).cast("double")).first()[0]
    counted = rows.select(F.monotonically_increasing_id().alias("_row"), term_runs("_tokens").alias("_runs")).where(F.size("_runs") > 0)
    # What the tokens behind each place can still multiply a weight by.
    single = stage(counted.select("_row", F.posexplode("_runs").alias("_at", "_t"), F.transform("_runs", lambda r: r["n"]).alias("_ns")).select(
        "_row", "_at", "_t.token", (F.pow(2.0, "_t.n") - 1).alias("_w"),
F.aggregate(F.slice("_ns", F.col("_at") + 2, F.size("_ns")), F.lit(1.0), lambda a, n: a * (F.pow(2.0, n) - 1)).alias("_more")))
    least = min_support * total
    grown = single.select("_row", "_at", F.array("token").alias("items"), "_w", "_more")
    found = None
    while True:
        grown = stage(grown)
        sums = stage(grown.groupBy("items").agg(F.sum("_w").alias("_hits"), F.sum(F.col("_w") * F.col("_more")).alias("_most")).where(F.col("_most") >= least))
        if sums.isEmpty():
            break
        level = sums.where(F.col("_hits") >= least)
        found = level if found is None else found.unionByName(level)
        open_ = grown.join(sums.select("items"), "items", "left_semi").select("_row", F.col("_at").alias("_last"), "items", F.col("_w").alias("_had"))
        grown = open_.join(single, "_row").where(F.col("_at") > F.col("_last")).select(
            "_row", "_at", F.array_append("items", F.col("token")).alias("items"), (F.col("_had") * F.col("_w")).alias("_w"), "_more")
    if found is None:
        found = sums
    return found.select(F.array_join("items", " ").alias("items"), F.col("_hits").cast("bigint").alias("hits")).withColumn("support", F.col("hits") / total)


def frequent_sets(df: DataFrame, text: str, min_support: float) -> DataFrame:
    """Token sets by the share of rows that contain them (each row counted once per set).

    A row keeps its frequent tokens, rows with the same ones are folded into one that weighs as many. A set
    grows inside its row by each later token, as long as it is frequent itself: only sums are shuffled.
    """
    baskets = df.select(F.array_distinct(tokens_replace(F.lower(text))).alias("items")).where(F.size("items") > 0)
    numbered = baskets.select(F.monotonically_increasing_id().alias("_row"), "items")
    rows = stage(numbered.select("_row", F.explode("items").alias("_token")))
    least = math.ceil(min_support * rows.agg(F.count_distinct("_row")).first()[0])
    often = stage(rows.groupBy("_token").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least))
    kept = rows.join(broadcast_small(often.select("_token")), "_token").groupBy("_row").agg(F.sort_array(F.collect_list("_token")).alias("_rest"))
    folded = kept.groupBy("_rest").agg(F.count(F.lit(1)).alias("_n"))
    grown = stage(folded.select(F.array().cast("array<string>").alias("items"), "_rest", "_n"))
    found = None
    while True:
        grown = stage(grown.select("items", "_rest", "_n", F.posexplode("_rest").alias("_at", "_token")).select(
            F.array_append("items", F.col("_token")).alias("items"), F.slice("_rest", F.col("_at") + 2, F.size("_rest")).alias("_rest"), "_n"))
        sums = stage(grown.groupBy("items").agg(F.sum("_n").alias("freq")).where(F.col("freq") >= least))
        found = sums if found is None else found.unionByName(sums)
        if sums.isEmpty():
            return found
        grown = grown.where(F.size("_rest") > 0).join(broadcast_small(sums.select("items")), "items", "left_semi")


def crosstab_long(df: DataFrame, truth: str, pred: str, margins: bool = True) -> DataFrame:
    """Rows per (truth, prediction); with margins, ``All`` stands for the sum over that side."""
    if not margins:
        return df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("rows"))
    cells = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("_n"))
    cube = cells.cube(truth, pred).agg(
        F.sum("_n").alias("rows"), F.grouping(truth).alias("_all_truth"), F.grouping(pred).alias("_all_pred")
    )
    return cube.select(
        F.when(F.col("_all_truth") == 1, "All").otherwise(F.col(truth).cast("string")).alias(truth),
        F.when(F.col("_all_pred") == 1, "All").otherwise(F.col(pred).cast("string")).alias(pred),
        "rows",
    )


def confusion(df: DataFrame, truth: str, pred: str, normalize: bool = False) -> DataFrame:
    """Confusion cells, with the share of the truth row when normalised."""
    cells = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("rows"))
    if not normalize:
        return cells
    return cells.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(truth)))


def scores(df: DataFrame, truth: str, pred: str, positive: object = 1) -> DataFrame:
    """Accuracy, recall and precision of the positive class over all rows."""
    hit = F.col(truth) == F.col(pred)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(F.when(F.col(truth) == positive, hit.cast("double"))).alias("recall"),
        F.avg(F.when(F.col(pred) == positive, hit.cast("double"))).alias("precision"),
    )


def step_report(steps: dict[str, DataFrame]) -> DataFrame:
    """Row counts after each named step, as one job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "rows")
        for i, (name, df) in enumerate(steps.items(), 1)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
