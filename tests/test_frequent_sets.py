"""Frequent sets of tokens."""

import itertools
import math
from collections import Counter

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from shelfsift.functions.text import tokens_replace
from shelfsift.operators import counts


@pytest.mark.parametrize("support", [0.0, 0.2, 0.5, 1.0])
def test_every_frequent_set_and_no_other(spark, support):
    texts = ["red bolt steel", "steel bolt red red", "bolt cap", "red cap steel", None, "", "bolt", "soft cap bolt red"] * 3 + ["x y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {tuple(sorted(r["items"])): r["freq"] for r in counts.frequent_sets(df, "t", support).collect()}
    rows = [set(r[0]) for r in df.where("t is not null").select(tokens_replace(F.lower("t"))).collect() if r[0]]
    want = Counter(c for row in rows for k in range(1, len(row) + 1) for c in itertools.combinations(sorted(row), k))
    assert found == {c: n for c, n in want.items() if n >= math.ceil(support * len(rows))}


def test_like_fp_growth(spark):
    df = spark.createDataFrame([(" ".join(f"w{j}" for j in range(12) if (i * 7 + j * j) % (j + 2) < 2),) for i in range(200)], "t string")
    baskets = df.select(F.array_distinct(tokens_replace(F.lower("t"))).alias("items")).where(F.size("items") > 0)
    want = {tuple(sorted(r["items"])): r["freq"] for r in FPGrowth(itemsCol="items", minSupport=0.1).fit(baskets).freqItemsets.collect()}
    got = counts.frequent_sets(df, "t", 0.1).collect()
    assert {tuple(sorted(r["items"])): r["freq"] for r in got} == want and len(got) == len(want)


def test_copies_of_a_row_count_each(spark):
    """Folded rows weigh as many as they are."""
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "a b c d e f g h").otherwise("a b").alias("t"))
    found = {"".join(sorted(r["items"])): r["freq"] for r in counts.frequent_sets(df, "t", 0.5).collect()}
    assert len(found) == 255 and found["ab"] == 2000 and found["abcdefgh"] == 1000


def test_no_rows(spark):
    assert counts.frequent_sets(spark.createDataFrame([(None,)], "t string"), "t", 0.5).collect() == []
