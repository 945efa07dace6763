"""Word and text vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.text import pair_structs, split_tokens
from shelfsift.operators.features import cooccurrence
from shelfsift.operators.joins import skew_join
from shelfsift.operators.ranks import with_positions
from shelfsift.session import stage

PIECE = 100_000  # pairs of one word in a piece


def word2vec(df: DataFrame, tokens: str, size: int = 64, window: int = 1, iters: int = 1, seed: int = 1, min_count: int = 1, parts: int = 4) -> Word2VecModel:
    """Skip-gram vectors of the words in a token column."""
    return Word2Vec(
        vectorSize=size, windowSize=window, minCount=min_count, maxIter=iters, seed=seed, numPartitions=parts,
        inputCol=tokens, outputCol="vector").fit(df)


def class_corpus(df: DataFrame, text: str, cls: str) -> DataFrame:
    """Two-word lines (token, class): words become similar when they share classes."""
    return df.select(F.explode(split_tokens(text)).alias("_t"), F.col(cls).alias("_c")).select(F.array("_t", "_c").alias("tokens"))


def interrelation_corpus(df: DataFrame, text: str) -> DataFrame:
    """Two-word lines of all token pairs of a text."""
    return df.select(F.explode(pair_structs(split_tokens(text))).alias("_p")).select(F.array("_p.first", "_p.second").alias("tokens"))


def vectors_table(model: Word2VecModel) -> DataFrame:
    """(word, vector) with plain arrays."""
    return model.getVectors().select("word", vector_to_array("vector").cast("array<float>").alias("vector"))


def doc_vectors(model: Word2VecModel, df: DataFrame, id: str) -> DataFrame:
    """(id, vector): mean of the word vectors of each text."""
    return model.transform(df).select(id, vector_to_array("vector").alias("vector"))


def cooc_pairs(df: DataFrame, tokens: Column, window: int, most: float = 100.0, power: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """((word, no), (a, b, share, target, pieces)): co-occurrences in both directions by word numbers, with the weight of their error
    min(1, (x / most)^power), the log of x to be met, and the pieces a word's rows are dealt into."""
    pairs = stage(cooccurrence(df, tokens, window))
    ends = pairs.select(F.explode(F.array_distinct(F.array("first", "second"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = stage(with_positions(ends, [], ["word"], "no"))
    first = words.select(F.col("word").alias("first"), F.col("no").alias("a"), F.col("n").alias("_na"))
    second = words.select(F.col("word").alias("second"), F.col("no").alias("b"), F.col("n").alias("_nb"))
    met = skew_join(pairs, first, ["first"], first, rows="_na")
    met = skew_join(met, second, ["second"], second, rows="_nb")
    both = met.select("a", "b", "_na", "weight").unionByName(met.where("a <> b").select(
        F.col("b").alias("a"), F.col("a").alias("b"), F.col("_nb").alias("_na"), "weight"))
    return words, stage(both.select(
        "a", "b", F.least(F.lit(1.0), F.pow(F.col("weight") / most, F.lit(power))).alias("share"), F.log("weight").alias("target"),
        F.ceil(F.col("_na") / PIECE).alias("pieces")))


def _start(words: DataFrame, dim: int, seed: int) -> DataFrame:
    """(b, x): small numbers by hash for each word, the bias last."""
    part = lambda j: (F.pmod(F.xxhash64("word", F.lit(j), F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5) / dim
    return words.select(F.col("no").alias("b"), F.array(*[part(j) for j in range(dim)], F.lit(0.0)).alias("x"))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the rows of each word in a batch: the sum of weighted outer products, and of products with the target, flat."""
    for rows in batches:
        if rows.empty:
            continue
        x = np.array(rows["x"].tolist(), dtype="float64")
        z = np.hstack([x[:, :-1], np.ones((len(x), 1))])
        weighed = z * rows["share"].to_numpy()[:, None]
        rest = rows["target"].to_numpy() - x[:, -1]
        a = rows["a"].to_numpy()
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        ends = np.r_[starts[1:], len(a)]
        sums = [np.r_[(weighed[i:j].T @ z[i:j]).ravel(), weighed[i:j].T @ rest[i:j]] for i, j in zip(starts, ends)]
        yield pd.DataFrame({"a": a[starts], "_sums": sums})


def fit_side(pairs: DataFrame, other: DataFrame, per_word: DataFrame, dim: int, ridge: float) -> DataFrame:
    """(b, x): the factors and bias of every word that fit the other side's best, in closed form.

    Each word solves dim + 1 linear equations, the sums of which are made over its rows in sorted pieces and then
    added up; a word of very many partners is dealt over many tasks, and leaves one sum of each piece and batch.
    """
    size = dim + 1

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        added = np.array([np.sum(np.array(list(s), dtype="float64"), axis=0) for s in sums]).reshape(len(sums), size * size + size)
        left = added[:, : size * size].reshape(-1, size, size) + ridge * np.eye(size)
        return pd.Series(list(np.linalg.solve(left, added[:, size * size :, None])[:, :, 0]))

    met = skew_join(pairs, other, ["b"], per_word).select("a", "share", "target", "x", F.pmod(F.xxhash64("b"), F.col("pieces")).alias("_piece"))
    sums = met.repartition("a", "_piece").sortWithinPartitions("a").drop("_piece").mapInPandas(_partial, "a long, _sums array<double>")
    return stage(sums.groupBy("a").agg(F.collect_list("_sums").alias("_sums")).select(F.col("a").alias("b"), solve("_sums").alias("x")))


def cooc_loss(pairs: DataFrame, left: DataFrame, right: DataFrame, per_word: DataFrame, ridge: float) -> float:
    """The weighted squared error of both sides' factors, and ``ridge`` times their squares."""
    dim = F.size("_u") - 1
    met = skew_join(pairs.drop("pieces"), right.withColumnRenamed("x", "_v"), ["b"], per_word)
    met = skew_join(met, left.select(F.col("b").alias("a"), F.col("x").alias("_u")), ["a"], per_word.withColumnRenamed("b", "a"))
    product = F.aggregate(F.zip_with(F.slice("_u", 1, dim), F.slice("_v", 1, dim), lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    error = product + F.element_at("_u", -1) + F.element_at("_v", -1) - F.col("target")
    squares = F.aggregate("x", F.lit(0.0), lambda s, t: s + t * t)
    return met.agg(F.sum(F.col("share") * error * error)).first()[0] + ridge * left.unionByName(right).agg(F.sum(squares)).first()[0]


def cooc_factors(
    df: DataFrame, tokens: Column, window: int = 5, dim: int = 16, iters: int = 5, seed: int = 1, most: float = 100.0, power: float = 0.75,
    ridge: float = 0.05,
) -> DataFrame:
    """(word, vector, bias) from co-occurrence weights x, as factors and biases whose sum meets log x.

    Squared errors are weighted by min(1, (x / most)^power), so rare pairs say little and frequent ones do not rule.
    Each round fits one side and then the other in closed form, so the error with its ridge never rises. The two sides'
    vectors, and biases, are added. Words without a neighbour, and null or empty texts, take no part; an empty table has no words.
    """
    words, pairs = cooc_pairs(df, tokens, window, most, power)
    per_word = stage(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    right = _start(words, dim, seed)
    left = right
    for _ in range(iters):
        left = fit_side(pairs, right, per_word, dim, ridge)
        right = fit_side(pairs, left, per_word, dim, ridge)
    sides = left.join(right.withColumnRenamed("x", "_y"), "b").join(words.select(F.col("no").alias("b"), "word"), "b")
    both = sides.select("word", F.zip_with("x", "_y", lambda u, v: u + v).alias("_z"))
    return both.select("word", F.slice("_z", 1, dim).alias("vector"), F.element_at("_z", -1).alias("bias"))
