"""Word indexes, id sequences, training pairs and label codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.text import pair_structs, split_tokens, token_ngrams, tokens_ws
from shelfsift.operators.features import document_frequency
from shelfsift.operators.joins import skew_join
from shelfsift.operators.ranks import with_positions


def word_index(df: DataFrame, text: str, by: str, order: Sequence[str]) -> DataFrame:
    """Tokens numbered from 1, by frequency (ties: first appearance) or by first appearance.

    ``order`` gives the reading order of the rows and ends in a unique key. Returns token, idx and
    the number of occurrences n.
    """
    seen = df.select(*order, F.posexplode(tokens_ws(text)).alias("_at", "token"))
    words = seen.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, "_at")).alias("_first")
    )
    ranking = {"freq": [F.desc("n"), F.col("_first")], "first": [F.col("_first")]}[by]
    return with_positions(words, [], ranking, "idx").select("token", (F.col("idx") + 1).alias("idx"), "n")


def to_sequence(df: DataFrame, id: str, text: str, index: DataFrame, oov: str = "drop") -> DataFrame:
    """Texts as arrays of word numbers; unknown words are dropped or become 0.

    ``index`` is a ``word_index`` result.
    """
    tokens = df.select(id, F.posexplode_outer(tokens_ws(text)).alias("_at", "token"))
    numbered = skew_join(
        tokens, index.select("token", "idx"), ["token"], document_frequency(df, tokens_ws(text)), rows="df", how="left")
    number = F.col("idx") if oov == "drop" else F.coalesce("idx", F.lit(0))
    entry = F.when(F.col("token").isNotNull() & number.isNotNull(), F.struct("_at", number.cast("int").alias("_i")))
    return numbered.groupBy(id).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["_i"]).alias("sequence")
    )


def token_pairs(df: DataFrame, id: str, tokens: Column) -> DataFrame:
    """One row per (earlier, later) token pair of each text."""
    return df.select(id, F.explode(pair_structs(tokens)).alias("_p")).select(id, "_p.first", "_p.second")


def class_pairs(df: DataFrame, text: str, cls: str, n: int = 1) -> DataFrame:
    """(token, class) rows, or (n-gram joined by _, class) rows for n > 1."""
    grams = token_ngrams(split_tokens(text), n, n, "_")
    return df.select(F.explode(grams).alias("token"), F.col(cls).alias("class"))


def class_appended(df: DataFrame, text: str, cls: str) -> DataFrame:
    """Token lists with the class name as last token."""
    return df.select(F.array_append(split_tokens(text), F.col(cls)).alias("tokens"))


def label_codes(df: DataFrame, cls: str) -> DataFrame:
    """Distinct labels with codes 0..n-1 in alphabetical order."""
    return with_positions(df.select(cls).where(F.col(cls).isNotNull()).distinct(), [], [cls], "code")


def label_encode(df: DataFrame, cls: str, codes: DataFrame | None = None) -> DataFrame:
    return df.join(label_codes(df, cls) if codes is None else codes, cls)


def label_decode(df: DataFrame, code: str, codes: DataFrame, cls: str, name: str) -> DataFrame:
    """The inverse of ``label_encode`` for a column of predicted codes."""
    return df.join(codes.select(F.col("code").alias(code), F.col(cls).alias(name)), code)


def random_vectors(index: DataFrame, word: str, dim: int, seed: int) -> DataFrame:
    """Repeatable vectors with entries uniform in [-0.5, 0.5), a function of word, entry and seed."""
    unit = float(1 << 40)
    draw = F.transform(
        F.sequence(F.lit(1), F.lit(dim)),
        lambda d: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), d.cast("string"), F.col(word))), 1, 10), 16, 10).cast("double") / unit - 0.5,
    )
    return index.withColumn("vector", draw)
