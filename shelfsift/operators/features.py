"""Counts, TF-IDF, co-occurrence and class statistics of tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.functions.text import FEATURE_WORD, char_ngrams, feature_words, split_tokens, term_runs
from shelfsift.operators.joins import broadcast_small, skew_join
from shelfsift.operators.ranks import with_positions
from shelfsift.operators.saved import OwnModel
from shelfsift.session import stage


PAIRS = 1 << 20  # pairs summed at a time in a task, and that one partition sums, about
ROW, VECTOR = "_counted_row", "_counted_vector"  # names that no caller's columns have


class CountTokens(Estimator):
    """Counts of the tokens of some array columns as one sparse vector, the places of each column's vocabulary behind those of the one before.

    ``steps`` make the columns. A vocabulary is a staged table from the most frequent token down, equal
    counts in the order of the tokens, and never comes to the driver. ``limit`` is the most tokens of a
    column, None: all. ``weighted``: the counts once more behind them, by the inverse document frequency
    ln((rows + 1) / (rows with the token + 1)).
    """

    def __init__(self, steps: Sequence[Transformer], columns: Sequence[str], output: str, binary: bool = False, limit: int | None = None, weighted: bool = False):
        super().__init__()
        self.steps, self.columns, self.output, self.binary, self.limit, self.weighted = list(steps), list(columns), output, binary, limit, weighted

    def _fit(self, df: DataFrame) -> TokenCounts:
        steps = PipelineModel(self.steps)
        made = steps.transform(df)
        counts = _tokens(made, [], self.columns).groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"))
        if self.weighted:
            held = _tokens(made, [], self.columns, distinct=True).groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df"))
            counts = counts.join(held, ["kind", "token"])
        ranked = with_positions(counts, ["kind"], [F.desc("n"), F.col("token")], "place")
        kept = stage(ranked if self.limit is None else ranked.where(F.col("place") < self.limit))
        found = {r["kind"]: r["n"] for r in kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        starts = [sum(found.get(k, 0) for k in range(i)) for i in range(len(self.columns))]
        place = F.col("place") + F.get(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("kind"))
        rows = df.count() if self.weighted else 0
        idf = F.log((F.lit(float(rows)) + 1) / (F.col("df") + 1)) if self.weighted else F.lit(1.0)
        vocabulary = kept.select("kind", "token", "n", place.cast("int").alias("place"), idf.alias("idf"))
        return TokenCounts(steps, vocabulary, self.columns, self.output, self.binary, self.weighted, sum(found.values()))


class TokenCounts(OwnModel):
    """The fitted form of :class:`CountTokens`; ``vocabulary`` is a table (kind, token, n, place, idf), kind the number of a column."""

    def __init__(self, steps: PipelineModel, vocabulary: DataFrame, columns: Sequence[str], output: str, binary: bool, weighted: bool, tokens: int):
        super().__init__()
        self.steps, self.vocabulary, self.columns = steps, vocabulary, list(columns)
        self.output, self.binary, self.weighted, self.tokens = output, binary, weighted, tokens

    def values(self) -> dict[str, object]:
        return {"columns": self.columns, "output": self.output, "binary": self.binary, "weighted": self.weighted, "tokens": self.tokens}

    def parts(self) -> dict[str, Model | DataFrame]:
        return {"steps": self.steps, "vocabulary": self.vocabulary}

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = stage(df.withColumn(ROW, F.monotonically_increasing_id()))
        tokens = _tokens(self.steps.transform(rows), [ROW], self.columns, distinct=self.binary)
        keys = ["kind", "token"]
        places = self.vocabulary.select(*keys, "place", "idf")
        small = broadcast_small(places)
        met = tokens.join(small, keys) if small is not places else skew_join(tokens, places, keys, self.vocabulary)
        # A row without tokens has its empty vector from a line of its own, place -1.
        lines = met.select(ROW, "place", "idf").unionByName(rows.select(ROW, F.lit(-1).alias("place"), F.lit(0.0).alias("idf")))
        shape = T.StructType([T.StructField(ROW, T.LongType()), T.StructField(VECTOR, VectorUDT())])
        made = lines.repartition(ROW).sortWithinPartitions(ROW).mapInArrow(_vectors(self.tokens, self.weighted), shape)
        return rows.join(made, ROW).select(*df.columns, F.col(VECTOR).alias(self.output))


def _vectors(tokens: int, weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted lines (row, place, idf), one for each token of a row and one with place -1, into a sparse vector per row."""
    size = tokens * (2 if weighted else 1)

    def packed(no: np.ndarray, place: np.ndarray, idf: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((place, no))
        no, place, idf = no[order], place[order], idf[order]
        first = np.flatnonzero(np.concatenate([[True], (no[1:] != no[:-1]) | (place[1:] != place[:-1])]))
        x = np.diff(np.append(first, len(no))).astype(np.float64)
        rows, there = no[first[place[first] < 0]], place[first] >= 0
        no, place, idf, x = no[first][there], place[first][there], idf[first][there], x[there]
        if weighted:
            no, place, x = np.concatenate([no, no]), np.concatenate([place, place + tokens]), np.concatenate([x, x * idf])
            order = np.lexsort((place, no))
            order = order[x[order] != 0]
            no, place, x = no[order], place[order], x[order]
        ends = pa.array(np.searchsorted(no, np.append(rows, np.iinfo(np.int64).max)), pa.int32())
        parts = [np.zeros(len(rows), np.int8), np.full(len(rows), size, np.int32)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (place.astype(np.int32), x)]
        vector = pa.StructArray.from_arrays([*map(pa.array, parts), *lists], ["type", "size", "indices", "values"])
        return pa.RecordBatch.from_arrays([pa.array(rows), vector], [ROW, VECTOR])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # lines of a row that may go on in the next batch
        for batch in source:
            lines = [batch[c].to_numpy() for c in (ROW, "place", "idf")]
            if not len(lines[0]):
                continue
            cut = np.searchsorted(lines[0], lines[0][-1])
            if held and (cut or held[0][0][0] != lines[0][0]):
                yield packed(*map(np.concatenate, zip(*held, [v[:cut] for v in lines])))
                held = []
            elif cut:
                yield packed(*(v[:cut] for v in lines))
            held.append([v[cut:] for v in lines])
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    return run


def _tokens(df: DataFrame, keep: Sequence[str], columns: Sequence[str], distinct: bool = False) -> DataFrame:
    """(keep, kind, token) of all tokens of each row, or of its different ones; kind is the number of the column."""
    lists = [F.array_distinct(c) if distinct else F.col(c) for c in columns]
    named = [df.select(*keep, F.lit(k).alias("kind"), F.explode(tokens).alias("token")) for k, tokens in enumerate(lists)]
    whole = named[0]
    for one in named[1:]:
        whole = whole.unionByName(one)
    return whole


def feature_tokens(text: str, output: str, ngram_range: tuple[int, int] = (1, 1), stop_words: bool = False) -> tuple[list[Transformer], str]:
    """The steps from text to its word n-grams, and the column that holds them."""
    low, high = ngram_range
    tok = f"_{output}_words"
    stages = [RegexTokenizer(inputCol=text, outputCol=tok, pattern=FEATURE_WORD, gaps=False, toLowercase=True)]
    if stop_words:
        stages.append(StopWordsRemover(inputCol=tok, outputCol=f"{tok}_kept"))
        tok = f"{tok}_kept"
    grams = []
    for n in range(low, high + 1):
        stages.append(NGram(n=n, inputCol=tok, outputCol=f"_{output}_{n}"))
        grams.append(f"_{output}_{n}")
    if len(grams) > 1:
        stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(grams)}) AS _{output}_all FROM __THIS__"))
        grams = [f"_{output}_all"]
    return stages, grams[0]


def count_features(
    text: str, output: str = "features", ngram_range: tuple[int, int] = (1, 1), binary: bool = False,
    max_features: int | None = None, stop_words: bool = False,
) -> Pipeline:
    """Pipeline from text to a sparse vector of word n-gram counts, of all n-grams unless the caller sets a limit."""
    steps, tokens = feature_tokens(text, output, ngram_range, stop_words)
    return Pipeline(stages=[CountTokens(steps, [tokens], output, binary, max_features)])


def term_counts(df: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, token, n) rows, counted inside each row without a shuffle."""
    return df.select(id, F.explode(term_runs(tokens)).alias("_t")).select(id, "_t.token", "_t.n")


def document_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """In how many rows each token occurs."""
    return (
        df.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    )


def tfidf_sublinear(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, token, weight): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), each text scaled to length 1."""
    words = feature_words(text)
    frequency = document_frequency(df, words)
    total = df.agg(F.count(text)).scalar()
    weighted = skew_join(term_counts(df, id, words), frequency, ["token"], frequency, rows="df").select(
        id, "token", ((1 + F.log("n")) * (F.log((1 + total) / (1 + F.col("df"))) + 1)).alias("_w")
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id)))
    return weighted.select(id, "token", (F.col("_w") / length).alias("weight"))


def hash_subwords(df: DataFrame, text: str, lo: int, hi: int, buckets: int, output: str = "subwords") -> DataFrame:
    """Hashed counts of the character n-grams of every word."""
    grams = F.flatten(F.transform(split_tokens(text), lambda w: char_ngrams(w, lo, hi)))
    return HashingTF(inputCol="_grams", outputCol=output, numFeatures=buckets).transform(
        df.withColumn("_grams", grams)
    ).drop("_grams")


def cooccurrence(df: DataFrame, tokens: Column, window: int) -> DataFrame:
    """Weighted counts of unordered token pairs at most ``window`` apart; a pair weighs 1 / distance.

    Pairs are made and summed for a bounded number of tokens at a time, and their sums meet in partitions that
    grow in number, not in size, with the tokens.
    """
    lists = df.select(tokens.alias("_tokens")).where(F.size("_tokens") > 1)
    total = lists.agg(F.coalesce(F.sum(F.size("_tokens")), F.lit(0))).first()[0]
    parts = max(-(-total * window // PAIRS), df.sparkSession.sparkContext.defaultParallelism)
    summed = lists.mapInArrow(_near_pairs(window), "first string, second string, weight double, pairs bigint")
    return summed.repartition(parts, "first", "second").groupBy("first", "second").agg(
        F.sum("weight").alias("weight"), F.sum("pairs").alias("pairs"))


def _near_pairs(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The token pairs of bounded slices of the lists, each pair once a slice."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = batch["_tokens"]
            ends = np.cumsum(lists.value_lengths().to_numpy())
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends * window // PAIRS)) + 1, [len(lists)]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                some = lists.slice(a, b - a)
                named = pc.dictionary_encode(some.flatten())
                order = pc.sort_indices(named.dictionary)
                words, rank = named.dictionary.take(order), np.empty(len(order), np.int64)
                rank[order.to_numpy()] = np.arange(len(order))
                code, row = rank[named.indices.to_numpy()], np.repeat(np.arange(len(some)), some.value_lengths().to_numpy())
                keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
                for d in range(1, min(window, len(code) - 1) + 1):
                    x, y = (v[row[:-d] == row[d:]] for v in (code[:-d], code[d:]))
                    keys.append(np.minimum(x, y) * len(words) + np.maximum(x, y))
                    weights.append(np.full(len(x), 1.0 / d))
                found, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
                weight = np.bincount(at, np.concatenate(weights), len(found))
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(found // max(len(words), 1))), words.take(pa.array(found % max(len(words), 1))), pa.array(weight), pa.array(n.astype(np.int64))],
                    ["first", "second", "weight", "pairs"])

    return run


def class_log_odds(df: DataFrame, tokens: Column, cls: str) -> DataFrame:
    """How much more likely a token is inside a class than outside it, add-one smoothed, as a log ratio."""
    cells = stage(
        df.select(F.col(cls).alias("class"), F.explode(tokens).alias("token"))
        .groupBy("class", "token").agg(F.count(F.lit(1)).alias("n_wc"))
    )
    per_token = cells.groupBy("token").agg(F.sum("n_wc").alias("n_w"), F.count(F.lit(1)).alias("_classes"))
    per_class = cells.groupBy("class").agg(F.sum("n_wc").alias("n_c"))
    total = cells.agg(F.sum("n_wc")).scalar()
    vocab = cells.agg(F.count_distinct("token")).scalar()
    joined = skew_join(cells, per_token, ["token"], per_token, rows="_classes").join(per_class, "class")
    inside = (F.col("n_wc") + 1) / (F.col("n_c") + vocab)
    outside = (F.col("n_w") - F.col("n_wc") + 1) / (total - F.col("n_c") + vocab)
    return joined.select("class", "token", "n_wc", F.log(inside / outside).alias("log_odds"))


def phrases(df: DataFrame, tokens: Column, min_count: int, threshold: float) -> DataFrame:
    """Adjacent token pairs with score (n_ab - min_count) / (n_a * n_b) * vocabulary size above a threshold."""
    t = F.col("_tokens")
    rows = df.select(tokens.alias("_tokens"))
    words = stage(rows.select(F.explode(t).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    vocab = words.agg(F.count(F.lit(1))).scalar()
    less = F.greatest(F.size(t) - 1, F.lit(0))
    adjacent = F.zip_with(
        F.slice(t, F.lit(1), less), F.slice(t, F.lit(2), less), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    bigrams = stage(
        rows.select(F.explode(adjacent).alias("_p")).groupBy(F.col("_p.a").alias("first"), F.col("_p.b").alias("second"))
        .agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") > min_count)
    )
    scored = bigrams
    for side, name in (("first", "n_a"), ("second", "n_b")):
        partners = bigrams.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        counts = words.select(F.col("token").alias(side), F.col("n").alias(name))
        scored = skew_join(scored, counts, [side], partners)
    score = (F.col("n_ab") - min_count) / (F.col("n_a") * F.col("n_b")) * vocab
    return scored.select("first", "second", "n_ab", score.alias("score")).where(F.col("score") > threshold)
