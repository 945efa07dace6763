"""Naive Bayes over a token index, as joins and grouped sums for all items at once.

For an item with L tokens and a class c that holds at least one of them

    score = ln prior(c) - L * ln(n_c + V) + sum over tokens found in c of ln(n_wc + 1)

A token unknown to the class adds ln 1 = 0, so an inner join with the index is enough, and it yields
exactly the candidate classes. The index keeps one row per token with its (class, count) pairs - at
most one per class - so a join never multiplies rows, and item rows meet again by item id with one
shuffle before the pairs are unpacked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.functions.text import bind, has_token, term_runs, tokens_ws
from shelfsift.operators.joins import MOST_BROADCAST_BYTES, broadcast_small, skew_join
from shelfsift.session import spread, stage

# What an item without any known token gets.
NO_CLASS = "NA"
NO_CLASS_PROBABILITY = {"laplace": 0.0, "additive": -1.0}


@dataclass(frozen=True)
class TokenIndex:
    """``counts``: token, class, n_wc. ``classes``: class, n_c, docs, first_id, last_id."""

    counts: DataFrame
    classes: DataFrame

    def vocabulary_size(self) -> DataFrame:
        return self.counts.agg(F.count_distinct("token").alias("V"))

    def approximate_vocabulary_size(self) -> DataFrame:
        return self.counts.agg(F.approx_count_distinct("token").alias("V"))


def term_table(items: DataFrame, id: str, text: str, *keep: str) -> DataFrame:
    """(id, kept columns, _len, _runs): every text's tokens with their counts, staged.

    All that is asked of the texts later - frequencies, index counts, terms - is read from here.
    """
    parts = bind(tokens_ws(text), lambda t: F.struct(F.size(t).alias("len"), term_runs(t).alias("runs")))
    split = spread(items.where(F.col(text).isNotNull()).select(id, *keep, text)).select(id, *keep, parts.alias("_p"))
    # Rows without tokens go once the table is written: a filter before would take every text apart a second time.
    return stage(split.select(id, *keep, F.col("_p.len").alias("_len"), F.col("_p.runs").alias("_runs"))).where("_len > 0")


def term_frequency(terms: DataFrame) -> DataFrame:
    """In how many rows of a term table each token occurs."""
    return terms.select(F.explode(F.transform("_runs", lambda r: r["token"])).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def nb_index(df: DataFrame, id: str, text: str, cls: str) -> TokenIndex:
    """Token counts per class and class sizes; ``id`` is unique per item.

    Both tables are written to the shared folder, as every later step reads them several times.
    """
    items = df.select(F.col(id).alias("_id"), F.col(cls).alias("class"), F.col(text).alias("_text"))
    known = spread(items.where(has_token("_text")))
    counts = stage(
        known.select("class", F.explode(tokens_ws("_text")).alias("token")).groupBy("token", "class").agg(F.count(F.lit(1)).alias("n_wc")))
    sizes = counts.groupBy("class").agg(F.sum("n_wc").alias("n_c"))
    ids = known.groupBy("class").agg(
        F.count(F.lit(1)).alias("docs"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))
    return TokenIndex(counts, stage(sizes.join(ids, "class")))


def id_range(index: TokenIndex) -> DataFrame:
    """Lowest and highest item number of the whole index and of each class."""
    each = index.classes.select("class", "first_id", "last_id")
    whole = each.agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    return each.unionByName(whole.withColumn("class", F.lit("*")))


def class_prior(index: TokenIndex, prior: str = "count") -> DataFrame:
    """Share of each class: by its number of items, or by the span of its item numbers.

    The span form equals the count only when the numbers of a class follow one another.
    """
    c = index.classes
    if prior == "span":
        mine = F.col("last_id") - F.col("first_id") + 1
        total = c.agg(F.max("last_id") - F.min("first_id") + 1).scalar()
    else:
        mine = F.col("docs")
        total = c.agg(F.sum("docs")).scalar()
    return c.select("class", "n_c", (mine / total).alias("prior"))


def top_tokens(index: TokenIndex, cls: str, n: int) -> DataFrame:
    """The ``n`` most frequent tokens of one class."""
    return index.counts.where(F.col("class") == cls).orderBy(F.desc("n_wc"), "token").limit(n)


def _numbered(classes: DataFrame) -> DataFrame:
    """Classes with a small number each; there are as many rows as classes."""
    return stage(classes.withColumn("_code", F.row_number().over(Window.orderBy("class"))))


def packed_index(index: TokenIndex, weight: Column, classes: DataFrame) -> DataFrame:
    """One staged row per token: its class numbers and weights as two flat arrays, twelve bytes per pair."""
    return stage(index.counts.join(broadcast_small(classes), "class").groupBy("token").agg(
        F.collect_list(F.struct("_code", weight.alias("w"))).alias("_p")
    ).select("token", F.col("_p._code").alias("_codes"), F.col("_p.w").alias("_weights")))


def _candidate_scores(items: DataFrame, id: str, text: str, packed: DataFrame) -> DataFrame:
    """(id, length, class number, sum of token weights) for the classes that hold a token of the item.

    The most frequent tokens, as many as may be broadcast, meet their weights where the texts are, so that only sums by
    class leave the task; the others meet them by token.
    """
    terms = term_table(items, id, text)
    frequency = stage(term_frequency(terms))
    often = _frequent(packed, frequency)
    rows = terms.select(id, "_len", F.explode("_runs").alias("_t")).select(id, "_len", "_t.token", "_t.n")
    near = rows.join(F.broadcast(often), "token")
    known = F.broadcast(often.select("token"))
    rest = frequency.join(known, "token", "left_anti")
    far = skew_join(rows.join(known, "token", "left_anti"), packed.join(known, "token", "left_anti"), ["token"], rest, rows="df")
    pairs = near.select(id, "_len", "n", "_codes", "_weights").unionByName(far.select(id, "_len", "n", "_codes", "_weights")).select(
        id, "_len", "n", F.inline(F.arrays_zip(F.col("_codes").alias("_code"), F.col("_weights").alias("_w")))
    ).toDF(id, "_len", "n", "_code", "_w")
    return pairs.groupBy(id, "_code").agg(F.max("_len").alias("_len"), F.sum(F.col("n") * F.col("_w")).alias("_sum"))


def _frequent(packed: DataFrame, frequency: DataFrame) -> DataFrame:
    """The rows of a packed index, staged, of the tokens most texts hold; no more than may be broadcast."""
    size = F.octet_length("token") + 12 * F.size("_codes") + 64
    largest = packed.agg(F.max(size)).first()[0] or 1
    often = frequency.orderBy(F.desc("df"), "token").limit(max(1, MOST_BROADCAST_BYTES // 2 // largest)).select("token")
    return stage(packed.join(F.broadcast(often), "token"))


@dataclass(frozen=True)
class Scorer:
    """What scoring needs of an index, made once for any number of item tables or micro-batches."""

    packed: DataFrame
    classes: DataFrame
    smoothing: str
    vocabulary: int

    def scores(self, items: DataFrame, id: str, text: str) -> DataFrame:
        """(id, class, score, probability) for every candidate class of every item, summing to 1 per item."""
        mine = Window.partitionBy(id)
        sums = _candidate_scores(items, id, text, self.packed).join(broadcast_small(self.classes), "_code")
        if self.smoothing == "laplace":
            score = F.log("prior") - F.col("_len") * F.log(F.col("n_c") + self.vocabulary) + F.col("_sum")
            raw = sums.select(id, "class", score.alias("score"))
            shifted = raw.withColumn("_p", F.exp(F.col("score") - F.max("score").over(mine)))
        else:
            raw = sums.select(id, "class", (F.col("_sum") + F.col("prior")).alias("score"))
            shifted = raw.withColumn("_p", F.col("score"))
        return shifted.select(id, "class", "score", (F.col("_p") / F.sum("_p").over(mine)).alias("probability"))

    def predict(self, items: DataFrame, id: str, text: str) -> DataFrame:
        """(id, predicted_category, probability), ties to the smallest class name, one row per item."""
        ranked = F.min(F.struct((-F.round("score", 6)).alias("s"), F.col("class"), F.col("probability")))
        picked = self.scores(items, id, text).groupBy(id).agg(ranked.alias("_best")).select(id, "_best.class", "_best.probability")
        return items.select(id).join(picked, id, "left").select(
            id,
            F.coalesce("class", F.lit(NO_CLASS)).alias("predicted_category"),
            F.coalesce("probability", F.lit(NO_CLASS_PROBABILITY[self.smoothing])).alias("probability"),
        )


def scorer(index: TokenIndex, smoothing: str = "laplace", prior: str = "count") -> Scorer:
    classes = _numbered(class_prior(index, prior))
    weight = F.log(F.col("n_wc") + 1) if smoothing == "laplace" else F.col("n_wc") / F.col("n_c")
    kept = classes.select("class", "_code") if smoothing == "laplace" else classes
    return Scorer(packed_index(index, weight, kept), classes, smoothing, index.vocabulary_size().first()[0])


def nb_scores(
    items: DataFrame, id: str, text: str, index: TokenIndex, smoothing: str = "laplace", prior: str = "count"
) -> DataFrame:
    return scorer(index, smoothing, prior).scores(items, id, text)


def nb_predict(
    items: DataFrame, id: str, text: str, index: TokenIndex, smoothing: str = "laplace", prior: str = "count"
) -> DataFrame:
    return scorer(index, smoothing, prior).predict(items, id, text)


def nb_explain(items: DataFrame, id: str, text: str, index: TokenIndex) -> DataFrame:
    """Every factor of the Laplace score: one row per item, candidate class and distinct token.

    The factors of tokens a class holds come from the join with the index; the others are the item's
    tokens for each of its candidate classes, less those found. Rows stay flat: no item's classes meet
    in one array.
    """
    terms = term_table(items, id, text)
    rows = stage(terms.select(id, F.explode("_runs").alias("_t")).select(id, "_t.token", "_t.n"))
    packed = index.counts.groupBy("token").agg(F.collect_list(F.struct("class", "n_wc")).alias("_classes"))
    met = skew_join(rows, packed, ["token"], term_frequency(terms), rows="df").select(id, "token", F.inline("_classes"))
    found = stage(met.toDF(id, "token", "class", "n_wc"))
    candidates = found.select(id, "class").distinct()
    every = rows.join(candidates, id).join(found, [id, "class", "token"], "left").withColumn("n_wc", F.coalesce("n_wc", F.lit(0).cast("bigint")))
    vocab = index.vocabulary_size().scalar()
    return every.join(broadcast_small(index.classes.select("class", "n_c")), "class").select(
        id, "class", "token", "n", "n_wc", "n_c", vocab.alias("V"),
        ((F.col("n_wc") + 1) / (F.col("n_c") + vocab)).alias("p"),
    )
