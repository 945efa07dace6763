"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.rows import positional
from shelfsift.llm.words import SPACES, once, words
from shelfsift.session import stage

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-Z]"

ROUNDS = 30
STRENGTH = 10.0  # pseudo-rows behind each starting value
START_GOOD, START_RIGHT = 0.8, 0.7
LEAST, MOST = 0.2, 4.0  # bounds of a vote's log odds: it never speaks against what it says, nor is it beyond doubt
IDLE = 1.0  # bound of the log odds of an abstention, either way


def _share(part: str, whole: str) -> str:
    return f"{part} / greatest({whole}, 1)"


#: name: (votes good if, votes bad if), else it abstains. SQL over the measures. Most rules look for one fault and know nothing of the rest.
NEVER = "false"
RULES = {
    "length": ("n_words >= 100", "n_words < 50"),
    "word_length": (f"n_words >= 20 AND {_share('word_chars', 'n_words')} BETWEEN 3.0 AND 6.5", f"n_words > 0 AND ({_share('word_chars', 'n_words')} > 7.0 OR {_share('word_chars', 'n_words')} < 2.0)"),
    "symbols_per_word": (NEVER, f"{_share('n_symbols', 'n_words')} > 0.1"),
    "symbols_per_character": (NEVER, f"{_share('n_symbols', 'word_chars')} > 0.05"),
    "lines": (NEVER, f"n_lines >= 3 AND {_share('n_dup_lines', 'n_lines')} > 0.3"),
    "repeats": (NEVER, f"{_share('n_repeat_words', 'n_words')} > 0.3"),
    "capitals": (NEVER, f"n_words >= 20 AND {_share('n_capitals', 'word_chars')} > 0.4"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _count(text: Column, pattern: str) -> Column:
    """Matches of a one-character pattern."""
    return F.size(F.split(text, pattern)) - 1


def _covered(windows: Column) -> Column:
    """Words covered by the three-word windows (as hashes, in order) whose value occurs twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = once(placed, lambda s: F.filter(
        s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    steps = once(starts, lambda p: F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeat_words(of: Column) -> Column:
    hashes = F.transform(of, lambda w: F.xxhash64(w))
    windows = once(hashes, lambda h: F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
    # Most texts repeat nothing: they are told by a hash set, without the sort.
    return once(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_m`` of MEASURES (long), all worked out from the whole text of the row.

    Null counts as empty. Windows of three words are compared by a 64-bit hash inside one text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    of_words = once(words(F.col(text)), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    of_lines = once(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    values = {
        "n_symbols": _count(whole, SYMBOLS), "n_capitals": _count(whole, CAPITALS),
        **{m: F.col(f"_w.{m}") for m in ("n_words", "word_chars", "n_repeat_words")},
        "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines"),
    }
    return docs.withColumns({"_w": of_words, "_l": of_lines}).withColumn(
        "_m", F.struct(*[values[m].cast("bigint").alias(m) for m in MEASURES])).drop("_w", "_l")


def vote(rule: str, measures: str = "_m") -> Column:
    """1 good, -1 bad, 0 abstains."""
    good, bad = RULES[rule]
    named = reduce(lambda sql, m: sql.replace(m, f"{measures}.{m}"), MEASURES, f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")
    return F.expr(named)


@dataclass(frozen=True)
class Weights:
    """Share of good texts, and per rule the log odds that its good vote, bad vote or abstention adds."""

    good: float
    up: tuple[float, ...]
    down: tuple[float, ...]
    idle: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a text with these votes is good."""
        evidence = F.lit(math.log(self.good / (1 - self.good)))
        for v, up, down, idle in zip(votes, self.up, self.down, self.idle):
            evidence = evidence + F.when(v == 1, F.lit(up)).when(v == -1, F.lit(-down)).otherwise(F.lit(idle))
        return 1 / (1 + F.exp(-evidence))


def learn(docs: DataFrame) -> Weights:
    """Weights of RULES from the votes on all rows of a measured table, without any label.

    The rows are counted per pattern of votes first, which leaves at most 3 ** len(RULES) rows; the
    rounds of expectation-maximisation are one expression over their array. A vote's accuracy is how much
    more often the rule casts it on texts it is right about than on the others; that a rule which looks
    for a fault finds none is weighed alike, within narrower bounds. Without rows the starting values stay.
    """
    names = list(RULES)
    counted = docs.groupBy(*[vote(r).alias(r) for r in names]).agg(F.count(F.lit(1)).alias("n"))
    patterns = counted.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("v"), F.col("n").cast("double").alias("n")))).alias("patterns"))
    sure = F.lit(math.log(START_RIGHT / (1 - START_RIGHT)))
    start = F.struct(
        F.lit(START_GOOD).alias("good"), F.array_repeat(sure, len(names)).alias("up"),
        F.array_repeat(sure, len(names)).alias("down"), F.array_repeat(F.lit(0.0), len(names)).alias("idle"))
    found = patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: _round(F.col("patterns"), state)).alias("w")).first()["w"]
    return Weights(found["good"], tuple(found["up"]), tuple(found["down"]), tuple(found["idle"]))


def _round(patterns: Column, state: Column) -> Column:
    """One round: posteriors of the patterns under ``state``, then the state they give."""

    def adds(value: Column, rule: Column) -> Column:
        return F.when(value == 1, F.get(state["up"], rule)).when(value == -1, -F.get(state["down"], rule)).otherwise(F.get(state["idle"], rule))

    def posterior(pattern: Column) -> Column:
        evidence = F.aggregate(F.transform(pattern["v"], adds), F.log(state["good"] / (1 - state["good"])), lambda total, x: total + x)
        return 1 / (1 + F.exp(-evidence))

    split = F.transform(patterns, lambda p: once(posterior(p), lambda q: F.struct(
        p["v"].alias("v"), (p["n"] * q).alias("good"), (p["n"] * (1 - q)).alias("bad"))))

    def total(rows: Column, side: str) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda so_far, x: so_far + x[side])

    def weights(rows: Column) -> Column:
        def odds(cast: int, right: str, wrong: str, start: float = START_RIGHT, least: float = LEAST, most: float = MOST) -> Column:
            def one(rule: Column) -> Column:
                cast_by = F.filter(rows, lambda x: F.get(x["v"], rule) == cast)
                on_right = (total(cast_by, right) + STRENGTH * start) / (total(rows, right) + STRENGTH)
                on_wrong = (total(cast_by, wrong) + STRENGTH * (1 - start)) / (total(rows, wrong) + STRENGTH)
                return F.least(F.greatest(F.log(on_right / on_wrong), F.lit(least)), F.lit(most))

            return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), one)

        share = (total(rows, "good") + STRENGTH * START_GOOD) / (total(rows, "good") + total(rows, "bad") + STRENGTH)
        return F.struct(
            share.alias("good"), odds(1, "good", "bad").alias("up"), odds(-1, "bad", "good").alias("down"),
            odds(0, "good", "bad", 0.5, -IDLE, IDLE).alias("idle"))

    return once(split, weights)


def judged(docs: DataFrame, weights: Weights) -> DataFrame:
    """A measured table with ``_base_failed``, ``_quality`` (posterior) and ``_kept``."""
    base = F.expr(reduce(lambda sql, m: sql.replace(m, f"_m.{m}"), MEASURES, BASE_FAILED))
    return docs.withColumn("_base_failed", base).withColumn("_quality", weights.posterior([vote(r) for r in RULES])).withColumn(
        "_kept", ~F.col("_base_failed") & (F.col("_quality") >= 0.5))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures, base_failed, quality, kept) of every row.

    Null texts count as empty and fail; empty tables give no rows; equal rows get equal verdicts, null
    keys are kept as they are, and columns other than the two named ones are not read. The measures
    are staged, so that texts are read once although the votes are needed to learn and to judge.
    """
    slim = stage(measured(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").select("_key", "_m"))
    return judged(slim, learn(slim)).select(
        F.col("_key").alias(key), *[F.col(f"_m.{m}").alias(m) for m in MEASURES],
        F.col("_base_failed").alias("base_failed"), F.col("_quality").alias("quality"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; texts are measured twice rather than shuffled."""
    plain, names = positional(docs)
    found = measured(plain, names[docs.columns.index(text)])
    return judged(found, learn(found)).where("_kept").select(*names).toDF(*docs.columns)


def _rounds_sql() -> str:
    """The same rounds as a recursive query over the table ``patterns`` (one column per rule, n)."""
    names = list(RULES)
    evidence = " + ".join(["ln(good / (1 - good))"] + [f"CASE {r} WHEN 1 THEN up_{r} WHEN -1 THEN -down_{r} ELSE idle_{r} END" for r in names])

    def odds(rule: str, cast: int, right: str, wrong: str, start: float = START_RIGHT, least: float = LEAST, most: float = MOST) -> str:
        def rate(amount: str, before: float) -> str:
            return f"(coalesce(sum({amount}) FILTER ({rule} = {cast}), 0) + {STRENGTH * before}) / (sum({amount}) + {STRENGTH})"

        return f"least(greatest(ln(({rate(right, start)}) / ({rate(wrong, 1 - start)})), {least}), {most})"

    good, bad, sure = "n * p", "n * (1 - p)", f"ln({START_RIGHT} / (1 - {START_RIGHT}))"
    start = ", ".join(f"{sure} AS up_{r}, {sure} AS down_{r}, CAST(0 AS DOUBLE) AS idle_{r}" for r in names)
    rates = ", ".join(
        f"{odds(r, 1, good, bad)} AS up_{r}, {odds(r, -1, bad, good)} AS down_{r}, {odds(r, 0, good, bad, 0.5, -IDLE, IDLE)} AS idle_{r}" for r in names)
    return f"""rounds AS (
  SELECT 0 AS turn, CAST({START_GOOD} AS DOUBLE) AS good, {start}
  UNION ALL
  SELECT turn + 1, (sum(n * p) + {STRENGTH * START_GOOD}) / (sum(n) + {STRENGTH}) AS good, {rates}
  FROM (SELECT *, 1 / (1 + exp(-({evidence}))) AS p FROM rounds, patterns WHERE turn < {ROUNDS}) GROUP BY turn
), judged AS (
  SELECT v.*, 1 / (1 + exp(-({evidence}))) AS p FROM voted v, rounds WHERE turn = {ROUNDS}
)"""


QUALITY_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split
), triples AS (
  SELECT doc_id, i, word, lead(word) OVER later AS second, lead(word, 2) OVER later AS third
  FROM placed WINDOW later AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, second, third) AS c FROM triples WHERE third IS NOT NULL
), steps AS (
  SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS step FROM windows WHERE c > 1
), repeated AS (
  SELECT doc_id, sum(step) AS n_repeat_words FROM steps GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id
), voted AS (
  SELECT *, {", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {name}" for name, (good, bad) in RULES.items())} FROM measured
), patterns AS (
  SELECT {", ".join(RULES)}, count(*) AS n FROM voted GROUP BY ALL
), {_rounds_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND p >= 0.5 AS kept
FROM judged
"""
