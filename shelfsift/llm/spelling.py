"""Spelling variants: words at edit distance one, found through blocked Gram matrices of letter counts.

One edit moves a word's letter counts by a squared distance of at most two. The squared distances of a
block of words are ``|a|^2 + |b|^2 - 2ab``, one matrix product; only pairs at most two apart, of equal
or adjacent lengths, are looked at letter by letter.

Blocks: letters are dealt into four groups of like entropy. One edit touches at most two groups, so two
words one edit apart agree in the counts of two whole groups at least: a block is the words that agree in
two given groups, for each of the six choices of two. An insertion touches one group, so two choices are
enough for adjacent lengths. A pair that meets in several blocks is taken in the first. A block of more
than ``TILE`` words is cut into tiles by a hash, and every two tiles of it are a unit of work.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.words import sliced_words
from shelfsift.operators.joins import broadcast_small, skew_join
from shelfsift.session import stage

#: Latin-1 with A-Z as a-z, the letters from U+00C0 on as they are, anything else as a space.
LETTERS = bytes(i | 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))
MOST_COUNTED = 500_000  # words a task counts before it hands them on
DIMS = 96  # letters share dimensions beyond, which only brings words nearer
GROUPS = 4
FAMILIES = ((0, 1), (2, 3), (0, 2), (1, 3), (0, 3), (1, 2))  # the first two do for adjacent lengths
TILE = 4096
CHUNK = 1 << 22  # cells of a matrix worked on at a time
HANDED = 1 << 14  # pairs a task holds before it hands them on

Batches = Iterator[pa.RecordBatch]


# -- words -----------------------------------------------------------------------------------


def letter_runs(text: str | None) -> Iterator[list[bytes]]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z, in Latin-1."""
    return sliced_words((text or "").encode("latin-1", "replace").translate(LETTERS))


def _misspelt(run: bytes, start: int, one_in: int) -> bytes:
    """The run, without one of its letters where the checksum says so; ``start``: checksum of what stands before it."""
    found = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if found % one_in:
        return run
    at = found % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 97, min_letters: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the letter runs of all whole texts, with the errors put in that ``<key>:<run>``'s crc32 calls for.

    Null texts have no runs; a null key is an empty string in the checksum. Rows are taken one by one,
    whatever their keys.
    """
    def run(source: Batches) -> Batches:
        def handed(totals: Counter) -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in totals], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(totals.values()), pa.int64())], ["word", "n"])

        totals: Counter = Counter()
        for batch in source:
            for k, t in zip(batch["_key"].to_pylist(), batch["_text"].to_pylist()):
                start, runs = crc32(f"{k}:".encode()), Counter()
                for words in letter_runs(t):
                    runs.update(words)
                for word, n in runs.items():
                    word = _misspelt(word, start, one_in)
                    if len(word) >= min_letters:
                        totals[word] += n
                if len(totals) >= MOST_COUNTED:
                    yield handed(totals)
                    totals = Counter()
        yield handed(totals)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- blocks ----------------------------------------------------------------------------------


def letter_counts(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts per dimension, all code points one after another, lengths)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    cells = np.repeat(np.arange(len(words)) * DIMS, sizes) + codes % DIMS
    return np.bincount(cells, minlength=len(words) * DIMS).reshape(-1, DIMS), codes, sizes


def _group_names(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for the counts of each group, per word and group."""
    factors = np.random.default_rng(1).integers(1, 1 << 61, DIMS, dtype=np.int64)
    with np.errstate(over="ignore"):
        return np.stack([counts[:, group == g] @ factors[group == g] for g in range(GROUPS)], axis=1)


def _blocks(names: np.ndarray) -> np.ndarray:
    """A number of the block in each family, per word and family."""
    with np.errstate(over="ignore"):
        return np.stack([names[:, a] * 1_000_003 + names[:, b] * 998_244_353 for a, b in FAMILIES], axis=1)


def letter_groups(words: DataFrame) -> np.ndarray:
    """Each dimension's group, so that all groups tell words apart about equally well; from the counts of all words."""
    top = 8  # counts beyond are as good as that

    def run(source: Batches) -> Batches:
        seen = np.zeros((DIMS, top + 1), np.int64)
        for batch in source:
            counts, _, _ = letter_counts(batch["word"].to_pylist())
            cells = np.arange(DIMS) * (top + 1) + np.minimum(counts, top)
            seen += np.bincount(cells.ravel(), minlength=seen.size).reshape(seen.shape)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], ["cell", "n"])

    seen = np.zeros(DIMS * (top + 1))
    for cell, n in words.select("word").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():  # DIMS * (top + 1) rows at most
        seen[cell] = n
    share = seen.reshape(DIMS, -1) / max(seen[: top + 1].sum(), 1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    group, load = np.zeros(DIMS, np.int64), np.zeros(GROUPS)
    for d in np.argsort(-entropy, kind="stable"):
        group[d] = load.argmin()
        load[group[d]] += entropy[d]
    return group


def _keyed(group: np.ndarray) -> Callable[[Batches], Batches]:
    def run(source: Batches) -> Batches:
        for batch in source:
            counts, _, _ = letter_counts(batch["word"].to_pylist())
            blocks = _blocks(_group_names(counts, group))
            rows, n = pa.array(np.repeat(np.arange(len(counts)), len(FAMILIES))), len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(len(FAMILIES), dtype=np.int8), n)), pa.array(blocks.ravel()), batch["word"].take(rows), batch["n"].take(rows)],
                ["family", "block", "word", "n"])
    return run


# -- pairs -----------------------------------------------------------------------------------


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b is a with one more letter: what they share from the front and from the back covers a."""
    size = a.shape[1]
    front = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


def near_in_unit(family: int, words: Sequence[str], tile: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Pairs (row, row) one edit apart among the words of one unit; with two tiles, only those between them."""
    counts, codes, sizes = letter_counts(words)
    names = _group_names(counts, group)
    starts = np.cumsum(sizes) - sizes
    two = tile.min() != tile.max()
    found = [np.empty((0, 2), np.int64)]
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        for other in (0, 1) if family < 2 else (0,):
            theirs = np.flatnonzero(sizes == size + other)
            # Whole numbers below 2^24 are exact in single precision.
            kind = np.float32 if 2 * (size + 1) ** 2 < 1 << 24 else np.float64
            right = counts[theirs].astype(kind)
            right_squares = (right**2).sum(axis=1)
            step = max(CHUNK // max(len(theirs), 1), 1)
            for i in range(0, len(mine), step):
                left = counts[mine[i : i + step]].astype(kind)
                x, y = np.nonzero((left**2).sum(axis=1)[:, None] + right_squares - 2 * (left @ right.T) <= 2)
                x, y = mine[x + i], theirs[y]
                kept = tile[x] != tile[y] if two else (x < y if not other else np.ones(len(x), bool))
                if two and not other:
                    kept &= x < y
                x, y = x[kept], y[kept]
                agree = np.stack([(names[x][:, list(f)] == names[y][:, list(f)]).all(axis=1) for f in FAMILIES], axis=1)
                first = agree.any(axis=1) & (agree.argmax(axis=1) == family)
                x, y = x[first], y[first]
                test = _one_inserted if other else _one_replaced
                for j in range(0, len(x), max(CHUNK // int(size + 1), 1)):
                    a, b = x[j : j + max(CHUNK // int(size + 1), 1)], y[j : j + max(CHUNK // int(size + 1), 1)]
                    same = test(codes[starts[a][:, None] + np.arange(size)], codes[starts[b][:, None] + np.arange(size + other)])
                    found.append(np.stack([a[same], b[same]], axis=1))
    return np.concatenate(found)


UNIT = ["family", "block", "_a", "_b"]


def _compared(group: np.ndarray) -> Callable[[Batches], Batches]:
    """Units follow one another in a sorted partition; each is compared once its last row is there."""
    names = ["word", "n", "near", "near_n"]

    def run(source: Batches) -> Batches:
        unit, words, counts, tiles = None, [], [], []
        found: list[tuple[str, int, str, int]] = []

        def compare() -> None:
            if len(words) > 1:
                for x, y in near_in_unit(unit[0], words, np.array(tiles), group).tolist():
                    found.append((words[x], counts[x], words[y], counts[y]))

        def handed() -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64()) * 2)], names)

        for batch in source:
            marks = [batch[c].to_numpy() for c in UNIT]
            rows = [batch[c].to_pylist() for c in ("word", "n", "_tile")]
            edges = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
                this = tuple(int(m[a]) for m in marks)
                if this != unit:
                    compare()
                    unit, words, counts, tiles = this, [], [], []
                words += rows[0][a:b]
                counts += rows[1][a:b]
                tiles += rows[2][a:b]
                if len(found) >= HANDED:
                    yield handed()
                    found.clear()
        compare()
        yield handed()
    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every two of the given distinct words that differ by one inserted, deleted or replaced code point, once.

    ``words``: (word string, n long), distinct, best staged; null words have no neighbours.
    """
    known = words.where(F.col("word").isNotNull()).select("word", "n")
    group = letter_groups(known)
    keyed = known.mapInArrow(_keyed(group), "family tinyint, block bigint, word string, n bigint")
    sizes = keyed.groupBy("family", "block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TILE)
    # No more than all words times families / TILE blocks are that large.
    large = stage(sizes.select("family", "block", F.ceil(F.col("_n") / TILE).alias("_tiles")))
    tile = F.pmod(F.xxhash64("word"), F.coalesce("_tiles", F.lit(1))).alias("_tile")
    dealt = keyed.join(broadcast_small(large), ["family", "block"], "left").select("family", "block", "word", "n", F.coalesce("_tiles", F.lit(1)).alias("_tiles"), tile)
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_tiles") - 1), lambda j: F.struct(F.least(j, "_tile").alias("_a"), F.greatest(j, "_tile").alias("_b")))
    units = dealt.select("family", "block", "word", "n", "_tile", F.inline(others))
    ready = units.repartition(*UNIT).sortWithinPartitions(*UNIT)
    return ready.mapInArrow(_compared(group), "word string, n bigint, near string, near_n bigint")


# -- groups ----------------------------------------------------------------------------------


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, ties to the first in code-point order, if it is at least twice as frequent."""
    pairs = near_words(words)
    both = F.inline(F.array(F.struct("word", F.col("near").alias("_near"), F.col("near_n").alias("_n")), F.struct(F.col("near").alias("word"), F.col("word").alias("_near"), F.col("n").alias("_n"))))
    best = pairs.select(both).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("_near").alias("near"))).alias("_best"))
    formed = F.col("_best.n") * -1 >= 2 * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(formed, F.col("_best.near")).alias("form"), F.when(formed, -F.col("_best.n")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` with ``root``: the last of the forms that follow one another from a word, itself if it has none.

    A form is at least twice as frequent as its word, so chains are short, and each round doubles the steps taken.
    """
    steps = stage(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        met = stage(skew_join(steps, further, ["root"], steps.groupBy("root").agg(F.count(F.lit(1)).alias("n")), how="left"))
        if met.where("_next is not null").isEmpty():
            return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
        steps = met.select("word", F.coalesce("_next", "root").alias("root"))
