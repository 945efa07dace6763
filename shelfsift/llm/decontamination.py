"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

An item is met through windows of consecutive words, and a window as the set of its shingles. To hold
a window a document must hold every shingle of it, so the rarest one - counted over all documents - is
a sufficient prefix: only its places are looked at. A place is a candidate if the window, laid over
it, stays inside the document (position and length), and a hit if all words of the window stand there.

Windows are compiled in blocks of at most ``BLOCK`` (item, window) pairs, which bounds what is
broadcast and what a worker holds; each block is two scans of the documents, so any number of items
will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.rows import numbered
from shelfsift.llm.words import folded_column, folded_sql, word_numbers
from shelfsift.operators.ranks import with_positions
from shelfsift.session import stage

BLOCK = 250_000  # pairs of an item and a window compiled at a time
CHUNK = 1 << 20  # words compared at a time
SPANS = "array<struct<start: bigint, end: bigint>>"

Batches = Iterator[pa.RecordBatch]


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item string, words) for every distinct window of every item; an item of fewer words, but not none, is one window."""
    words = items.select(F.col(key).cast("string").alias("item"), folded_column(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (window - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, window))).alias("words")).distinct()


class Windows:
    """One block of windows: its vocabulary, the words of each window as numbers, its items and its shingles."""

    def __init__(self, pairs: Sequence[tuple[str | None, Sequence[str]]], shingle: int):
        rows: dict[tuple[str, ...], list[str | None]] = {}
        for item, words in pairs:
            rows.setdefault(tuple(words), []).append(item)
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        code = {item: n for n, item in enumerate(self.items)}
        self.known = {w.encode(): n for n, w in enumerate(sorted(set(chain.from_iterable(rows))), 1)}
        self.words = [np.array([self.known[w.encode()] for w in words], np.int32) for words in rows]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.items_of = [np.array(sorted(code[i] for i in named), np.int64) for named in rows.values()]
        self.mix = np.random.default_rng(1).integers(1, 1 << 63, len(self.known) + 1, dtype=np.uint64)
        self.factors = np.random.default_rng(2).integers(1, 1 << 63, shingle, dtype=np.uint64) | np.uint64(1)
        self.widths = sorted({min(shingle, n) for n in self.length.tolist()})
        of_window = [self.hashes(w, np.arange(len(w) - k + 1), k) for w in self.words for k in [min(shingle, len(w))]]
        self.shingles = {k: np.unique(np.concatenate([h for h, n in zip(of_window, self.length) if min(shingle, n) == k])) for k in self.widths}
        self.of_window, self.shingle = of_window, shingle

    def hashes(self, numbers: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the shingles that start ``at`` these places."""
        total = np.zeros(len(at), np.uint64)
        for j in range(width):
            total += self.mix[numbers[at + j]] * self.factors[j]
        return total

    def places(self, numbers: np.ndarray, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a shingle of ``hashes`` (sorted) starts, and which one."""
        known = numbers != 0
        size = max(len(known) - width + 1, 0)
        whole = known[:size].copy()
        for j in range(1, width):
            whole &= known[j : j + size]
        at = np.flatnonzero(whole)
        found = self.hashes(numbers, at, width)
        which = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        hit = hashes[which] == found
        return at[hit], which[hit]

    def count(self, texts: Sequence[bytes | None]) -> dict[int, np.ndarray]:
        """How often each shingle occurs in the texts."""
        numbers, _ = word_numbers(texts, self.known)
        return {k: np.bincount(self.places(numbers, k, h)[1], minlength=len(h)) for k, h in self.shingles.items()}

    def with_prefixes(self, counts: dict[int, np.ndarray]) -> Prefixes:
        """Each window under its rarest shingle; windows with a shingle that occurs nowhere are left out."""
        chosen: dict[int, list[tuple[int, int, int]]] = {k: [] for k in self.widths}
        for w, hashes in enumerate(self.of_window):
            k = min(self.shingle, int(self.length[w]))
            which = np.searchsorted(self.shingles[k], hashes)
            rarity = counts[k][which]
            offset = int(rarity.argmin())
            if rarity[offset]:
                chosen[k].append((int(which[offset]), offset, w))
        prefixes = {}
        for k, found in chosen.items():
            if found:
                table = np.array(sorted(found), np.int64)
                which, first = np.unique(table[:, 0], return_index=True)
                prefixes[k] = (self.shingles[k][which], np.append(first, len(table)), table[:, 1], table[:, 2])
        return Prefixes(self, prefixes)


@dataclass(frozen=True)
class Prefixes:
    """Per width: the hashes in use, where the windows of each begin, and offset and number of every window."""

    windows: Windows
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def hits(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where texts start among all words, and the verified places as (start, window)."""
        numbers, starts = word_numbers(texts, self.windows.known)
        found = [np.empty((0, 2), np.int64)]
        for width, (hashes, first, offsets, windows) in self.tables.items():
            at, which = self.windows.places(numbers, width, hashes)
            many = first[which + 1] - first[which]
            # Candidates of some places at a time: a prefix can stand for many windows.
            cuts = np.searchsorted(np.cumsum(many), np.arange(CHUNK, many.sum(), CHUNK))
            cuts = np.unique(np.concatenate([[0], cuts, [len(at)]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = np.repeat(first[which[a:b]], many[a:b]) + _within(many[a:b])
                found.append(self._verified(numbers, starts, np.repeat(at[a:b], many[a:b]) - offsets[rows], windows[rows]))
        both = np.concatenate(found)
        return starts, both[:, 0], both[:, 1]

    def _verified(self, numbers: np.ndarray, starts: np.ndarray, start: np.ndarray, window: np.ndarray) -> np.ndarray:
        length = self.windows.length[window]
        # Position and length: the window must lie between the ends of the document that holds its prefix.
        doc = np.searchsorted(starts, start, "right") - 1
        fits = (start >= 0) & (doc >= 0)
        fits[fits] = start[fits] + length[fits] < starts[doc[fits] + 1]
        start, window, length = start[fits], window[fits], length[fits]
        kept = []
        for n in np.unique(length):
            mine = np.flatnonzero(length == n)
            for i in range(0, len(mine), max(CHUNK // int(n), 1)):
                part = mine[i : i + max(CHUNK // int(n), 1)]
                asked, row = np.unique(window[part], return_inverse=True)
                wanted = np.stack([self.windows.words[w] for w in asked])
                same = (numbers[start[part][:, None] + np.arange(n)] == wanted[row]).all(axis=1)
                kept.append(np.stack([start[part][same], window[part][same]], axis=1))
        return np.concatenate(kept) if kept else np.empty((0, 2), np.int64)

    def scan(self, texts: Sequence[bytes | None]) -> Iterator[tuple[int, list[dict[str, int]], list[str | None]]]:
        """(number of words, spans of hit words, items) of each text."""
        starts, start, window = self.hits(texts)
        step = np.zeros(int(starts[-1]) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + self.windows.length[window], -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(step) > 0])))
        spans = edge.reshape(-1, 2)
        span_doc = np.searchsorted(starts, spans[:, 0], "right") - 1
        pairs = np.unique(np.stack([np.searchsorted(starts, start, "right") - 1, window], axis=1), axis=0)
        for d in range(len(starts) - 1):
            a, b = np.searchsorted(span_doc, [d, d + 1])
            if a == b:
                yield int(starts[d + 1] - starts[d] - 1), [], []
                continue
            mine = pairs[slice(*np.searchsorted(pairs[:, 0], [d, d + 1])), 1]
            named = np.unique(np.concatenate([self.windows.items_of[w] for w in mine]))
            yield (int(starts[d + 1] - starts[d] - 1), [{"start": int(x - starts[d]), "end": int(y - starts[d])} for x, y in spans[a:b]],
                   [self.windows.items[i] for i in named])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _counted(windows: Callable[[], Windows]) -> Callable[[Batches], Batches]:
    def run(source: Batches) -> Batches:
        block, totals = windows(), {}
        for batch in source:
            for k, n in block.count(batch["_text"].to_pylist()).items():
                totals[k] = totals.get(k, 0) + n
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["width", "which", "n"])
    return run


def _scanned(prefixes: Callable[[], Prefixes]) -> Callable[[Batches], Batches]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(source: Batches) -> Batches:
        block = prefixes()
        for batch in source:
            rows = list(block.scan(batch["_text"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch["_key"], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], spans), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                ["_key", "n_words", "spans", "items"])
    return run


def _scan_block(rows: DataFrame, pairs: Sequence[tuple[str | None, Sequence[str]]], shingle: int) -> DataFrame:
    """(_key, n_words, spans, items) of all rows for one block of windows."""
    sc = rows.sparkSession.sparkContext
    windows = Windows(pairs, shingle)
    sent = sc.broadcast(windows)
    counts = {k: np.zeros(len(h), np.int64) for k, h in windows.shingles.items()}
    tally = rows.mapInArrow(_counted(lambda: sent.value), "width bigint, which bigint, n bigint").groupBy("width", "which").agg(F.sum("n").alias("n"))
    for r in tally.collect():  # one row per shingle of the block at most
        counts[r["width"]][r["which"]] = r["n"]
    prefixes = sc.broadcast(windows.with_prefixes(counts))
    return rows.mapInArrow(_scanned(lambda: prefixes.value), f"_key {rows.schema['_key'].dataType.simpleString()}, n_words bigint, spans {SPANS}, items array<string>")


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans of a sorted list as one."""
    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, F.array().cast(SPANS), add)


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = 10, shingle: int = 5,
) -> DataFrame:
    """(key, n_words, n_hit, spans, items) of every row: the words inside any window of an item, and the items whose windows occur.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z; spans count words from 0,
    ends excluded, and neither overlap nor touch; items are the ids as strings, sorted, null last. An
    item of fewer words than ``window`` is one window. Null and empty texts have no words, and an item
    without words occurs nowhere. Rows of one item id, null included, are one item; rows of documents
    are judged one by one, whatever their keys. Other columns are not looked at.
    """
    pairs = with_positions(item_windows(items, item_key, item_text, window), [], ["words", F.col("item").asc_nulls_last()], "_p")
    placed = stage(pairs.withColumn("_block", F.floor(F.col("_p") / BLOCK)))
    blocks = placed.agg(F.coalesce(F.max("_block") + 1, F.lit(0))).first()[0]

    def block(b: int) -> list[tuple[str | None, Sequence[str]]]:
        return [(r["item"], r["words"]) for r in placed.where(F.col("_block") == b).select("item", "words").toLocalIterator()]

    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    if blocks <= 1:
        found = _scan_block(rows, block(0) if blocks else [], shingle)
        return found.select(F.col("_key").alias(key), "n_words", n_hit, "spans", "items")
    named = stage(numbered(docs, key, text)[0])
    rows = named.select(F.col("_id").alias("_key"), F.col("_text").cast("binary").alias("_text"))
    # Block after block is written down; each but the first leaves only the rows it hits.
    parts = stage(_scan_block(rows, block(0), shingle))
    for b in range(1, blocks):
        parts = parts.unionByName(stage(_scan_block(rows, block(b), shingle).where(F.size("spans") > 0)))
    whole = parts.groupBy("_key").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = whole.select(F.col("_key").alias("_id"), "n_words", _merged(F.col("spans")).alias("spans"), "items")
    return named.select("_id", "_key").join(found, "_id").select(F.col("_key").alias(key), "n_words", n_hit, "spans", "items")


CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {folded_sql('text')} AS w FROM documents),
b AS (SELECT item_id, {folded_sql('text')} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS words, least(len(w), 10) AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS words
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (words, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
