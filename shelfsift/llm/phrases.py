"""Repeated windows of a corpus, by content-cut phrases.

A rolling hash over the units of each text (bytes, words) sets triggers: the places whose hash is the least
of some ``gap`` neighbouring ones. They cut the text into phrases, and equal stretches of text are cut
alike: any window of the wanted length holds a trigger among its first ``gap`` units that every other
occurrence has as well. So two occurrences share that trigger's *stem*, the units that follow it.

The dictionary holds one entry per phrase: its stem, and its *context* - all windows that have the trigger
among their first ``gap`` units. Where a whole context has come earlier, all its windows have, and nothing
more is to be done there: that is most of what repeats. Stems that never repeat need nothing either. Only
the windows around stems that go on in different ways are left; they are named - see
:mod:`shelfsift.llm.naming` - and all but the earliest of a name are repeats.

Each step ships a key at most once per batch of texts, so a phrase that a third of all texts hold costs
a bucket no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm import naming
from shelfsift.llm.rows import numbered, settled, thrifty, with_slim

SLICE = 128 << 10  # units hashed at once, for the processor's caches
BATCH = 8 << 20  # bytes whose entries are combined before they are shipped
BUCKET = 8 << 20  # bytes of text per bucket


@dataclass(frozen=True)
class Kind:
    """What is sought. ``units`` gives the numbers of a text's units; ``own``: an earlier place in the same text counts.

    ``locate`` gets the units of some texts and the places of their open stems, and gives the places at
    which these stems stand.
    """

    length: int
    units: Callable[[bytes], np.ndarray]
    own: bool
    locate: Callable[[list[np.ndarray], list[np.ndarray], int], list[np.ndarray]]

    def __post_init__(self):
        if self.length < 16:
            raise ValueError("length must be at least 16")

    @property
    def gap(self) -> int:
        return self.length * 64 // 100

    @property
    def trigger(self) -> int:
        return 1 << int(math.log2(min(16, self.length // 4)))

    @property
    def stem(self) -> int:
        return self.length - self.gap + 1

    @property
    def pad(self) -> int:
        return self.length + self.gap + self.trigger


class Slice:
    """Some stretches of texts side by side, apart by zeros, with the names of their windows."""

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]], kind: Kind):
        """``pieces``: (number of the text, offset in it, units)."""
        lengths = np.array([len(u) for _, _, u in pieces])
        self.starts = np.cumsum(np.concatenate([[kind.pad], lengths[:-1] + kind.pad]))
        self.lengths, self.kind = lengths, kind
        units = np.zeros(int(self.starts[-1] + lengths[-1] + kind.pad), np.uint64)
        self.owner = np.zeros(len(units), np.int32)
        for i, ((_, _, u), at) in enumerate(zip(pieces, self.starts.tolist())):
            units[at : at + len(u)] = naming.SYMBOLS[u] if u.dtype == np.uint8 else u
            self.owner[at - kind.pad : at + len(u) + kind.pad] = i
        self.offset = np.arange(len(units)) - self.starts[self.owner]
        width = kind.trigger
        self.names = {width: naming.mix(naming.rolling(units, width))}
        while 2 * width <= kind.length:
            self.names[2 * width] = naming.doubled(self.names[width], width)
            width *= 2

    def name(self, places: np.ndarray, length: int) -> np.ndarray:
        """Names of the windows of ``length`` units from ``places`` on."""
        width = max(w for w in self.names if w <= length)
        return naming.joined(self.names[width][places], self.names[width][places + length - width])

    def triggers(self) -> np.ndarray:
        k, n = self.kind, self.lengths[self.owner]
        inside = (self.offset >= 0) & (self.offset <= n - k.trigger)
        order = np.where(inside, self.names[k.trigger], np.uint64(2**64 - 1))
        least = naming.sliding(order, k.gap, np.minimum, True)
        least[(self.offset < 0) | (self.offset > n - k.trigger + 1 - k.gap)] = 0
        chosen = naming.sliding(least, k.gap, np.maximum, False) == order
        return np.flatnonzero(chosen & inside & (self.offset + k.stem <= n))


def _slices(texts: list[tuple[int, np.ndarray]], kind: Kind) -> Iterator[tuple[list[tuple[int, int, np.ndarray]], list[tuple[int, int]]]]:
    """Pieces of about SLICE bytes with the part of each that counts; longer texts are cut with an overlap."""
    pieces, parts, held = [], [], 0
    for number, b in texts:
        for at in range(0, len(b), SLICE):
            low = max(0, at - kind.pad)
            # A text's true end must be an end of its piece, and a cut must leave whole contexts.
            pieces.append((number, low, b[low : at + SLICE + kind.pad]))
            parts.append((at - low, min(SLICE, len(b) - at)))
            held += len(pieces[-1][2])
            if held >= SLICE:
                yield pieces, parts
                pieces, parts, held = [], [], 0
    if pieces:
        yield pieces, parts


def _collected(source: Iterator[pa.RecordBatch], most: int) -> Iterator[list[dict]]:
    """Rows of all batches, some ``most`` bytes of text at a time."""
    held, size = [], 0
    for batch in source:
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["_text"])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _entries(rows: list[dict], kind: Kind) -> dict[str, np.ndarray]:
    """Stem, context, id and place of every phrase of some texts."""
    texts = [(i, u) for i, r in enumerate(rows) if len(u := kind.units(r["_text"])) >= kind.length]
    found = {c: [] for c in ("names", "contexts", "owners", "places")}
    for pieces, parts in _slices(texts, kind):
        cut = Slice(pieces, kind)
        at = cut.triggers()
        own, offset = cut.owner[at], cut.offset[at]
        first, count = (np.array([p[i] for p in parts])[own] for i in (0, 1))
        counts = (offset >= first) & (offset < first + count)
        at, own, offset = at[counts], own[counts], offset[counts]
        found["names"].append(cut.name(at, kind.stem))
        found["contexts"].append(naming.joined(cut.name(at - kind.gap + 1, kind.length), cut.name(at, kind.length)))
        found["owners"].append(np.array([p[0] for p in pieces])[own])
        found["places"].append((np.array([p[1] for p in pieces])[own] + offset).astype(np.int32))
    kinds = {"names": np.uint64, "contexts": np.uint64, "owners": np.int64, "places": np.int32}
    out = {c: np.concatenate([np.zeros(0, kinds[c]), *v]).astype(kinds[c], copy=False) for c, v in found.items()}
    out["ids"] = np.array([r["_id"] for r in rows], np.int64)[out.pop("owners")] if rows else np.zeros(0, np.int64)
    return out


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """For sorted columns: where one of them changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


REPEATED, MIXED = 0, 1  # low bit of a code: the whole context came earlier, or the stem goes on in several ways


def _known(ids: np.ndarray, codes: np.ndarray, bucket: int) -> pa.RecordBatch:
    """A row that takes decided entries past the buckets' work."""
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"", b"", ids.tobytes(), codes.astype(np.int32).tobytes(), b""))],
        ["bucket", "names", "contexts", "ids", "places", "several"])


def _phrases(texts: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """(_id, codes): the phrases that need more than their parse, with 2 * place + kind."""

    def parse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _collected(source, BATCH):
            e = _entries(rows, kind)
            order = np.lexsort((e["places"], e["ids"], e["contexts"], e["names"]))
            e = {c: v[order] for c, v in e.items()}
            stems = _first_of_runs(e["names"])
            contexts = _first_of_runs(e["names"], e["contexts"])
            if not len(stems):
                continue
            run = np.cumsum(stems) - 1
            if kind.own:
                repeated = ~contexts
            else:
                repeated = e["ids"] != e["ids"][contexts][np.cumsum(contexts) - 1]
            again = ~contexts & ~repeated  # once more in the text that has it first
            several = ((np.bincount(run, contexts) > 1) | (np.bincount(run, again) > 0))[run]
            mixed = again | (contexts & several)
            decided = repeated | mixed
            yield _known(e["ids"][decided], 2 * e["places"][decided] + mixed[decided], int(rows[0]["_id"]) % buckets)
            # One entry per stem: the earliest of its first context.
            shipped = {c: v[stems] for c, v in e.items()}
            yield from naming.pack(shipped.pop("names"), buckets, {
                "contexts": shipped["contexts"], "ids": shipped["ids"], "places": shipped["places"], "several": several[stems].astype(np.uint8)})

    def settle(table: pa.Table) -> pa.Table:
        decided = table.filter(pc.equal(pc.binary_length(table.column("names")), 0))
        open_ = table.filter(pc.greater(pc.binary_length(table.column("names")), 0))
        known = naming.unpack(decided, {"ids": np.int64, "places": np.int32})
        e = naming.unpack(open_, {"names": np.uint64, "contexts": np.uint64, "ids": np.int64, "places": np.int32, "several": np.uint8})
        order = np.argsort(e["names"], kind="stable")
        names = e["names"][order]
        new = _first_of_runs(names)
        alone = new & np.concatenate([new[1:], [True]]) if len(new) else new
        order = order[~alone]
        e = {c: v[order] for c, v in e.items()}
        order = np.lexsort((e["places"], e["ids"], e["contexts"], e["names"]))
        e = {c: v[order] for c, v in e.items()}
        contexts = _first_of_runs(e["names"], e["contexts"])
        run = np.cumsum(_first_of_runs(e["names"])) - 1
        mixed = (np.bincount(run, contexts) > 1) | (np.bincount(run, e["several"]) > 0) if len(run) else np.zeros(0, bool)
        mixed = mixed[run] & contexts & (e["several"] == 0)
        codes = np.where(mixed, MIXED, REPEATED).astype(np.int32) + 2 * e["places"]
        said = mixed | ~contexts
        return naming.per_id(np.concatenate([known["ids"], e["ids"][said]]), np.concatenate([known["places"], codes[said]]))

    packed = "bucket int, names binary, contexts binary, ids binary, places binary, several binary"
    return texts.mapInArrow(thrifty(parse), packed).groupBy("bucket").applyInArrow(settle, naming.PER_ID)


def _split(codes: DataFrame, kind: Kind) -> DataFrame:
    """(_id, repeated, stems): spans of window starts known to be repeats, and places of open stems."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            repeated, stems = [], []
            for codes_ in batch.column("codes"):
                c = codes_.values.to_numpy()
                at = c[c % 2 == REPEATED] >> 1
                mask = naming.mask_of(np.stack([at - kind.gap + 1, at + 1], 1), int(at.max(initial=-1)) + 1)
                repeated.append(naming.runs(mask))
                stems.append(np.sort(c[c % 2 == MIXED] >> 1))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(v, pa.list_(pa.int32())) for v in (repeated, stems))], ["_id", "repeated", "stems"])

    return codes.mapInArrow(batches, "_id long, repeated array<int>, stems array<int>")


def _window_names(rows: list[dict], kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, id and place of every undecided window of some texts."""
    names, ids, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    units = [kind.units(r["_text"]) for r in rows]
    located = kind.locate(units, [np.array(r["stems"], np.int64) for r in rows], kind.stem)
    for r, u, at in zip(rows, units, located):
        n = len(u) - kind.length + 1
        if n <= 0:
            continue
        starts = np.flatnonzero(naming.mask_of(np.stack([at - kind.gap + 1, at + 1], 1), n) & ~naming.mask_of(r["repeated"], n))
        for low in range(0, n, SLICE):
            own = starts[(starts >= low) & (starts < low + SLICE)]
            if len(own):
                cut = Slice([(0, low, u[low : low + SLICE + kind.length])], kind)
                names.append(cut.name(own - low + cut.starts[0], kind.length))
                ids.append(np.full(len(own), r["_id"], np.int64))
                places.append(own.astype(np.int32))
    return np.concatenate(names), np.concatenate(ids), np.concatenate(places)


def _later(names: np.ndarray, ids: np.ndarray, own: bool) -> np.ndarray:
    """For entries in order: those that are not the first of their name, or not in the first text that has it."""
    first = _first_of_runs(names)
    return ~first if own or not len(names) else ids != ids[first][np.cumsum(first) - 1]


def _repeats(open_: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """(_id, codes): the undecided places at which an earlier window begins again."""

    def order(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _collected(source, BATCH):
            names, ids, places = _window_names(rows, kind)
            if not len(names):
                continue
            by_name = np.lexsort((places, ids, names))
            names, ids, places = names[by_name], ids[by_name], places[by_name]
            later = _later(names, ids, kind.own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(rows[0]["_id"]) % buckets], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"", ids[later].tobytes(), places[later].tobytes()))],
                ["bucket", "names", "ids", "places"])
            yield from naming.pack(names[~later], buckets, {"ids": ids[~later], "places": places[~later]})

    def settle(table: pa.Table) -> pa.Table:
        known = naming.unpack(table.filter(pc.equal(pc.binary_length(table.column("names")), 0)), {"ids": np.int64, "places": np.int32})
        e = naming.unpack(table.filter(pc.greater(pc.binary_length(table.column("names")), 0)), {"names": np.uint64, "ids": np.int64, "places": np.int32})
        by_name = np.lexsort((e["places"], e["ids"], e["names"]))
        e = {c: v[by_name] for c, v in e.items()}
        later = _later(e["names"], e["ids"], kind.own)
        return naming.per_id(np.concatenate([known["ids"], e["ids"][later]]), np.concatenate([known["places"], e["places"][later]]))

    packed = "bucket int, names binary, ids binary, places binary"
    return open_.mapInArrow(thrifty(order), packed).groupBy("bucket").applyInArrow(settle, naming.PER_ID)


def _merged(spans: DataFrame, starts: DataFrame) -> DataFrame:
    """(_id, repeats): all repeated window starts as one flat list of spans."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = []
            for repeated, codes in zip(batch.column("repeated").to_pylist(), batch.column("codes").to_pylist()):
                at = np.asarray(codes or [], np.int64)
                known = np.asarray(repeated or [], np.int64)
                mask = naming.mask_of(known, int(max(at.max(initial=-1) + 1, known.max(initial=0))))
                mask[at] = True
                lists.append(naming.runs(mask))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(lists, pa.list_(pa.int32()))], ["_id", "repeats"])

    return spans.join(starts, "_id", "full").mapInArrow(batches, "_id long, repeats array<int>")


def repeated_windows(docs: DataFrame, key: str, text: str, kind: Kind, rest: Sequence[str] = ()) -> DataFrame:
    """(_id, _key, _text binary, repeats, and the columns of ``rest``) of every row, in the order of :func:`rows.numbered`.

    ``repeats`` is a flat list of spans (start, end) of the places at which a window begins that has
    come earlier; null where there is none. A span may reach beyond the last window of its text.
    """
    named, total = numbered(docs, key, text, rest)
    whole = named.select("_id", "_key", F.coalesce(F.col("_text"), F.lit("")).cast("binary").alias("_text"), *rest)
    texts = whole.where(F.octet_length("_text") >= kind.length).select("_id", "_text")
    buckets = max(32, -(-total // BUCKET))
    split = settled(_split(naming.gathered(_phrases(texts, kind, buckets)), kind))
    open_ = with_slim(texts, split.where(F.size("stems") > 0), "4 * (size(repeated) + size(stems))", "inner")
    starts = naming.gathered(_repeats(open_, kind, buckets))
    found = settled(_merged(split.select("_id", "repeated"), starts))
    return with_slim(whole, found, "4 * size(repeats)", "left")


def covered(repeats: list[int] | None, n: int, length: int) -> np.ndarray:
    """The units of a text of ``n`` that lie in a window which begins in one of the spans."""
    if not repeats or n < length:
        return np.zeros(n, bool)
    spans = np.asarray(repeats, np.int64).reshape(-1, 2).clip(0, n - length + 1)
    spans = spans[spans[:, 0] < spans[:, 1]]
    return naming.mask_of(spans + np.array([0, length - 1]), n)
