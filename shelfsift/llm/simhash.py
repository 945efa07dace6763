"""SimHash near-duplicates: tiles of fingerprints compared exactly, bit by bit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from shelfsift.llm.rows import numbered, positional, thrifty
from shelfsift.operators.components import connected_components
from shelfsift.session import stage

SEED = 42
TILE = 4096
BLOCK = 1 << 20  # pairs compared at once
BROADCAST_ROWS = 1_000_000  # of 16 bytes each


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the hashes of all shingles, repeats included, as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - width] + 1])
    hashes = np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)
    set_bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fingerprint long) of every row: A-Z lower-cased, words at ASCII white space, XXH64 of joined shingles."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), found], ["key", "fingerprint"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("fingerprint", T.LongType())])
    return slim.mapInArrow(thrifty(batches), schema).select(F.col("key").alias(key), "fingerprint")


def _parts(radius: int) -> int:
    """Into how many parts fingerprints are cut for the counts that place them."""
    return 4 if radius <= 3 else 2 if radius <= 8 else 1


def _counts(value: Column, parts: int) -> list[Column]:
    width = 64 // parts
    mask = F.lit((1 << width) - 1 if width < 64 else -1)
    return [F.bit_count(F.shiftrightunsigned(value, width * i).bitwiseAND(mask)) for i in range(parts)]


def _cell(counts: list[Column]) -> Column:
    return sum((c * 65**i for i, c in enumerate(counts)), F.lit(0)).cast("int")


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the links between the fingerprints of two tiles, a star per component: (fingerprint, centre)."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b = place[: len(a)], place[len(a) :]
    left, right = [], []
    step = max(1, BLOCK // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        x, y = at_a[x + i], at_b[y]
        left.append(x[x != y])
        right.append(y[x != y])
    left, right = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between different fingerprints of ``distinct`` at ``radius`` or fewer bits, up to connectivity.

    Fingerprints are placed by the population counts of their parts. Two within the radius differ by
    no more than it in the sum of the counts' differences, so a tile meets only the tiles of cells that
    near; all other pairs of tiles are skipped. Cells of any size are cut into tiles of a bounded size,
    and every pair of tiles is one row of work that leaves at most one link per fingerprint.
    """
    parts = _parts(radius)
    placed = distinct.select("fingerprint", *[c.alias(f"_n{i}") for i, c in enumerate(_counts(F.col("fingerprint"), parts))])
    placed = placed.withColumn("_cell", _cell([F.col(f"_n{i}") for i in range(parts)]))
    sizes = placed.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_tiles"))
    # At most 17 ** 4 cells.
    tiled = placed.join(F.broadcast(sizes), "_cell").withColumn("_tile", F.pmod(F.xxhash64("fingerprint"), F.col("_tiles")))
    counts = [f"_n{i}" for i in range(parts)]
    tiles = stage(tiled.groupBy("_cell", "_tile", *counts).agg(F.collect_list("fingerprint").alias("_own")))

    # Of two cells that are near, the one whose first differing count is higher is visited.
    steps = [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius and s >= (0,) * parts]
    width = 64 // parts
    visits = F.filter(
        F.array(*[F.struct(_cell([F.col(c) + d for c, d in zip(counts, s)]).alias("cell"), F.forall(F.array(*[F.col(c) + d for c, d in zip(counts, s)]), lambda n: (n >= 0) & (n <= width)).alias("real")) for s in steps]),
        lambda v: v["real"])
    guests = tiles.select(F.col("_cell").alias("_from"), F.col("_tile").alias("_guest_tile"), F.col("_own").alias("_guest"), F.explode(visits).alias("_v")).select(
        "_from", "_guest_tile", "_guest", F.col("_v.cell").alias("_cell"))
    pairs = tiles.select("_cell", "_tile", "_own").join(guests, "_cell").where("_cell != _from OR _tile <= _guest_tile").select("_own", "_guest")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = []
            for own, guest in zip(batch.column("_own"), batch.column("_guest")):
                a, b = (x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (own, guest))
                found.append(_linked(a, b, radius))
            if found:
                a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.mapInArrow(batches, "a long, b long").distinct()


def _rooted(placed: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fingerprint, component, _least) per fingerprint: its component's smallest fingerprint, and ``least`` over its rows."""
    distinct = stage(placed.groupBy("fingerprint").agg(least.alias("_least")))
    groups = connected_components(distinct, links(distinct, radius), "fingerprint", "a", "b")
    return groups.join(distinct, "fingerprint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(key, fingerprint long, component_id): rows whose fingerprints are linked, directly or over others, share a component.

    A component is named by its smallest key. Rows without words have fingerprint 0 and are linked
    like any other; equal texts meet as one fingerprint, so copies cost no pairs. Null keys are kept
    in their component but never name it, unless all its keys are null. So components of unrelated
    texts share a name where keys are null or repeated. An empty table gives no rows.
    """
    placed = stage(fingerprints(docs, key, text, shingle).withColumnRenamed(key, "_key"))
    named = _rooted(placed, F.min("_key"), radius)
    names = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    # Fingerprints alone in their component keep their own smallest key.
    of = stage(named.join(names, "component").select("fingerprint", "component_id"))
    return placed.join(_bounded(of), "fingerprint").select(F.col("_key").alias(key), "fingerprint", "component_id")


def _bounded(staged: DataFrame) -> DataFrame:
    """Hint a broadcast of a slim staged table if its rows have been counted and are few enough."""
    return F.broadcast(staged) if staged.count() <= BROADCAST_ROWS else staged


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The row with the smallest key of each component, with all its columns.

    Exactly one row of each component stays, whatever rows of other components have the same key; of
    rows with the smallest key that which ``numbered`` puts first, and a row with a null key only if all
    keys of its component are null.
    """
    plain, names = positional(docs)
    rows, _ = numbered(plain, names[docs.columns.index(key)], names[docs.columns.index(text)], names)
    # Numbers follow the order of the keys, nulls last.
    placed = stage(fingerprints(rows, "_id", "_text", shingle))
    firsts = _rooted(placed, F.min("_id"), radius).groupBy("component").agg(F.min("_least").alias("_id"))
    kept = rows.join(_bounded(stage(firsts.select("_id"))), "_id", "left_semi")
    return kept.select(*names).toDF(*docs.columns)
