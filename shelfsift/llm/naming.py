"""Names of fixed-length windows, and where each name occurs first.

A name is a 64-bit hash of a window's content, made by doubling: windows of length 2k are named by the
names of their halves, as prefix doubling names the prefixes of suffixes. Equal windows have equal
names; the order of the names stands in for the order of the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ODD = 0x9E3779B97F4A7C15
FIRST, SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
SPREAD = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> SPREAD)
    x *= SECOND
    x ^= x >> SPREAD
    return x


def symbol_names(n: int) -> np.ndarray:
    """A number for each of ``n`` symbols."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(ODD))


SYMBOLS = symbol_names(256)


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """The polynomial rolling hash of the window of ``length`` (a power of two) values from each place on."""
    hashes, base, width = values, ODD, 1
    while width < length:
        doubled = hashes * np.uint64(base)
        doubled[:-width] += hashes[width:]
        hashes, base, width = doubled, base * base % 2**64, 2 * width
    return hashes


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * FIRST + right)


def doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of windows twice as long as ``width``."""
    out = names * FIRST
    out[:-width] += names[width:]
    return mix(out)


def sliding(values: np.ndarray, width: int, best: Callable, forward: bool) -> np.ndarray:
    """``best`` (np.minimum, np.maximum) of the ``width`` values from each place on, or up to it."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if forward:
            out[:-step] = best(out[:-step], out[step:])
        else:
            out[step:] = best(out[step:], out[:-step].copy())
        have += step
    return out


def pack(names: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that has names: the columns of its entries as bytes."""
    if not len(names):
        return
    bucket = ((names >> SPREAD) * np.uint64(buckets) >> SPREAD).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    sorted_columns = {c: v[order] for c, v in {"names": names, **columns}.items()}
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[edges[:-1]], pa.int32()), *(pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for v in sorted_columns.values())],
        ["bucket", *sorted_columns])


def unpack(table: pa.Table, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), kind) for c, kind in kinds.items()}


PER_ID = "_id long, codes array<int>"


def per_id(ids: np.ndarray, codes: np.ndarray) -> pa.Table:
    """(_id, codes): the codes of each id in one row."""
    order = np.lexsort((codes, ids))
    ids, codes = ids[order], codes[order]
    edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([edges, [len(ids)]]), pa.int32()), pa.array(codes, pa.int32()))
    return pa.table({"_id": pa.array(ids[edges], pa.int64()), "codes": lists})


def gathered(lists: DataFrame) -> DataFrame:
    """One row per id from rows of :func:`per_id`."""
    return lists.groupBy("_id").agg(F.flatten(F.collect_list("codes")).alias("codes"))


def runs(mask: np.ndarray) -> np.ndarray:
    """Start and end of each run of true values, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).astype(np.int32)


def mask_of(spans, n: int) -> np.ndarray:
    """The places below ``n`` that the (start, end) pairs in a flat list cover."""
    steps = np.zeros(n + 1, np.int64)
    pairs = np.asarray(spans, np.int64).reshape(-1, 2).clip(0, n)
    np.add.at(steps, pairs[:, 0], 1)
    np.add.at(steps, pairs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0
