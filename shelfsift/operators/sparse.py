"""Labelled rows as (row number, label, cell, places, values): the shape that boosting and neighbour search work on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def filled(features: str) -> tuple[Column, Column]:
    """Places and values of a vector's entries other than 0; all entries of a dense one have a place."""
    parts = F.unwrap_udt(features)
    at = F.coalesce(parts["indices"], F.transform(parts["values"], lambda _, i: i))
    kept = F.filter(F.arrays_zip(at.alias("at"), parts["values"].alias("x")), lambda e: e["x"] != 0)
    return F.transform(kept, lambda e: e["at"]), F.transform(kept, lambda e: e["x"])


def value_at(features: str, place: Column) -> Column:
    """The vector's value at one place, 0 where it has none."""
    parts = F.unwrap_udt(features)
    found = F.array_position(parts["indices"], place.cast("int")).cast("int") - 1
    return F.coalesce(F.when(parts["indices"].isNull(), F.get(parts["values"], place)).otherwise(F.get(parts["values"], found)), F.lit(0.0))


def sparse_rows(df: DataFrame, features: str, label: Column | None = None, cell: Column | None = None, *keep: str) -> DataFrame:
    at, x = filled(features)
    return df.select(
        *keep, (F.lit(0.0) if label is None else label.cast("double")).alias("_label"),
        (F.lit(0) if cell is None else cell.cast("int")).alias("_cell"), at.alias("_at"), x.alias("_x"))


@dataclass(frozen=True)
class Packed:
    """The rows of a batch: entry j of row i is at[first[i] + j]."""

    label: np.ndarray
    cell: np.ndarray
    first: np.ndarray
    at: np.ndarray
    x: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.label)), np.diff(self.first))

    def columns(self, places: np.ndarray) -> np.ndarray:
        """The values at some sorted places, as a small dense matrix."""
        out = np.zeros((len(self.label), len(places)))
        if len(places):
            found = np.minimum(np.searchsorted(places, self.at), len(places) - 1)
            hit = places[found] == self.at
            out[self.row[hit], found[hit]] = self.x[hit]
        return out


def packed(batch: pa.RecordBatch) -> Packed:
    at, x = batch["_at"], batch["_x"]
    first = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())]).astype(np.int64)
    return Packed(batch["_label"].to_numpy(), batch["_cell"].to_numpy(), first, at.flatten().to_numpy(), x.flatten().to_numpy())


def hashed(numbers: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1] that depend on ``numbers`` and ``seed`` alone."""
    x = (numbers.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2**53
