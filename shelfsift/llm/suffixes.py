"""Removal of byte strings that occur earlier in the corpus, by prefix-free parsing.

The texts are parsed into phrases at rolling-hash triggers, and the parse is compared by its dictionary -
see :mod:`shelfsift.llm.phrases`. Only suffixes that begin in phrases which repeat, but do not go on alike
everywhere, are put into corpus order, by the names of their first ``length`` bytes made by prefix
doubling; every suffix but the earliest of a name begins with a repeated string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfsift.llm import naming
from shelfsift.llm.phrases import Kind, covered, repeated_windows
from shelfsift.llm.rows import positional, thrifty


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _as_parsed(units: list[np.ndarray], stems: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Every place of an open stem stands in the parse itself."""
    return stems


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of every row.

    Removed is each byte of the UTF-8 text that lies in a string of ``length`` bytes which also begins
    earlier: in a row with a smaller key, or further to the front of the same text. Strings are judged
    on the input; they never cross rows. Null counts as empty; texts shorter than ``length`` stay whole.
    Rows with null or repeated keys come one after the other - see :func:`rows.numbered` - so of equal
    rows the first stays. An empty table gives no rows; only the two named columns are read.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for whole, repeats in zip(batch.column("_text").to_pylist(), batch.column("repeats").to_pylist()):
                gone = covered(repeats, len(whole), length)
                n_bytes.append(len(whole))
                n_removed.append(int(gone.sum()))
                n_spans.append(len(naming.runs(gone)) // 2)
                kept.append(_bytes(whole)[~gone].tobytes() if n_removed[-1] else whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
                ["_key", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = repeated_windows(docs, key, text, Kind(length, _bytes, True, _as_parsed)).select("_key", "_text", "repeats")
    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(thrifty(batches), f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return found.withColumnRenamed("_key", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``docs`` with the texts that :func:`remove_repeats` keeps, all other columns as they are.

    A character of which only some bytes are left goes as a whole. Rows stay, even with nothing left.
    """
    plain, names = positional(docs)
    own = names[docs.columns.index(text)]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kept = []
            for whole, repeats in zip(batch.column("_text").to_pylist(), batch.column("repeats").to_pylist()):
                gone = covered(repeats, len(whole), length)
                kept.append(_bytes(whole)[~gone].tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if n == own else batch.column(n) for n in names], names)

    others = [n for n in names if n != own]
    rows = repeated_windows(plain, names[docs.columns.index(key)], own, Kind(length, _bytes, True, _as_parsed), others).select("_text", "repeats", *others)
    return rows.mapInArrow(thrifty(batches), plain.schema).toDF(*docs.columns)
