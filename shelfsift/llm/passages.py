"""Removal of word passages that an earlier document holds, by repeated-phrase automata.

Phrases that several documents hold are confirmed by the dictionary of :mod:`shelfsift.llm.phrases`. Each
shard - a batch of documents - compiles the open phrases of its own documents into one Aho-Corasick
automaton, whose size is bounded by the shard's, and streams the documents through it to locate every
occurrence, wherever the phrase was cut from. Windows around the places found are then judged exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from shelfsift.llm import naming
from shelfsift.llm.phrases import Kind, covered, repeated_windows

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FIRST_SURROGATE, SURROGATES, CODE_POINTS = 0xD800, 0x800, 0x110000
PIECE = 1 << 20  # bytes whose words are hashed at once
LONG = 32


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    ones = np.ones(PIECE + 1, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = naming.ODD, pow(naming.ODD, -1, 2**64)
    return np.cumprod(up), np.cumprod(down)


UP, DOWN = _powers()


def _word_edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = naming.runs(~SPACE[text])
    return edges[0::2].astype(np.int64), edges[1::2].astype(np.int64)


def word_numbers(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: the polynomial of its bytes, as a difference of prefix sums, and its length.

    Modulo a power of two the polynomials of long words can agree by their structure alone, whatever the
    factor; so words longer than ``LONG`` bytes are hashed by XXH64.
    """
    units = np.frombuffer(text, np.uint8)
    starts, ends = _word_edges(units)
    out, low = np.zeros(len(starts), np.uint64), 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE, "right")))
        base, stop = int(starts[low]), int(ends[high - 1])
        if stop - base <= PIECE:  # else: one word longer than a piece
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(naming.SYMBOLS[units[base:stop]] * DOWN[: stop - base], out=sums[1:])
            a, b = starts[low:high] - base, ends[low:high] - base
            out[low:high] = (sums[b] - sums[a]) * UP[a]
        low = high
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxh64_intdigest(units[starts[i] : ends[i]].data)
    return naming.joined(out, (ends - starts).astype(np.uint64))


def _letters(numbers: np.ndarray, known: np.ndarray) -> str:
    """Words as one code point each: their rank among ``known``, past the surrogates."""
    ranks = np.searchsorted(known, numbers) + 1
    ranks[ranks >= FIRST_SURROGATE] += SURROGATES
    return ranks.astype("<u4").tobytes().decode("utf-32-le")


def locate(words: list[np.ndarray], stems: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The places in each text at which any of the stems of these texts stands."""
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    if len(known) >= CODE_POINTS - SURROGATES:
        return stems  # more different words than code points; the dictionary has named the places where phrases are cut
    texts = [_letters(w, known) for w in words]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for text, places in zip(texts, stems):
        for at in places.tolist():
            automaton.add_word(text[at : at + length])
    if not len(automaton):
        return [np.zeros(0, np.int64) for _ in words]
    automaton.make_automaton()
    return [np.array([end - length + 1 for end, _ in automaton.iter(text)], np.int64) for text in texts]


def kind(window: int = 50) -> Kind:
    return Kind(window, word_numbers, False, locate)


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row: the words left, joined by one space.

    Removed is each word in a window of ``window`` words whose sequence also starts in a row with a
    smaller key; windows are judged on the input. Words are what ASCII white space separates,
    unchanged. A repetition inside one row alone stays. Null counts as empty; rows with null or
    repeated keys come one after the other - see :func:`rows.numbered` - so of equal rows the first
    stays. An empty table gives no rows; only the two named columns are read.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n_words, n_removed, kept = [], [], []
            for whole, repeats in zip(batch.column("_text").to_pylist(), batch.column("repeats").to_pylist()):
                words = whole.split()
                gone = covered(repeats, len(words), window)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["_key", "n_words", "n_removed", "kept"])

    rows = repeated_windows(docs, key, text, kind(window)).select("_key", "_text", "repeats")
    of_key = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(batches, f"_key {of_key}, n_words long, n_removed long, kept string").withColumnRenamed("_key", key)
