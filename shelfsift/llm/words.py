"""Words of a text: runs of anything but the six ASCII white-space characters; and folded words, without ASCII punctuation and capitals."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import repeat

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time, even where ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words in order; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return once(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


#: A-Z as a-z, digits and all that is not ASCII as they are, anything else as a space.
FOLDED = bytes(i | 32 if 65 <= i <= 90 else i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
SLICE = 4 << 20


def folded_words(text: bytes | None) -> Iterator[list[bytes]]:
    """The maximal runs of digits, letters and non-ASCII characters of a UTF-8 text, A-Z as a-z, some megabytes of text at a time."""
    return sliced_words((text or b"").translate(FOLDED))


def sliced_words(spaced: bytes) -> Iterator[list[bytes]]:
    """What stands between spaces, some megabytes at a time, as each word becomes an object of its own."""
    start = 0
    while start < len(spaced):
        end = spaced.find(b" ", start + SLICE)
        end = len(spaced) if end < 0 else end
        yield spaced[start:end].split()
        start = end


def word_numbers(texts: Iterable[bytes | None], known: Mapping[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the folded words of all texts, 0 if not ``known``, with one 0 after each text; and where each text starts, with the end."""
    parts, starts, at, gap = [], [0], 0, np.zeros(1, np.int32)
    for text in texts:
        for words in folded_words(text):
            parts.append(np.fromiter(map(known.get, words, repeat(0)), np.int32, len(words)))
            at += len(words)
        parts.append(gap)
        at += 1
        starts.append(at)
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(starts, np.int64)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded_column(text: Column) -> Column:
    """The same words as a column expression; an empty array for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({FOLDED_WORD})"), F.lit(1))


def folded_sql(text: str) -> str:
    """The same words in DuckDB's SQL."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{FOLDED_WORD}')"
