"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(c: Column | str) -> Column:
    return _as_column(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(c), F.lit(0.0), lambda total, x: total + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null when one side is all zeros."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def l2(c: Column | str) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    length = norm(c)
    return F.transform(F.array(length), lambda n: F.transform(as_doubles(c), lambda x: F.when(n > 0, x / n).otherwise(x))).getItem(0)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x - y)
