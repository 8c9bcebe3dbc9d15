"""String expressions: category-name cleaning (P14), vector text parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(col) -> Column:
    """Make a category usable as a column name.

    ``/`` and ``-`` become blanks, ``(``, ``)`` and ``.`` are removed, runs of
    blanks collapse to one and the result is trimmed.
    """
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"[/\-]", " ")
    c = F.regexp_replace(c, r"[().]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def parse_vector_text(col) -> Column:
    """``'[0.1, 0.2]'`` -> array<double> (brackets stripped, comma split)."""
    c = F.col(col) if isinstance(col, str) else col
    body = F.regexp_replace(c, r"[\[\]\s]", "")
    return F.when(body == "", F.array().cast("array<double>")).otherwise(
        F.split(body, ",").cast("array<double>"))


def vector_text(col) -> Column:
    """Inverse of :func:`parse_vector_text` for array columns (CSV-safe)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ","), F.lit("]"))
