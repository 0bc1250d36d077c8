"""Column helpers for the scalar vocabulary of the toolkit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MIN_PAGE_TEXT, TRUE_WORDS


def is_true_word(c: Column) -> Column:
    return F.lower(c).isin(*TRUE_WORDS)


def to_strict_timestamp(c: Column) -> Column:
    """Timestamp or null; callers decide whether a null is an error."""
    return F.try_to_timestamp(c)


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_datetime(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def factor_key(*columns: Column) -> Column:
    """Factor values joined into one group key."""
    return F.concat_ws(" | ", *[c.cast("string") for c in columns])


def safe_name(c: Column) -> Column:
    """Name with everything outside letters, digits and underscore replaced."""
    return F.regexp_replace(c, "[^0-9a-zA-Z_]", "_")


def needs_ocr(text: Column, minimum: int = MIN_PAGE_TEXT) -> Column:
    """A page whose trimmed text layer is too short to be trusted."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < minimum


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
