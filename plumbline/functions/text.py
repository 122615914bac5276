"""Text columns: cleaning, blank test, word count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.fixed_values import WHITESPACE, WORD_LIMIT, WORD_PATTERN


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean(text: Column) -> Column:
    """The value as text; a missing value becomes the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def is_blank(text: Column) -> Column:
    """True for a missing, empty or white-space-only value."""
    return strip(clean(text)) == ""


def folded(value: Column) -> Column:
    """Text form used to compare labels: stripped, lower case."""
    return F.lower(strip(value.cast("string")))


def word_count(text: Column) -> Column:
    """Number of white-space-separated words; null for a null text."""
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def over_word_limit(words: Column, limit: int = WORD_LIMIT) -> Column:
    return words > F.lit(limit)
