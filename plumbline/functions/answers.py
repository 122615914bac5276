"""From a model's free-text answer to typed values, as JVM-side expressions.

The answers come as text that should hold one JSON object, but may be wrapped in
prose, cut short, or use the wrong types. Everything here is built on VARIANT.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.fixed_values import NEGATIVE, NEGATIVE_WORDS, POSITIVE, POSITIVE_WORDS
from plumbline.functions.text import folded, strip

# What Python's int() reads from text: digits, a sign, single underscores inside.
INTEGER_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*\z"


def object_text(answer: Column) -> Column:
    """The part of an answer that should be a JSON object, or null.

    An answer that starts with a brace stands as a whole; otherwise the part
    from its first opening to its last closing brace is taken.
    """
    text = strip(answer)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.startswith(text, F.lit("{")), text).otherwise(F.nullif(inner, F.lit("")))


def sealed(text: Column) -> tuple[Column, Column]:
    """``text`` put in a JSON list before a mark, parsed; and that mark.

    ``try_parse_json`` ignores whatever follows a complete value. With the mark
    as second list element, it is found in its place only when ``text`` was
    exactly one value. The mark is a hash of the text, so the text cannot hold it.
    """
    mark = F.xxhash64(text).cast("string")
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return parsed, mark


def is_sealed(parsed: Column, mark: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(parsed, "$[1]", "string") == mark, F.lit(False)
    )


@dataclass(frozen=True)
class Value:
    """A JSON value by three columns: its kind, its text, and its number if it is one."""

    kind: Column
    text: Column
    number: Column

    @property
    def is_text(self) -> Column:
        return self.kind == "STRING"


def member(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "variant")


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def number_of(kind: Column, text: Column) -> Column:
    """A JSON number as double; null for other kinds. True and false count as 1 and 0."""
    number = F.when(kind == "BOOLEAN", (text == "true").cast("double")).when(
        (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
        text.try_cast("double"),
    )
    # a number beyond double range is none
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def integer_of(value: Value) -> Column:
    """The number Python's int() makes of the value, not yet cut, as double.

    Numbers stand as they are (the caller truncates); text counts when it
    spells an integer, so "2" does and "2.0" does not.
    """
    text = strip(value.text)
    digits = F.when(
        value.is_text & text.rlike(INTEGER_TEXT), F.replace(text, F.lit("_"), F.lit(""))
    )
    return F.coalesce(value.number, digits.try_cast("double"))


def diagnosis(value: Value) -> Column:
    """One of the two labels, or null when the value names neither."""
    word = folded(value.text)
    # int() truncates towards zero: 1.9 counts as 1
    is_one = (value.number >= 1) & (value.number < 2)
    return F.when(
        value.number.isNotNull(), F.when(is_one, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))
    ).when(
        value.is_text,
        F.when(word.isin(*POSITIVE_WORDS), F.lit(POSITIVE)).when(
            word.isin(*NEGATIVE_WORDS), F.lit(NEGATIVE)
        ),
    )


def severity(number: Column, label: Column) -> Column:
    """1, 2 or 3 for a positive label, otherwise null."""
    return F.when(
        (label == POSITIVE) & (number >= 1) & (number < 4), F.floor(number).cast("int")
    )


def confidence(number: Column) -> Column:
    """Cut to 0..100; null, not 100, when there is no number."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), number))
    return F.when(number.isNotNull(), clamped.cast("int"))


def reasoning(first: Value, second: Value) -> Column:
    """The first value unless it is falsy, else the second; texts only.

    Falsy are a missing value, null, "", zero, false, an empty list or object.
    """
    falsy = (
        first.kind.isNull()
        | (first.kind == "VOID")
        | (first.is_text & (first.text == ""))
        | (first.number == 0)
        | (~first.is_text & first.text.isin("[]", "{}"))
    )
    return F.when(falsy, F.when(second.is_text, second.text)).otherwise(
        F.when(first.is_text, first.text)
    )
