"""JSON-lines text to an array of typed items, as one JVM-side expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.fixed_values import LINE_BREAK_PATTERN
from plumbline.functions.answers import is_sealed, sealed
from plumbline.functions.text import clean, strip

REQUIRED_KEYS = ("type", "sentence", "severity")


def json_items(text: Column) -> Column:
    """The JSON objects among the lines of ``text`` that have the required keys.

    Blank lines, malformed lines and values that are no object are left out; a
    required key may hold null. Result: ``ARRAY<STRUCT<id, label, type,
    sentence, severity, rationale>>`` in line order. Works within a row, so
    numbering the items needs no shuffle.
    """
    stripped = F.transform(F.split(clean(text), LINE_BREAK_PATTERN), strip)
    # only an object can pass, and an object starts with a brace
    candidates = F.filter(stripped, lambda line: line.startswith("{"))
    parsed = F.transform(candidates, _parse)
    kept = F.filter(
        parsed,
        lambda p: is_sealed(p["json"], p["mark"]) & _has_required_keys(p["json"]),
    )
    return F.transform(kept, lambda p: _typed(p["json"]))


def _parse(line: Column) -> Column:
    json, mark = sealed(line)
    return F.struct(json.alias("json"), mark.alias("mark"))


def _has_required_keys(json: Column) -> Column:
    # a member that is JSON null is a variant, a missing one is SQL NULL
    present = [
        F.try_variant_get(json, f"$[0].{key}", "variant").isNotNull()
        for key in REQUIRED_KEYS
    ]
    return present[0] & present[1] & present[2]


def _typed(json: Column) -> Column:
    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(json, f"$[0].{name}", kind).alias(name)

    return F.struct(
        field("id", "int"),
        field("label", "string"),
        field("type", "string"),
        field("sentence", "string"),
        field("severity", "int"),
        # a missing rationale is the empty text, a null one stays null
        F.when(
            F.try_variant_get(json, "$[0].rationale", "variant").isNull(), F.lit("")
        )
        .otherwise(F.try_variant_get(json, "$[0].rationale", "string"))
        .alias("rationale"),
    )
