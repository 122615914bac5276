"""Prompt text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.text import clean


def fill(template: str, **values: Column | str | int) -> Column:
    """``template`` with each ``{name}`` replaced by a column or a constant.

    Braces around anything that is not a given name are ordinary text, and so
    is whatever the columns hold.
    """
    names = "|".join(map(re.escape, values))
    parts = []
    for index, piece in enumerate(re.split(r"\{(%s)\}" % names, template)):
        value = values[piece] if index % 2 else piece
        parts.append(value if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)


def baseline_prompt(text: Column) -> Column:
    """Classification prompt with the sentence alone."""
    return fill(fixed.BASELINE_PROMPT, user_text=clean(text))


def retrieval_prompt(text: Column, context: Column) -> Column:
    """Classification prompt with the sentence and its retrieved examples."""
    return fill(fixed.RETRIEVAL_PROMPT, user_text=clean(text), context=clean(context))


def generation_prompts(
    definitions: DataFrame,
    definition_column: str = "definitions",
    n_delusional: int = fixed.ITEMS_PER_KIND,
    n_normal: int = fixed.ITEMS_PER_KIND,
    types: tuple[str, ...] = fixed.TYPES,
) -> DataFrame:
    """One row per definitions text and type, with its user prompt and messages.

    Adds ``type_requested``, ``prompt`` and ``messages`` (role and content).
    The types are a short constant list, exploded in place: no join.
    """
    prompt = fill(
        fixed.GENERATION_USER_PROMPT,
        definitions=clean(F.col(definition_column)),
        rubric=fixed.SEVERITY_RUBRIC,
        type_name=F.col("type_requested"),
        n_delusional=n_delusional,
        n_normal=n_normal,
        n_first_normal=n_delusional + 1,
        n_total=n_delusional + n_normal,
    )
    return (
        definitions.withColumn(
            "type_requested", F.explode(F.array(*[F.lit(t) for t in types]))
        )
        .withColumn("prompt", prompt)
        .withColumn(
            "messages",
            F.array(
                _message("system", F.lit(fixed.GENERATION_SYSTEM_PROMPT)),
                _message("user", F.col("prompt")),
            ),
        )
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))
