"""From generation prompts to the tagged dataset. The generator is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.fixed_values import GENERATION_TEMPERATURE, ITEMS_PER_KIND, TYPES
from plumbline.operators.json_lines import explode_items, tag_items
from plumbline.operators.prompts import generation_prompts
from plumbline.operators.scoring import ScoreFunction, score
from plumbline.sources.tables import write_tables


def dataset(
    responses: DataFrame,
    model: str,
    temperature: float = GENERATION_TEMPERATURE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The generated dataset from a table of JSON-lines ``response`` texts."""
    return tag_items(explode_items(responses), model, temperature, keep)


def generate(
    definitions: DataFrame,
    generate_fn: ScoreFunction,
    model: str,
    path: str,
    n_delusional: int = ITEMS_PER_KIND,
    n_normal: int = ITEMS_PER_KIND,
    types: tuple[str, ...] = TYPES,
    temperature: float = GENERATION_TEMPERATURE,
    parallelism: int | None = None,
) -> DataFrame:
    """Ask the caller's generator for every type, write ``responses`` and ``dataset``.

    ``parallelism`` is how many calls may run at once, by default one for each type.
    """
    folder = path.rstrip("/")
    spark = definitions.sparkSession
    prompts = generation_prompts(
        definitions, "definitions", n_delusional, n_normal, types
    )
    answered = score(
        prompts, generate_fn, "prompt", "response", 1, parallelism or len(types)
    )
    write_tables(folder, responses=answered.select("type_requested", "response"))
    responses = spark.read.parquet(f"{folder}/responses")
    write_tables(folder, dataset=dataset(responses, model, temperature))
    return spark.read.parquet(f"{folder}/dataset")
