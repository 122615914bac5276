"""Apply a caller's model functions to a column, partition by partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import EMBED_BATCH

ScoreFunction = Callable[[list[str]], list[str]]
EmbedFunction = Callable[[list[str]], list]


def _apply_in_batches(function: Callable[[list], list], batch_size: int):
    """Series to series; calls ``function`` on lists of non-null values only."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            values = series.tolist()
            asked = [i for i, present in enumerate(series.notna()) if present]
            results: list = [None] * len(values)
            for start in range(0, len(asked), batch_size):
                piece = asked[start : start + batch_size]
                outputs = list(function([values[i] for i in piece]))
                if len(outputs) != len(piece):
                    raise ValueError(
                        f"model function gave {len(outputs)} results for {len(piece)} inputs"
                    )
                for i, output in zip(piece, outputs):
                    results[i] = output
            yield pd.Series(results, dtype=object)

    return run


def with_model_output(
    df: DataFrame,
    source: str,
    target: str,
    function: Callable[[list], list],
    kind: T.DataType,
    batch_size: int,
    parallelism: int | None = None,
) -> DataFrame:
    """Add ``target`` = ``function`` of ``source``; null in, null out.

    Only ``source`` travels to the Python worker; the other columns stay in the
    JVM, so no join is needed to put the outputs back. ``parallelism`` bounds
    how many calls run at once. The function is marked nondeterministic to keep
    the optimizer from calling it twice or moving it.
    """
    if parallelism:
        df = df.repartition(parallelism)

    run = _apply_in_batches(function, batch_size)

    @F.pandas_udf(kind)
    def apply_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return df.withColumn(target, apply_model.asNondeterministic()(F.col(source)))


def score(
    df: DataFrame,
    score_fn: ScoreFunction,
    prompt: str = "prompt",
    response: str = "response",
    batch_size: int = 64,
    parallelism: int | None = None,
) -> DataFrame:
    """Add ``response``, the model's text for each non-null ``prompt``."""
    return with_model_output(
        df, prompt, response, score_fn, T.StringType(), batch_size, parallelism
    )


def embed(
    df: DataFrame,
    embed_fn: EmbedFunction,
    text: str = "sentence",
    embedding: str = "embedding",
    batch_size: int = EMBED_BATCH,
    parallelism: int | None = None,
) -> DataFrame:
    """Add ``embedding``, the vector the caller's model gives for each text."""
    return with_model_output(
        df, text, embedding, embed_fn, T.ArrayType(T.FloatType()), batch_size, parallelism
    )
