"""A journal of model answers: equal prompts are asked once, and a stopped run goes on.

Answers are kept by a key of the prompt and the model's name in a table of batches (see
``batches.py``). What is missing is asked in slices, and every slice is a batch of its own, so a
run that stops has to ask again for the slice it was at and for nothing before.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.embedding import cache_misses, content_key
from plumbline.operators.lookup import HOT_ROWS, lookup
from plumbline.operators.scoring import ScoreFunction, score
from plumbline.session import delete_written, written
from plumbline.sources.batches import append_batch, newest_of_keys, read_batches

JOURNAL = "key binary, response string"
#: Prompts of a slice: what a run that stops may have to ask again.
SLICE_ROWS = 100_000


def ask_missing(
    prompts: DataFrame,
    score_fn: ScoreFunction,
    model: str,
    journal: str,
    prompt: str = "prompt",
    row_id: str = "id",
    batch_size: int = 64,
    parallelism: int | None = None,
    slice_rows: int = SLICE_ROWS,
    max_slices: int | None = None,
) -> int:
    """Ask for the prompts that the ``journal`` has no answer to; how many slices are left.

    Every distinct prompt is asked once, a missing one never. With ``max_slices`` the
    call ends after that many slices, and a later call asks for the others. ``prompts`` is
    read more than once: pass a stored table. ``row_id`` tells its rows apart.
    """
    spark = prompts.sparkSession
    held = read_batches(spark, journal, JOURNAL)
    missing = cache_misses(prompts.select(row_id, prompt), held, model, prompt, row_id)
    # written once, so that a slice reads its own rows and no join is made again
    missing = written(missing)
    rows = missing.count()
    slices = math.ceil(rows / slice_rows)
    number = F.pmod(F.xxhash64("key"), F.lit(max(slices, 1)))
    todo = slices if max_slices is None else min(slices, max_slices)
    for part in range(todo):
        asked = missing.where(number == part)
        if parallelism is None:
            # a slice is dealt out to all cores, wherever its rows were written
            asked = asked.repartition(spark.sparkContext.defaultParallelism)
        answered = score(asked, score_fn, prompt, "response", batch_size, parallelism)
        append_batch(answered.select("key", "response"), journal)
    delete_written(missing)
    return slices - todo


def with_answers(
    prompts: DataFrame,
    model: str,
    journal: str,
    prompt: str = "prompt",
    row_id: str = "id",
    response: str = "response",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``prompts`` with the journal's answer to each; null where it has none.

    Rows of a very frequent prompt are dealt out to several tasks.
    """
    held = newest_of_keys(read_batches(prompts.sparkSession, journal, JOURNAL), "key", "response")
    answers = held.select(F.col("key").alias("_key"), F.col("response").alias(response))
    keyed = prompts.withColumn("_key", content_key(F.col(prompt), model))
    return lookup(keyed, answers, "_key", row_id, "left", hot_rows).drop("_key")
