"""Classify a test table, with or without retrieved context, and score the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import EMBED_BATCH, EMPTY_INPUT, GOLD_COLUMNS, TEXT_COLUMN, TOP_K
from plumbline.functions.text import is_blank
from plumbline.operators import evaluation
from plumbline.operators.embedding import attach_embeddings, refresh_embeddings
from plumbline.operators.journal import SLICE_ROWS, ask_missing, with_answers
from plumbline.operators.prompts import baseline_prompt, retrieval_prompt
from plumbline.operators.responses import PREDICTION_COLUMNS, normalize_predictions
from plumbline.operators.retrieval import with_context
from plumbline.operators.scoring import EmbedFunction, ScoreFunction, score
from plumbline.session import written
from plumbline.sources.batches import append_batch, newest_of_keys, read_batches
from plumbline.sources.tables import first_present, require_column, write_tables

STORE = "key binary, embedding array<float>"


def with_embeddings(
    table: DataFrame,
    embed_fn: EmbedFunction,
    model: str,
    store: str,
    text: str = TEXT_COLUMN,
    batch_size: int = EMBED_BATCH,
    parallelism: int | None = None,
) -> DataFrame:
    """``table`` with the ``embedding`` of every text that is not blank.

    ``store`` is a folder of batches ``key, embedding`` (see ``batches.py``). Texts whose
    vector it holds for this model are not embedded again; new vectors are appended to it
    before any is used. Runs may share a store at the same time: a text that two of them
    add has one vector. ``id`` tells the rows of ``table`` apart.
    """
    spark = table.sparkSession
    held = read_batches(spark, store, STORE)
    asking = table.where(~is_blank(F.col(text))).select("id", text)
    append_batch(
        refresh_embeddings(asking, held, embed_fn, model, text, batch_size, parallelism), store
    )
    held = newest_of_keys(read_batches(spark, store, STORE), "key", "embedding")
    return attach_embeddings(table.drop("embedding"), held, model, text)


def _prepared(test, corpus, text, embed_fn, model, store):
    """Both tables with embeddings, made by ``embed_fn`` if there is one."""
    if embed_fn is None or corpus is None:
        return test, corpus
    if model is None or store is None:
        raise ValueError("embed_fn needs the model's name and a store for its vectors")
    for name, table in (("test table", test), ("corpus", corpus)):
        require_column(table, text, name)
    corpus = with_embeddings(corpus, embed_fn, model, store, text)
    return with_embeddings(test, embed_fn, model, store, text), corpus


def with_prompts(
    test: DataFrame,
    corpus: DataFrame | None = None,
    k: int = TOP_K,
    text: str = TEXT_COLUMN,
    **search,
) -> DataFrame:
    """Add ``prompt``; null for a blank text, which goes to no model.

    With a ``corpus`` (``id, sentence, embedding``) the prompt carries the texts
    nearest to the row, found by the test table's own ``embedding``. Without
    one this is a projection.
    """
    require_column(test, text, "test table")
    if corpus is None:
        prompt = baseline_prompt(F.col(text))
        return test.withColumn("prompt", F.when(~is_blank(F.col(text)), prompt))
    for column in (text, "embedding"):
        require_column(corpus, column, "corpus")
    require_column(test, "embedding", "test table")
    blank = is_blank(F.col(text))
    # a blank row has nothing to find neighbours for
    asking = test.withColumn("_asking", F.when(~blank, F.col("embedding")))
    prompt = retrieval_prompt(F.col(text), F.col("context"))
    return (
        with_context(asking, corpus, k, text, embedding="_asking", **search)
        .withColumn("prompt", F.when(~blank, prompt))
        .drop("context", "_asking")
    )


def with_predictions(
    answered: DataFrame, text: str = TEXT_COLUMN, response: str = "response"
) -> DataFrame:
    """Turn ``response`` into prediction columns; blank texts get the fixed reason."""
    return normalize_predictions(answered, response).withColumn(
        "pred_reasoning",
        F.when(is_blank(F.col(text)), F.lit(EMPTY_INPUT)).otherwise(F.col("pred_reasoning")),
    )


def from_responses(
    test: DataFrame, responses: DataFrame, text: str = TEXT_COLUMN, key: str = "id"
) -> DataFrame:
    """The test table with predictions read off a ready table of answers.

    ``responses`` has ``key`` and ``response``, one row per key.
    """
    answers = responses.select(key, "response")
    return with_predictions(evaluation.attach_predictions(test, answers, key), text)


def classify(
    test: DataFrame,
    score_fn: ScoreFunction,
    corpus: DataFrame | None = None,
    k: int = TOP_K,
    text: str = TEXT_COLUMN,
    batch_size: int = 64,
    parallelism: int | None = None,
    embed_fn: EmbedFunction | None = None,
    embed_model: str | None = None,
    store: str | None = None,
    **search,
) -> DataFrame:
    """The test table with its four prediction columns.

    With a ``corpus`` and ``embed_fn`` neither table needs an ``embedding``: vectors
    come from the ``store`` or are made and added to it. The model is applied when the result is computed, once per action; use
    ``run`` to keep the answers.
    """
    test, corpus = _prepared(test, corpus, text, embed_fn, embed_model, store)
    prompts = with_prompts(test, corpus, k, text, **search)
    answered = score(prompts, score_fn, "prompt", "response", batch_size, parallelism)
    return with_predictions(answered.drop("prompt"), text)


def journalled(
    prompts: DataFrame,
    score_fn: ScoreFunction,
    model: str | None,
    journal: str,
    batch_size: int = 64,
    parallelism: int | None = None,
    slice_rows: int = SLICE_ROWS,
    max_slices: int | None = None,
) -> DataFrame:
    """``prompts`` with ``response``, by way of a journal; see ``ask_missing``."""
    if model is None:
        raise ValueError("a journal needs the model's name")
    # a number for every row, fixed by writing it down; prompts can be dear to make
    fixed = written(prompts.withColumn("_row", F.monotonically_increasing_id()))
    ask_missing(
        fixed, score_fn, model, journal, "prompt", "_row", batch_size, parallelism, slice_rows, max_slices
    )
    return with_answers(fixed, model, journal, "prompt", "_row").drop("_row")


@dataclass(frozen=True)
class Results:
    """Tables of one run; all but ``predictions`` are None without human labels."""

    predictions: DataFrame
    metrics: DataFrame | None
    confusion: DataFrame | None
    report: DataFrame | None


def evaluate(predictions: DataFrame, gold_columns: tuple[str, ...] = GOLD_COLUMNS) -> Results:
    """Score predictions against the first human-label column the table has."""
    gold = first_present(predictions, gold_columns)
    if gold is None:
        return Results(predictions, None, None, None)
    labelled = evaluation.with_gold(predictions, gold, "_gold")
    return Results(
        evaluation.with_correctness(labelled, "_gold").drop("_gold"),
        evaluation.metrics(labelled, "_gold"),
        evaluation.confusion_matrix(labelled, "_gold"),
        evaluation.report(labelled, "_gold"),
    )


def run(
    test: DataFrame,
    score_fn: ScoreFunction,
    path: str,
    corpus: DataFrame | None = None,
    k: int = TOP_K,
    text: str = TEXT_COLUMN,
    batch_size: int = 64,
    parallelism: int | None = None,
    embed_fn: EmbedFunction | None = None,
    embed_model: str | None = None,
    store: str | None = None,
    journal: str | None = None,
    model: str | None = None,
    slice_rows: int = SLICE_ROWS,
    **search,
) -> Results:
    """Classify, score and write ``responses``, ``predictions`` and the metrics tables.

    ``embed_fn``, ``embed_model`` and ``store`` are those of ``classify``. With a folder
    ``journal`` and the ``model``'s name, equal prompts are asked once, answers that the
    journal holds are not asked for again, and a run that stops half-way goes on from the last
    slice of ``slice_rows`` prompts (see ``journal.py``).

    The model's answers are written first and everything else is derived from
    the written table, so no answer is asked for twice and a lost executor
    costs at most the answers of its unfinished tasks.
    """
    folder = path.rstrip("/")
    spark = test.sparkSession
    test, corpus = _prepared(test, corpus, text, embed_fn, embed_model, store)
    prompts = with_prompts(test, corpus, k, text, **search)
    if journal is None:
        answered = score(prompts, score_fn, "prompt", "response", batch_size, parallelism)
    else:
        answered = journalled(
            prompts, score_fn, model, journal, batch_size, parallelism, slice_rows
        )
    write_tables(folder, responses=answered.drop("prompt"))

    # the answers keep their test row beside them, so nothing has to be joined
    responses = spark.read.parquet(f"{folder}/responses")
    predicted = with_predictions(responses, text)
    gold = first_present(predicted, GOLD_COLUMNS)
    if gold is not None:
        labelled = evaluation.with_gold(predicted, gold, "_gold")
        predicted = evaluation.with_correctness(labelled, "_gold").drop("_gold")
    write_tables(folder, predictions=predicted)
    predictions = spark.read.parquet(f"{folder}/predictions")
    if gold is None:
        return Results(predictions, None, None, None)
    labelled = evaluation.with_gold(predictions, gold, "_gold")
    write_tables(
        folder,
        metrics=evaluation.metrics(labelled, "_gold"),
        confusion=evaluation.confusion_matrix(labelled, "_gold"),
    )
    # the report is made of the small table just written
    confusion = spark.read.parquet(f"{folder}/confusion")
    write_tables(folder, report=evaluation.report_of(confusion))
    names = ("metrics", "confusion", "report")
    return Results(predictions, *[spark.read.parquet(f"{folder}/{n}") for n in names])


__all__ = [
    "PREDICTION_COLUMNS",
    "Results",
    "classify",
    "evaluate",
    "from_responses",
    "journalled",
    "run",
    "with_embeddings",
    "with_predictions",
    "with_prompts",
]
