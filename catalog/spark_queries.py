"""The named queries on Spark. Each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import fixtures
from plumbline import configure
from plumbline.functions.text import clean, is_blank
from plumbline.functions.vectors import l2_normalize
from plumbline.operators import evaluation, quality
from plumbline.operators.comparison import wilcoxon_signed_rank as wilcoxon
from plumbline.operators.embedding import (
    attach_embeddings,
    cache_misses,
    content_key,
    refresh_embeddings,
)
from plumbline.operators.journal import ask_missing
from plumbline.operators.json_lines import append_datasets, explode_items
from plumbline.operators.prompts import baseline_prompt, generation_prompts, retrieval_prompt
from plumbline.operators.responses import normalize_predictions
from plumbline.operators.retrieval import knn_join, with_context
from plumbline.operators.scoring import embed
from plumbline.operators.vector_index import append_to_index, create_index, search_index
from plumbline.plans.classification import (
    PREDICTION_COLUMNS,
    classify,
    evaluate,
    run,
    with_prompts,
)
from plumbline.plans.comparison import Comparison, compare, measured
from plumbline.plans.generation import dataset
from plumbline.session import checkpoint_folder
from plumbline.sources.tables import cap_rows, write_tables

# How far the second run's answer shapes are moved against the first one's.
SHIFT = fixtures.SECOND_RUN


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def _rounded(*columns: str, digits: int = 6) -> dict[str, Column]:
    return {c: F.round(F.col(c), digits) for c in columns}


# --- inputs ----------------------------------------------------------------


def _vectors(spark, folder) -> DataFrame:
    return _table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding"
    )


def _sentences(spark, folder) -> DataFrame:
    """All documents: id, sentence, embedding (null for those without a vector)."""
    documents = _table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("sentence")
    )
    return documents.join(_vectors(spark, folder), "id", "left")


def _patchy(spark, folder) -> DataFrame:
    """All documents; text missing or blank for some."""
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.expr(fixtures.PATCHY_TEXT_SQL).alias("sentence")
    )


def _answers(spark, folder, shift: int = 0) -> DataFrame:
    return _table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("toxic").alias("diagnosis"),
        F.expr(fixtures.GOLD_TEXT_SQL).alias("gold_text"),
        F.expr(fixtures.GOLD_SEVERITY_SQL).alias("severity"),
        F.expr(fixtures.answer_sql(shift)).alias("response"),
    )


def _predictions(spark, folder, shift: int = 0) -> DataFrame:
    return normalize_predictions(_answers(spark, folder, shift))


def _scored(spark, folder, gold: str = "gold_text") -> DataFrame:
    return evaluation.with_gold(_predictions(spark, folder), gold)


def _measured(spark, folder, shift: int) -> DataFrame:
    """One run with the measures two runs are compared by."""
    return measured(_predictions(spark, folder, shift))


def _comparison(spark, folder) -> Comparison:
    runs = [_predictions(spark, folder, shift) for shift in (0, SHIFT)]
    return compare(*runs)


def _item_responses(spark, folder) -> DataFrame:
    return _table(spark, folder, "labels").select(
        "doc_id",
        F.expr(fixtures.ITEM_TYPE_SQL).alias("type_requested"),
        F.expr(fixtures.ITEMS_SQL).alias("response"),
    )


# --- retrieval -------------------------------------------------------------


def knn_top3(spark, folder):
    vectors = _vectors(spark, folder)
    return knn_join(vectors, vectors)


def knn_top3_few_queries(spark, folder):
    """The same search with the queries sent to every executor, the corpus in place."""
    vectors = _vectors(spark, folder)
    return knn_join(vectors, vectors, layout="queries")


def knn_top3_by_blocks(spark, folder):
    """The same search by the path for two sides too big to broadcast."""
    vectors = _vectors(spark, folder)
    return knn_join(vectors, vectors, layout="blocks", block_values=64 * 256)


def knn_top3_quantised(spark, folder):
    """The same search by 8-bit codes, floats for those alone that the codes leave open."""
    vectors = _vectors(spark, folder)
    return knn_join(vectors, vectors, layout="codes", block_values=64 * 256)


def knn_top3_stored_index(spark, folder):
    """The same search in an index made of one half of the rows and grown by the other."""
    vectors = _vectors(spark, folder)
    index = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    middle = vectors.agg(F.percentile_approx("id", 0.5)).first()[0]
    create_index(vectors.where(F.col("id") <= middle), index, block_values=64 * 256)
    append_to_index(vectors.where(F.col("id") > middle), index)
    return search_index(vectors, index)


def l2_normalized(spark, folder):
    return _vectors(spark, folder).select(
        "id", F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "value")
    ).withColumns(_rounded("value"))


def _contexts(spark, folder, **search) -> DataFrame:
    sentences = _sentences(spark, folder)
    return with_context(sentences, sentences, **search).select(
        F.col("id").alias("query_id"),
        F.length("context").alias("n_chars"),
        F.md5("context").alias("context_md5"),
    )


def rag_context(spark, folder):
    return _contexts(spark, folder)


def rag_context_few_queries(spark, folder):
    """The same contexts with the queries sent to every executor."""
    return _contexts(spark, folder, layout="queries")


def rag_context_by_blocks(spark, folder):
    """The same contexts when neither side may be sent to every executor."""
    return _contexts(spark, folder, layout="blocks", block_values=64 * 256)


def rag_prompt_md5(spark, folder):
    sentences = _sentences(spark, folder)
    prompt = retrieval_prompt(F.col("sentence"), F.col("context"))
    return with_context(sentences, sentences).select(
        "id", F.md5(prompt).alias("prompt_md5")
    )


# --- prompts and text ------------------------------------------------------


def baseline_prompt_md5(spark, folder):
    return _table(spark, folder, "documents").select(
        "doc_id", F.md5(baseline_prompt(F.col("text"))).alias("prompt_md5")
    )


def prompt_grid(spark, folder):
    """Every document in turn as the definitions text, for every type."""
    documents = _table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("definitions")
    )
    return generation_prompts(documents).select(
        "doc_id", "type_requested", F.md5("prompt").alias("prompt_md5")
    )


def clean_text(spark, folder):
    text = F.col("sentence")
    return _patchy(spark, folder).select(
        "id", F.length(clean(text)).alias("n_chars"), is_blank(text).alias("is_blank")
    )


def empty_input_split(spark, folder):
    return classify(_patchy(spark, folder), fixtures.stand_in_answers).drop("sentence")


def word_count_flags(spark, folder):
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return quality.with_word_count(turns, "text").drop("text")


def word_count_documents(spark, folder):
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return quality.with_word_count(documents, "text").drop("text")


# --- models ----------------------------------------------------------------


def _letter_columns(df: DataFrame) -> DataFrame:
    counts = [
        F.col("embedding")[i].cast("double").alias(f"v{i}")
        for i in range(len(fixtures.COUNTED))
    ]
    return df.select(*[c for c in df.columns if c != "embedding"], *counts)


def embed_texts(spark, folder):
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return _letter_columns(
        embed(documents, fixtures.stand_in_vectors, "text").drop("text")
    )


def _stored(spark, folder) -> DataFrame:
    """A store with the vectors of the texts that come with one."""
    return (
        _sentences(spark, folder)
        .where(F.col("embedding").isNotNull())
        .withColumn("key", content_key(F.col("sentence"), fixtures.MODEL))
        .groupBy("key")
        .agg(F.min_by("embedding", "id").alias("embedding"))
    )


def _texts(spark, folder) -> DataFrame:
    return _table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("sentence")
    )


def embedding_cache_misses(spark, folder):
    misses = cache_misses(_texts(spark, folder), _stored(spark, folder), fixtures.MODEL)
    return misses.select(_hex("key"), F.length("sentence").alias("n_chars"))


def _hex(key: str) -> Column:
    return F.lower(F.hex(key)).alias(key)


def embedding_refresh(spark, folder):
    fresh = refresh_embeddings(
        _texts(spark, folder), _stored(spark, folder), fixtures.stand_in_vectors, fixtures.MODEL
    )
    return _letter_columns(fresh.withColumn("key", _hex("key")))


def embedding_reuse(spark, folder):
    attached = attach_embeddings(
        _texts(spark, folder), _stored(spark, folder), fixtures.MODEL
    )
    first = F.round(F.col("embedding")[0].cast("double"), 6)
    return attached.select(
        "id", F.col("embedding").isNotNull().alias("is_stored"), first.alias("first_value")
    )


def baseline_run(spark, folder):
    return classify(_texts(spark, folder), fixtures.stand_in_answers).drop("sentence")


def resumed_run(spark, folder):
    """A run that stopped after one of its slices, and the same run again."""
    base = f"{checkpoint_folder(spark)}/resumed-{uuid.uuid4().hex}"
    prompts = with_prompts(_texts(spark, folder))
    per_slice = max(1, prompts.count() // 3)
    ask_missing(
        prompts, fixtures.stand_in_answers, fixtures.MODEL, f"{base}/journal",
        slice_rows=per_slice, max_slices=1,
    )
    results = run(
        _texts(spark, folder), fixtures.stand_in_answers, f"{base}/run",
        journal=f"{base}/journal", model=fixtures.MODEL, slice_rows=per_slice,
    )
    return results.predictions.drop("sentence", "response")


def rag_run(spark, folder):
    sentences = _sentences(spark, folder)
    predicted = classify(sentences, fixtures.stand_in_answers, sentences)
    return predicted.drop("sentence", "embedding")


def rag_run_from_text(spark, folder):
    """Texts alone: embed what the store lacks, retrieve, ask, read the answers."""
    texts = _texts(spark, folder)
    store = f"{checkpoint_folder(spark)}/vectors-{uuid.uuid4().hex}"
    predicted = classify(
        texts,
        fixtures.stand_in_answers,
        texts,
        embed_fn=fixtures.stand_in_vectors,
        embed_model=fixtures.MODEL,
        store=store,
    )
    return predicted.drop("sentence", "embedding")


# --- answers and evaluation ------------------------------------------------


def normalized_predictions(spark, folder):
    return _predictions(spark, folder).select(
        "id", "pred_diagnosis", "pred_severity", "pred_confidence", "pred_reasoning"
    )


def attach_predictions(spark, folder):
    predictions = normalized_predictions(spark, folder)
    test = _table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    return evaluation.attach_predictions(test, predictions)


def gold_labels(spark, folder):
    labelled = evaluation.with_gold(_answers(spark, folder), "gold_text")
    from_numbers = evaluation.with_gold(labelled, "diagnosis", "gold_from_number")
    return from_numbers.select("id", "gold", "gold_from_number")


def valid_predictions(spark, folder):
    predictions = _predictions(spark, folder)
    return predictions.where(evaluation.is_valid(F.col("pred_diagnosis"))).select(
        "id", "pred_diagnosis"
    )


def accuracy(spark, folder):
    return evaluation.accuracy(_scored(spark, folder)).withColumns(_rounded("accuracy"))


def precision_recall(spark, folder):
    return evaluation.precision_recall(_scored(spark, folder)).withColumns(
        _rounded("precision", "recall")
    )


def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(_scored(spark, folder))


def row_correctness(spark, folder):
    return evaluation.with_correctness(_scored(spark, folder)).select("id", "pred_correct")


def metrics(spark, folder):
    return evaluation.metrics(_scored(spark, folder)).withColumns(_rounded("value"))


def metrics_report(spark, folder):
    return evaluation.report(_scored(spark, folder))


def evaluated_run(spark, folder):
    """Metrics by the first human-label column there is, for each set of such columns."""
    predictions = _predictions(spark, folder)
    text, number = F.col("gold_text").alias("dignosis"), F.col("diagnosis")
    answer = [F.col(c) for c in PREDICTION_COLUMNS]
    tables = {
        "diagnosis": predictions.select("id", number, *answer),
        "dignosis": predictions.select("id", text, *answer),
        "both": predictions.select("id", text, number, *answer),
        "neither": predictions.select("id", *answer),
    }
    rows = []
    for columns, table in tables.items():
        results = evaluate(table)
        found = results.metrics
        if found is None:
            found = results.predictions.agg(
                F.lit("no metrics").alias("name"), F.count(F.lit(1)).cast("double").alias("value")
            )
        rows.append(found.select(F.lit(columns).alias("columns"), "name", "value"))
    return append_datasets(*rows).withColumns(_rounded("value"))


# --- comparison of two runs ------------------------------------------------


def severity_error(spark, folder):
    return _measured(spark, folder, 0).select("id", "severity_error")


def paired_differences(spark, folder):
    return _comparison(spark, folder).differences


def descriptives(spark, folder):
    return _comparison(spark, folder).descriptives.withColumns(_rounded("mean", "sd", "median"))


def paired_t(spark, folder):
    """p is left out: DuckDB has no t distribution. Unit tests cover it."""
    return _comparison(spark, folder).paired_t.drop("p").withColumns(_rounded("mean", "sd", "t"))


def wilcoxon_signed_rank(spark, folder):
    """p is left out: DuckDB has no normal distribution. Unit tests cover it."""
    return _comparison(spark, folder).wilcoxon.drop("p").withColumns(_rounded("z"))


def wilcoxon_many_values(spark, folder):
    """The test where nearly every difference is a value of its own: one per order line."""
    d = F.col("l_extendedprice") * F.col("l_discount") - F.col("l_quantity") * 50
    lines = _table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("measure"), d.alias("d"))
    return wilcoxon(lines.where(F.col("d").isNotNull())).drop("p").withColumns(_rounded("z"))


def compare_runs(spark, folder):
    """Two written runs, compared from their tables: both tests, measure by measure."""
    base = f"{checkpoint_folder(spark)}/compare-{uuid.uuid4().hex}"
    for name, shift in (("first", 0), ("second", SHIFT)):
        write_tables(base, **{name: _predictions(spark, folder, shift)})
    runs = [spark.read.parquet(f"{base}/{name}") for name in ("first", "second")]
    found = compare(*runs, path=f"{base}/comparison")
    ranks = found.wilcoxon.select("measure", "pairs", "w_plus", "w_minus", "z")
    return found.paired_t.drop("p").join(ranks, "measure").withColumns(
        _rounded("mean", "sd", "t", "z")
    )


# --- generated data --------------------------------------------------------


def jsonl_items(spark, folder):
    return explode_items(_item_responses(spark, folder))


def generated_dataset(spark, folder):
    return dataset(_item_responses(spark, folder), fixtures.MODEL, keep=("doc_id",))


def appended_datasets(spark, folder):
    """Items of the generated table, then the answers of the two runs as items."""
    generated = explode_items(_item_responses(spark, folder)).select(
        F.col("doc_id").alias("id"), F.col("type").alias("label")
    )
    runs = [
        _predictions(spark, folder, shift).select("id", F.col("pred_diagnosis").alias("label"))
        for shift in (0, SHIFT)
    ]
    return append_datasets(generated, *runs)


def class_balance(spark, folder):
    labelled = evaluation.with_gold(_answers(spark, folder), "gold_text")
    return quality.class_balance(labelled, "gold").withColumns(_rounded("share"))


def contract_checks(spark, folder):
    return quality.contract_checks(
        _item_responses(spark, folder), n_delusional=1, n_normal=1
    )


def row_cap(spark, folder):
    """The cap is the feature: the first rows by key, as a dry run takes them."""
    return cap_rows(_texts(spark, folder), 50).select(
        "id", F.md5("sentence").alias("sentence_md5")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn_top3,
        knn_top3_few_queries,
        knn_top3_by_blocks,
        knn_top3_stored_index,
        knn_top3_quantised,
        l2_normalized,
        rag_context,
        rag_context_few_queries,
        rag_context_by_blocks,
        rag_prompt_md5,
        baseline_prompt_md5,
        prompt_grid,
        clean_text,
        empty_input_split,
        word_count_flags,
        word_count_documents,
        embed_texts,
        embedding_cache_misses,
        embedding_refresh,
        embedding_reuse,
        baseline_run,
        resumed_run,
        rag_run,
        rag_run_from_text,
        normalized_predictions,
        attach_predictions,
        gold_labels,
        valid_predictions,
        accuracy,
        precision_recall,
        confusion_matrix,
        row_correctness,
        metrics,
        metrics_report,
        evaluated_run,
        severity_error,
        paired_differences,
        descriptives,
        paired_t,
        wilcoxon_signed_rank,
        wilcoxon_many_values,
        compare_runs,
        jsonl_items,
        generated_dataset,
        appended_datasets,
        class_balance,
        contract_checks,
        row_cap,
    )
}
