"""The lookup gives the plain join's rows, and no task a hot key's rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.embedding import attach_embeddings, content_key
from plumbline.operators.lookup import lookup
from plumbline.operators.retrieval import retrieve_context


@pytest.fixture(scope="module")
def rows(spark):
    # a third of the rows has key 0, a sixth has none
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 6 != 1, F.col("id") % 50)
    return spark.range(600).select("id", key.cast("long").alias("key"))


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(40).selectExpr("id as key", "concat('t', id) as text")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_rows", [1, 7, 60, 10_000])
def test_equals_the_plain_join(rows, table, how, hot_rows):
    got = lookup(rows, table, "key", "id", how, hot_rows).select("id", "key", "text")
    plain = rows.join(table, "key", how).select("id", "key", "text")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_hot_rows_are_spread(spark, rows, table):
    dealt = lookup(rows, table, "key", "id", "left", 20)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        task = F.spark_partition_id().alias("task")
        sizes = {
            name: max(r["count"] for r in df.groupBy(task).count().collect())
            for name, df in (("plain", rows.join(table, "key", "left")), ("dealt", dealt))
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sizes["plain"] >= 200
    assert sizes["dealt"] < 150


def test_embeddings_of_a_frequent_text(spark):
    text = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 9))
    texts = spark.range(90).select("id", text.alias("sentence"))
    store = texts.select("sentence").distinct().select(
        content_key(F.col("sentence"), "m").alias("key"),
        F.array(F.length("sentence").cast("float")).alias("embedding"),
    )
    got = attach_embeddings(texts, store, "m", hot_rows=5).collect()
    assert len(got) == 90
    assert all(r.embedding == [len(r.sentence)] for r in got)


def test_context_from_a_row_near_to_all(spark):
    corpus = spark.createDataFrame(
        [(i, f"t{i}", [1.0, i / 10]) for i in range(6)],
        "id long, sentence string, embedding array<float>",
    )
    queries = spark.range(40).select("id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    got = retrieve_context(
        queries, corpus, 2, separator="|", broadcast_values=0, block_values=4, hot_rows=3
    ).collect()
    assert len(got) == 40 and {r.context for r in got} == {"t0|t1"}
