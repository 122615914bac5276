"""A table that grows by whole batches, several writers at once.

Every batch is a folder of Parquet files with a name of its own. It counts from the
moment an empty file of that name is put into the folder ``committed``, which is the last
thing its writer does. So readers never see half a batch, a writer that fails leaves
nothing that counts, and writers cannot get in each other's way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that names a row's batch.
BATCH = "batch"


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def append_batch(rows: DataFrame, folder: str, by: tuple[str, ...] = ()) -> str | None:
    """Write ``rows`` as one batch, its files parted ``by`` columns; the batch's name.

    Without a row there is no batch.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    path = f"{folder}/rows/{BATCH}={name}"
    rows.write.partitionBy(*by).parquet(path)
    written = spark.read.schema(rows.drop(*by).schema).option("recursiveFileLookup", "true").parquet(path)
    if written.isEmpty():
        return None
    place, files = _place(spark, f"{folder}/committed/{name}")
    files.create(place, False).close()
    return name


def batches(spark: SparkSession, folder: str) -> list[str]:
    """Names of the batches that count, in order; none if there is no such folder."""
    place, files = _place(spark, f"{folder}/committed")
    if not files.exists(place):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(place))


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches that count, and the name of each row's ``batch``."""
    names = batches(spark, folder)
    if not names:
        return spark.createDataFrame([], schema).withColumn(BATCH, F.lit(""))
    return (
        spark.read.schema(f"{schema}, {BATCH} string")
        .option("basePath", f"{folder}/rows")
        .parquet(*[f"{folder}/rows/{BATCH}={name}" for name in names])
    )


def newest_of_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` with one row per key, whichever batches hold it: the last one's by name.

    Two writers may both have found a key missing and have added it.
    """
    return rows.groupBy(key).agg(F.max_by(value, BATCH).alias(value))
