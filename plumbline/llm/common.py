"""Session settings, written intermediate tables, and joins that stand hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import checkpoint_folder, configure, ship_packages

#: Rows of an Arrow batch: texts can be long, and a batch is held whole.
BATCH_ROWS = 1000
#: Whether Spark deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with more than this share of the rows is hot, so at most its inverse are.
HOT_SHARE = 0.001


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators need, and this package on the Python workers."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_packages(spark)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """Identifier and text alone, a missing text as an empty one."""
    return docs.select(
        F.col(identifier), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)
    )


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder all executors share; it goes when the application ends."""
    path = f"{checkpoint_folder(spark)}/plumbline-{uuid.uuid4().hex}"
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder all executors share, and read again.

    Cuts the lineage, and later steps read only the columns they need. The plan runs only
    here, so Spark may delete its shuffle files as soon as the table is written.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a stored table that no later step reads, so that steps do not add up on disk."""
    context = table.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``groups``, one row per key with the key's ``size``.

    ``size`` is how many of the rows have the key. The groups with more than
    ``HOT_SHARE`` of all rows, at most ``1 / HOT_SHARE`` of them, are broadcast, and
    their rows stay where they are; the rest meet in a shuffled join. Both tables are
    read twice: pass written ones. Rows without a key match nothing.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    is_hot = F.col("_hot").isNotNull()
    return (
        marked.where(is_hot)
        .drop("_hot")
        .join(hot, key)
        .unionByName(marked.where(~is_hot).drop("_hot").join(cold, key, how))
    )


def translate_lower(column: Column) -> Column:
    """A-Z in lower case; no other letter changes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())
