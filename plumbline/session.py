"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Sized by data, not by machine: start with many small shuffle partitions and
# let AQE merge them; AQE also splits a partition that one hot key fills.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A repeated key in a JSON answer keeps its last value instead of making
    # the whole answer unreadable.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def keep_last_duplicate_key(df: DataFrame) -> None:
    """Make JSON parsing on ``df``'s session keep the last of repeated keys."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    The one that ``spark.checkpoint.dir`` names. A temporary one is made only in local
    mode, where driver and executors are the same machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the cluster's shared folder and return the result.

    Used where a result that took a shuffle or a Python stage feeds several
    later steps.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as compressed Parquet in the cluster's shared folder, read again.

    For tables with texts, which a checkpoint would keep uncompressed. The plan's shuffle
    files go as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/written-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_written(table: DataFrame) -> None:
    """Delete the files of ``written``, once nothing reads them any more."""
    context = table.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


_shipped: set[str] = set()


def ship_packages(spark: SparkSession) -> None:
    """Send this repository's Python files to the workers, once per application.

    What ``spark-submit --py-files`` does; needed where the session was started
    without it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for package in ("plumbline", "catalog"):
            for file in sorted((root / package).rglob("*.py")):
                packed.write(file, file.relative_to(root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
