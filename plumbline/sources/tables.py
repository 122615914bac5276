"""Reading and writing the tables of a run."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import DEFAULT_DEFINITIONS, GOLD_COLUMNS, TEXT_COLUMN
from plumbline.operators.ordering import first_rows


#: Bytes of a CSV file above which one task should not read it alone.
LARGE_FILE = 1 << 30


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A labelled table: CSV with a header by suffix, otherwise Parquet.

    CSV columns are text unless ``schema`` gives types. How a file is split is the
    caller's choice, since no look at a part of it can tell a line break inside quotes from
    the end of a row. By default, ``multi_line``, such breaks are read right and one task
    reads a file; a file of more than ``LARGE_FILE`` bytes then gets a warning. Without it
    a file is split into as many tasks as its size asks for, and every line is a row.
    """
    if not path.lower().rstrip("/").endswith(".csv"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    if multi_line:
        # file sizes only, no content
        sizes = spark.read.format("binaryFile").load(path).agg(F.max("length"))
        if (sizes.first()[0] or 0) > LARGE_FILE:
            warnings.warn(
                f"{path} has a large file that one task reads; if no quoted text holds "
                "a line break, pass multi_line=False",
                stacklevel=2,
            )
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_definitions(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row ``definitions``: the text file, or the built-in text without one.

    ``ValueError`` if the path stands for more than one file.
    """
    if path and path.strip().lower().endswith(".txt"):
        try:
            found = spark.read.text(path.strip(), wholetext=True)
        except AnalysisException:
            found = None
        if found is not None:
            if found.count() != 1:
                raise ValueError(f"{path} must be one text file")
            return found.select(F.col("value").alias("definitions"))
    return spark.range(1).select(F.lit(DEFAULT_DEFINITIONS).alias("definitions"))


def require_column(df: DataFrame, column: str = TEXT_COLUMN, name: str = "table") -> DataFrame:
    """``df`` itself, or ``ValueError`` when it lacks the column."""
    if column not in df.columns:
        raise ValueError(f"{name} must contain column '{column}'")
    return df


def first_present(df: DataFrame, candidates: tuple[str, ...] = GOLD_COLUMNS) -> str | None:
    """The first of the candidate columns that ``df`` has."""
    return next((c for c in candidates if c in df.columns), None)


def cap_rows(df: DataFrame, max_rows: int | None, key: str = "id") -> DataFrame:
    """The first ``max_rows`` rows by key, or all of them without a cap."""
    return first_rows(df, max_rows, key) if max_rows else df


def write_keyed(df: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Give rows without a key one, fix it by writing the table, and read it back.

    A generated key holds only as long as the input is split the same way, so
    two runs have to share one written table.
    """
    if key not in df.columns:
        df = df.withColumn(key, F.monotonically_increasing_id())
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_tables(path: str, **tables: DataFrame | None) -> None:
    """Each given table as Parquet in a folder of its name under ``path``."""
    for name, table in tables.items():
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
