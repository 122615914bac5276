"""Vector columns (``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>``), JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(
        left, right, lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_normalize(vector: Column) -> Column:
    """Scale to unit length in double precision; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    scale = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: x.cast("double") / scale)
