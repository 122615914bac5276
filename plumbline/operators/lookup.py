"""Join rows to a table with one row per key, whatever the keys' frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task is asked to take.
HOT_ROWS = 1_000_000
# A key with less than this share of all rows is never hot, so few keys are.
HOT_SHARE = 0.001


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    row_id: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``key``.

    The rows are counted by key first. Rows of a key with more than ``hot_rows`` and
    more than ``HOT_SHARE`` of all rows are dealt out by ``row_id`` to several parts,
    and that key's one table row is repeated for each part; rows without a key spread
    the same way. At most ``1 / HOT_SHARE`` keys can be hot, whatever the number of
    rows. AQE does not do this reliably: it goes by bytes, and rows of one key compress
    well.
    """
    counts = rows.groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    if total <= hot_rows:
        return rows.join(table, key, how)
    hot_rows = max(hot_rows, int(total * HOT_SHARE))
    parts = F.ceil(F.col("count") / F.lit(hot_rows)).cast("int")
    hot = (
        counts.where(F.col("count") > hot_rows)
        .select(key, parts.alias("_parts"))
    )
    found = hot.collect()
    if not found:
        return rows.join(table, key, how)
    dealt = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    one = F.lit(1)
    spread = F.xxhash64(row_id)
    left = rows.join(dealt, key, "left").withColumn(
        "_part",
        # a missing key matches nothing, so its rows may go anywhere
        F.when(F.col(key).isNull(), F.hash(row_id)).otherwise(
            F.pmod(spread, F.coalesce("_parts", one)).cast("int")
        ),
    )
    right = table.join(dealt, key, "left").withColumn(
        "_part",
        F.explode(F.sequence(F.lit(0), F.coalesce("_parts", one) - 1)),
    )
    return left.drop("_parts").join(right.drop("_parts"), [key, "_part"], how).drop("_part")
