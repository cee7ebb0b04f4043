"""Order-dependent operators that stay distributed when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill_forward(df: DataFrame, key: str, order: list[str], value: str, block: str, out: str) -> DataFrame:
    """out: the last non-null value of the key at or before the row.

    block is a whole-number column that does not fall along the order (such as page / 64). A window runs within
    (key, block); what a block inherits comes from a table of one row a block, so a key with many rows is never in one
    task. Rows before the first value get null; a null key is a key of its own."""
    inside = Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = df.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    blocks = df.groupBy(F.col(key).alias("_k"), F.col(block).alias("_b")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_k", "_b", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    joined = near.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col(block).eqNullSafe(F.col("_b")), "left")
    return joined.withColumn(out, F.coalesce("_near", "_carried")).drop("_near", "_carried", "_k", "_b")


def numbered(df: DataFrame, key: str | None, order: list[str], block: str, out: str) -> DataFrame:
    """out: the row's number from 1 along the order (within key), by counting blocks first and rows within a block."""
    keys = [key] if key else []
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return df.join(offsets, [*keys, block]).withColumn(out, F.col("_before") + F.row_number().over(inside)).drop("_before")


def latest(df: DataFrame, key: str, order: list, columns: list[str]) -> DataFrame:
    """The row of each key that is last along the order, by a combining aggregate instead of a window."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(key, "_r.*")
