"""Windows over long sequences by blocks: ranges of a sequence side by side, with what crosses their borders carried.

A window by ``video_id`` puts a whole video into one task. Here a sequence is cut into blocks of its order column; within a
block an ordinary window does, and one row a block tells the next blocks what they need. Only these
rows are put in order by sequence. Rows stay where they are: windows, groups and joins are all by sequence and block.

Cases: blocks without rows are passed over; rows of equal order are in any order, as in a window; an
empty table gives an empty result; null orders make a block of their own, which comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block, where the order column counts rows.
BLOCK = 4096
BLOCK_COLUMN = "block__"


def cut(df: DataFrame, key: str, order: str, size: int = BLOCK) -> DataFrame:
    """``df`` with its block, dealt by sequence and block."""
    return df.withColumn(BLOCK_COLUMN, F.floor(F.col(order) / size)).repartition(key, BLOCK_COLUMN)


def within(key: str) -> WindowSpec:
    return Window.partitionBy(key, BLOCK_COLUMN)


def along(key: str) -> WindowSpec:
    """Over one row a block."""
    return Window.partitionBy(key).orderBy(BLOCK_COLUMN)


def joined(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    return rows.join(blocks, [key, BLOCK_COLUMN])


def neighbours(rows: DataFrame, key: str, order: str, value: Column, before: str | None = "before", after: str | None = "after") -> DataFrame:
    """``rows`` of ``cut`` with ``value`` of the row before and after each (null at the ends of a sequence)."""
    held = F.struct(value.alias("v"))
    ends = rows.groupBy(key, BLOCK_COLUMN).agg(F.min_by(held, order).alias("first"), F.max_by(held, order).alias("last"))
    crossing = ends.select(key, BLOCK_COLUMN, F.lag("last").over(along(key)).alias("last__"), F.lead("first").over(along(key)).alias("first__"))
    both, w = joined(rows, crossing, key), within(key).orderBy(order)
    named = {before: F.coalesce(F.lag(held).over(w), F.col("last__"))["v"], after: F.coalesce(F.lead(held).over(w), F.col("first__"))["v"]}
    return both.withColumns({name: c for name, c in named.items() if name}).drop("last__", "first__")


def running_sum(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` of ``cut`` with the sum of ``value`` up to each row."""
    valued = rows.withColumn("value__", value)
    sums = valued.groupBy(key, BLOCK_COLUMN).agg(F.sum("value__").alias("sum__"))
    carried = sums.select(key, BLOCK_COLUMN, (F.sum("sum__").over(along(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum__")).alias("carry__"))
    own = F.sum("value__").over(within(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return joined(valued, carried, key).withColumn(name, own + F.col("carry__")).drop("value__", "carry__")


def nearest_known(rows: DataFrame, key: str, order: str, value: Column, below: str | None, above: str | None) -> DataFrame:
    """``rows`` of ``cut`` with the known (not null) ``value`` of largest order up to each row's, and of smallest order from it on.

    ``value`` rises with ``order``, so these are a maximum and a minimum.
    """
    valued = rows.withColumn("value__", value)
    ends = valued.groupBy(key, BLOCK_COLUMN).agg(F.min("value__").alias("low__"), F.max("value__").alias("high__"))
    back, ahead = along(key).rowsBetween(Window.unboundedPreceding, -1), along(key).rowsBetween(1, Window.unboundedFollowing)
    crossing = ends.select(key, BLOCK_COLUMN, F.max("high__").over(back).alias("high__"), F.min("low__").over(ahead).alias("low__"))
    both, w = joined(valued, crossing, key), within(key).orderBy(order)
    up = F.max("value__").over(w.rangeBetween(Window.unboundedPreceding, 0))
    # Backwards by a falling order; a frame that reaches to the end would be summed up anew for each row.
    down = F.min("value__").over(within(key).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0))
    named = {below: F.coalesce(up, F.col("high__")), above: F.coalesce(down, F.col("low__"))}
    return both.withColumns({name: c for name, c in named.items() if name}).drop("value__", "low__", "high__")
