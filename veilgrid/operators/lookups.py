"""As-of, nearest and neighbour lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.operators.blocked import BLOCK, cut, nearest_known


def asof_forward(asks: DataFrame, rows: DataFrame, key: str, at: str, value: str, size: int = BLOCK) -> DataFrame:
    """For each ask the first ``value`` of its key that is not below ``at``: blocks of ``size`` in order, no join of ranges."""
    both = asks.select(key, F.col(at).alias("v"), F.lit(1).alias("is_ask"), F.struct(*asks.columns).alias("ask")).unionByName(
        rows.select(key, F.col(value).alias("v"), F.lit(0).alias("is_ask")), allowMissingColumns=True
    )
    found = nearest_known(cut(both, key, "v", size), key, "v", F.when(F.col("is_ask") == 0, F.col("v")), None, value)
    return found.where("is_ask = 1").select("ask.*", value)


def nearest_step(frames: DataFrame, keys: DataFrame, step: int, size: int = BLOCK) -> DataFrame:
    """The key nearest to each frame (columns ``video_id, frame_index`` and ``video_id, k``): the rounded step if it
    is a key, else the closest, the smaller one on ties."""
    exact = keys.select(F.col("video_id").alias("kv"), F.col("k").alias("exact"))
    wanted = (F.rint(F.col("frame_index") / step) * step).cast("bigint")
    hit = frames.withColumn("want", wanted).join(exact, (F.col("video_id") == F.col("kv")) & (F.col("want") == F.col("exact")), "left").drop("kv", "want")
    both = hit.select("video_id", F.col("frame_index").alias("p"), "frame_index", "exact", F.lit(None).cast("bigint").alias("k")).unionByName(
        keys.select("video_id", F.col("k").alias("p"), F.lit(None).cast("bigint").alias("frame_index"), F.lit(None).cast("bigint").alias("exact"), "k")
    )
    near = nearest_known(cut(both, "video_id", "p", size), "video_id", "p", F.col("k"), "below", "above").where("frame_index is not null")
    closest = F.when(F.col("above").isNull() | (F.col("frame_index") - F.col("below") <= F.col("above") - F.col("frame_index")), F.col("below")).otherwise(F.col("above"))
    return near.select("video_id", "frame_index", F.coalesce("exact", closest).alias("k"))


def circular_neighbours(frames: DataFrame, marks: DataFrame, size: int = BLOCK) -> DataFrame:
    """For each frame the next and the previous marked frame, going round at the ends."""
    # Doubled, so that a frame's own mark lies between the places before and after it.
    both = frames.select("video_id", (F.col("frame_index") * 2).alias("p"), "frame_index", F.lit(None).cast("bigint").alias("mark"), F.lit(0).alias("side"))
    ask = both.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("p", F.col("p") + F.col("side"))
    placed = ask.unionByName(marks.select("video_id", (F.col("frame_index") * 2).alias("p"), F.lit(None).cast("bigint").alias("frame_index"), F.col("frame_index").alias("mark"), F.lit(0).alias("side")))
    near = nearest_known(cut(placed, "video_id", "p", 2 * size), "video_id", "p", F.col("mark"), "below", "above").where("side <> 0")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    sides = near.groupBy("video_id", "frame_index").agg(pick(1, "above").alias("next"), pick(-1, "below").alias("prev"))
    ends = marks.groupBy("video_id").agg(F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))
    return sides.join(ends, "video_id", "left").select("video_id", "frame_index", F.coalesce("next", "first").alias("next_mark"), F.coalesce("prev", "last").alias("prev_mark"))


def nth_frame(frames: DataFrame, n: int) -> DataFrame:
    """The frame that is reached after ``n`` others of its video, by time stamp; videos with fewer have none."""
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("pts"))
    return frames.withColumn("place", order).where(F.col("place") == n + 1).drop("place")
