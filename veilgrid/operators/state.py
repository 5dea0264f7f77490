"""Keyed state as tables: recents, upserts, precedence, free names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recents(opens: DataFrame, keep: int = 5) -> DataFrame:
    """The latest opening of each path (letter case aside), newest first, at most ``keep``."""
    latest = opens.groupBy(F.lower("path").alias("key")).agg(F.max_by("path", "seq").alias("path"), F.max("seq").alias("seq"))
    return latest.orderBy(F.desc("seq")).limit(keep).select("path", "seq")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``state`` whose keys (letter case aside) are not in ``changes``, and the changes."""
    fold = lambda df, p: df.select("*", *(F.lower(k).alias(f"{p}{k}") for k in keys))
    left, right = fold(state, "l_"), fold(changes, "r_").select(*(f"r_{k}" for k in keys)).distinct()
    same = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return left.join(right, on, "left_anti").select(*state.columns).unionByName(changes)


def mask_source(spine: DataFrame, stored: DataFrame, faces: DataFrame) -> DataFrame:
    """Where each frame's mask comes from: a stored mask, else faces, else none."""
    keys = ["video_id", "frame_index"]
    a = stored.select(*keys).distinct().withColumn("is_stored", F.lit(True))
    b = faces.select(*keys).distinct().withColumn("has_faces", F.lit(True))
    kind = F.when(F.col("is_stored"), "stored").when(F.col("has_faces"), "faces").otherwise("none")
    return spine.select(*keys).join(a, keys, "left").join(b, keys, "left").select(*keys, kind.alias("source"))


def free_number(taken: DataFrame, most: int = 10_000) -> DataFrame:
    """The first number from 1 below ``most`` that is not in ``taken`` (column ``n``): the first gap of the sorted numbers."""
    own = taken.where(F.col("n").between(1, most - 1)).select("n").distinct()
    after = own.select((F.col("n") + 1).alias("m")).unionByName(own.sparkSession.range(1, 2).select(F.col("id").cast("int").alias("m")))
    free = after.join(own, F.col("m") == F.col("n"), "left_anti").where(F.col("m") < most)
    return free.agg(F.min("m").alias("n"))
