"""Connected components of a link table by alternating large and small stars.

Every round is a handful of grouped minima and joins, written to the shared folder, so
no list of neighbours is ever gathered and the lineage stays short. Self-links and
repeated links do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node of its component) for every node of ``edges`` (columns ``u``, ``v``)."""
    work = materialize(edges.select("u", "v").where("u <> v").distinct(), "links")
    before = _state(work)
    while before[0]:
        work = materialize(_small_star(_large_star(work)), "stars")
        after = _state(work)
        if after == before:
            break
        before = after
    member = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(work.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
