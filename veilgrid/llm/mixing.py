"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is how often each of its documents is wanted. The whole
part of that number is taken outright; the rest is an inclusion probability. The cube
method moves the probabilities of three documents at a time along a vector in the null
space of the constraints (words and documents keep their totals) until one of them is 0
or 1. Blocks of documents of one source are worked off in parallel; the at most two
documents that a block leaves open meet in the blocks of the next round, and the last
block of a source lands: words are balanced first, the document count is given up, and of
the few ways to round what is left the one with the smallest error in words is taken,
after documents of the block made good for what they can. Documents go from large to
small, so what is left to land is small.

Cases: a null text has size 0, and documents of size 0 are never taken; a null source is
a source of its own, the last in order; repeated rows are documents of their own, which are counted,
then numbered, and dealt to blocks by their numbers; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import materialize, working_for

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 2000
#: Repeated rows that are numbered together.
TOGETHER = 4096
LANDED = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """For each ``source``: ``source_size``, ``documents``, ``target``.

    Sources are ranked without gathering them in one task: by ranges, with an offset for
    each range. The level up to which targets rise is found from sums alone.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("documents"))
    unnamed = F.col("source").isNull()
    ranged = materialize(sums.repartitionByRange(unnamed, "source").withColumn("part", F.spark_partition_id()), "sources")
    offsets, before = [], 0
    for r in sorted(ranged.groupBy("part").count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "part int, before bigint")
    place = F.row_number().over(Window.partitionBy("part").orderBy(unnamed, "source")) + F.col("before") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = materialize(ranged.join(F.broadcast(starts), "part").withColumn("weight", weight), "weights")
    full = F.col("source_size") * most
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, open_weight = -1.0, None
    while True:
        is_full = F.col("weight") * F.lit(level) >= full
        row = ranked.agg(F.sum(F.when(is_full, full).otherwise(0)).alias("held"), F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"] or row["open"] == open_weight:
            break
        open_weight = row["open"]
        level = (whole - row["held"]) / open_weight
    return ranked.select("source", "source_size", "documents", F.least(full.cast("double"), F.col("weight") * F.lit(float(max(level, 0.0)))).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``chance`` to 0 or 1, keeping its sum and its sum weighted by ``size``; at most two stay open."""
    out = chance.tolist()
    sizes = size.tolist()
    draws = iter(rng.random(2 * len(out) + 8).tolist())
    held: list[int] = []
    queue = [i for i, p in enumerate(out) if LANDED < p < 1 - LANDED]
    at = 0

    def move(units: list[int], vector: list[float]) -> None:
        up = min((1 - out[i]) / v if v > 0 else out[i] / -v for i, v in zip(units, vector) if v)
        down = min(out[i] / v if v > 0 else (1 - out[i]) / -v for i, v in zip(units, vector) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(units, vector):
            p = out[i] + step * v
            out[i] = 0.0 if p < LANDED else 1.0 if p > 1 - LANDED else p

    while True:
        while len(held) < 3 and at < len(queue):
            held.append(queue[at])
            at += 1
        if len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            move(held, [b - c, c - a, a - b] if not a == b == c else [1, -1, 0])
        elif len(held) == 2 and sizes[held[0]] == sizes[held[1]]:
            move(held, [1, -1])
        else:
            break
        held = [i for i in held if 0.0 < out[i] < 1.0]
    return np.array(out)


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the chances that are still open, so that the words taken come closest to the words expected.

    Every rounding of the open ones is tried; documents of the block, from large to small,
    are taken or left where that lessens the error.
    """
    expected, best, least = float(chance @ size), np.rint(chance), np.inf
    is_open = np.flatnonzero((chance > LANDED) & (chance < 1 - LANDED))
    for ups in range(1 << len(is_open)):
        out = np.rint(chance)
        out[is_open] = [ups >> k & 1 for k in range(len(is_open))]
        error = float(out @ size) - expected
        for i in np.argsort(-size, kind="stable").tolist():
            change = size[i] if out[i] == 0 else -size[i]
            if abs(error + change) < abs(error):
                out[i], error = 1 - out[i], error + change
        if abs(error) < least:
            best, least = out, abs(error)
    return best


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``repeat``: 0, 1, ... for rows that are alike.

    They are counted where they lie; the counts of many are cut before the rows are made again, so no task makes more than ``TOGETHER`` of a kind.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows__"))
    parts = counted.withColumn("part__", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows__") / TOGETHER).cast("long") - 1)))
    apart = parts.repartition(*rows.columns, "part__")
    first = F.col("part__") * TOGETHER
    return apart.withColumn("repeat", F.explode(F.sequence(first, F.least(first + TOGETHER, F.col("rows__")) - 1))).drop("rows__", "part__")


def mix(df: DataFrame, keys: list[str], source_col: str = "source", size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 1) -> DataFrame:
    """Choose how often each row is taken.

    ``size`` defaults to the words of ``text``. Returns the ``keys`` columns, ``source``,
    ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (``copies * size``).
    Reruns on the same rows agree, whatever their order and partitions.
    """
    size = word_count(F.col("text")) if size is None else size
    names = [f"key{k}" for k in range(len(keys))]
    sizes = materialize(numbered(df.select(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True)), F.col(source_col).alias("source"), size.alias("size"))), "sizes")
    targets = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
        .withColumn("base", F.floor(F.col("rate") + LANDED).cast("int"))
        .withColumn("chance", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
        .withColumn("mark", F.xxhash64(*names, "size", F.lit(seed), "repeat"))
    )
    schema = rows.schema

    def work(block: pd.DataFrame) -> pd.DataFrame:
        working_for("veilgrid.llm.mixing")
        block = block.sort_values(["size", "mark"], ascending=[False, True], kind="stable")
        first = block["mark"].iloc[0]
        rng = np.random.default_rng([seed, int(first) & 0xFFFFFFFF, int(first) >> 32 & 0xFFFFFFFF, len(block)])
        sizes = block["size"].to_numpy(dtype=float)
        chance = flight(block["chance"].to_numpy(), sizes, rng)
        block["chance"] = land(chance, sizes) if block["blocks"].iloc[0] == 1 else chance
        return block.drop(columns=["block", "blocks"])

    is_open = (F.col("chance") > LANDED) & (F.col("chance") < 1 - LANDED)
    done, left, round_no = rows.where(~is_open), rows.where(is_open), 0
    while True:
        counts = left.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        if counts.isEmpty():
            break
        dealt = left.join(counts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(round_no)), F.col("blocks")))
        worked = materialize(dealt.groupBy("source", "block").applyInPandas(work, schema), "flight")
        done, left = done.unionByName(worked.where(~is_open)), worked.where(is_open)
        round_no += 1
    copies = (F.col("base") + F.rint("chance").cast("int")).alias("copies")
    return done.select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), "source", "size", "source_size", "target", copies, (copies * F.col("size")).cast("long").alias("taken"))
