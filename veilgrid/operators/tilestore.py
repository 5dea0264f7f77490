"""Edited masks as tiles with versions, and previews that are composed anew only where masks have changed.

A stroke gives each tile that it touches a new version: the tile's bytes after it, made from the version
of the stroke before that was there when it was drawn. An undo ends the latest stroke that is still there, and with
it its versions; what a tile shows is its latest version that has not ended. So an undo reads a few tiles again
and draws nothing.

Previews lie in a folder, partitioned by video and by ranges of ``PART`` frames. A refresh composes the
changed tiles and overwrites the partitions that hold some; files of the others stay as they are.

Cases: strokes wholly outside the picture touch nothing but count for undo; an undo without a stroke does nothing; tiles whose
strokes have all been undone are empty; of rows that repeat ``seq`` in a frame one counts; an empty log gives no tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgrid.operators.pictures import PIXELS, preview, separable_blurs
from veilgrid.operators.pixels import stamps
from veilgrid.operators.rasters import Reader, _batch, picture_size, tasks

TILE, PART = 30, 64
KEYS = ("video_id", "frame_index")
TILES = (*KEYS, "tx", "ty")
VERSIONS = "video_id bigint, frame_index bigint, tx int, ty int, seq bigint, ended bigint, alpha binary"
PREVIEWS = "video_id bigint, frame_index bigint, tx int, ty int, width int, height int, pixels binary"


def ended(actions: DataFrame) -> DataFrame:
    """The strokes of a log (``video_id, frame_index, seq, undo`` and others) with ``ended``, the undo that took each back, or null.

    Strokes and undos match like brackets: both ends of a pair meet at the same depth.
    """
    order = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    raw = actions.dropDuplicates([*KEYS, "seq"]).withColumn("raw", F.sum(F.when(F.col("undo"), -1).otherwise(1)).over(order))
    depth = raw.withColumn("depth", F.col("raw") - F.least(F.lit(0), F.min("raw").over(order)))
    before = F.coalesce(F.lag("depth").over(Window.partitionBy(*KEYS).orderBy("seq")), F.lit(0))
    paired = depth.withColumn("idle", F.col("undo") & (before == 0)).where("not idle").withColumn("at", F.col("depth") + F.col("undo").cast("int"))
    after = F.lead("seq").over(Window.partitionBy(*KEYS, "at").orderBy("seq"))
    return paired.withColumn("ended", after.cast("bigint")).where("not undo").drop("raw", "depth", "idle", "at", "undo")


def tiled(strokes: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """A row for each stroke and tile that it touches: ``seq, ended, radius, value`` and the ``centres`` of its stamps there."""
    r = F.col("radius")
    at = stamps(strokes.select(*KEYS, "seq", "ended", "cx", "cy", "tx", "ty", "radius", "value"))
    inside = at.where(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1))
    number = lambda c: F.floor(c / tile).cast("int")
    along = lambda c, most: F.explode(F.sequence(number(F.greatest(F.lit(0), F.col(c) - r)), number(F.least(F.lit(most - 1), F.col(c) + r))))
    placed = inside.select("*", along("cx", width).alias("tx")).select("*", along("cy", height).alias("ty"))
    away = lambda c, t, most: F.greatest(F.col(t) * tile - F.col(c), F.lit(0), F.col(c) - F.least(F.lit(most - 1), F.col(t) * tile + tile - 1))
    dx, dy = away("cx", "tx", width), away("cy", "ty", height)
    return placed.where(dx * dx + dy * dy <= r * r).groupBy(*TILES, "seq", "ended", "radius", "value").agg(F.collect_set(F.array("cx", "cy")).alias("centres"))


def versions(strokes: DataFrame, width: int, height: int, tile: int = TILE, held: DataFrame | None = None) -> DataFrame:
    """VERSIONS of the strokes of ``tiled``, on top of those that are ``held`` already (rows of VERSIONS, earlier than all strokes)."""
    new = strokes.withColumn("alpha", F.lit(None).cast("binary"))
    if held is not None:
        plain = {"radius": F.lit(0), "value": F.lit(0), "centres": F.array().cast("array<array<int>>")}
        new = new.unionByName(held.join(strokes.select(*TILES).distinct(), list(TILES), "left_semi").withColumns(plain), allowMissingColumns=True)
    columns = [*TILES, "seq", "ended", "radius", "value", "centres", "alpha"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None, []
        for batch in batches:
            out = []
            for *own, seq, end, radius, value, centres, alpha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    key, stack = own, []
                while stack and stack[-1][0] is not None and stack[-1][0] < seq:
                    stack.pop()
                x0, y0 = own[2] * tile, own[3] * tile
                wide, high = min(tile, width - x0), min(tile, height - y0)
                if alpha is None:
                    shown = stack[-1][1].copy() if stack else np.zeros((high, wide), np.uint8)
                    xs, ys = np.arange(x0, x0 + wide)[None, :], np.arange(y0, y0 + high)[:, None]
                    for cx, cy in centres:
                        shown[(xs - cx) ** 2 + (ys - cy) ** 2 <= radius * radius] = value
                    out.append((*own, seq, end, shown.tobytes()))
                else:
                    shown = np.frombuffer(alpha, np.uint8).reshape(high, wide)
                # What lies below a stroke that is never taken back is not seen again.
                stack = [(end, shown)] if end is None else [*stack, (end, shown)]
            yield _batch(out, VERSIONS)

    dealt = new.select(*(F.col(c).cast("bigint") if c in (*KEYS, "seq", "ended") else F.col(c) for c in columns)).repartition(tasks(strokes), *TILES)
    return dealt.sortWithinPartitions(*TILES, "seq").mapInArrow(run, VERSIONS)


def current(stored: DataFrame, at: Column | None = None) -> DataFrame:
    """``alpha`` of each tile as it is after action ``at`` (the end, if none is given): the latest version that has not ended."""
    live = stored.where(F.col("ended").isNull()) if at is None else stored.where((F.col("seq") <= at) & (F.col("ended").isNull() | (F.col("ended") > at)))
    return live.groupBy(*TILES).agg(F.max_by("alpha", "seq").alias("alpha"))


def extended(stored: DataFrame, log: DataFrame, width: int, height: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The store after more actions, ``log`` being the whole log, and the keys of the tiles that have changed.

    Strokes that the store has are not drawn again; their versions only learn whether they have ended.
    """
    strokes = ended(log)
    ends = strokes.select(*KEYS, "seq", F.col("ended").alias("ends"), F.lit(True).alias("known"))
    known = stored.join(ends, [*KEYS, "seq"])
    kept = known.withColumn("ended", F.col("ends")).select(*stored.columns)
    fresh = tiled(strokes.join(stored.select(*KEYS, "seq").distinct(), [*KEYS, "seq"], "left_anti"), width, height, tile)
    seen = known.groupBy(*KEYS).agg(F.max("seq").alias("seen"))
    # Strokes that touch nothing have no version; they are no news either.
    later = fresh.join(seen, list(KEYS), "left").where("seen is null or seq > seen").drop("seen")
    changed = known.where("not (ended <=> ends)").select(*TILES).union(later.select(*TILES)).distinct()
    return kept.unionByName(versions(later, width, height, tile, kept)), changed


def composed(masks: DataFrame, width: int, height: int, reader: Reader, radius: int, tile: int = TILE) -> DataFrame:
    """PREVIEWS of mask tiles (``alpha``; null is empty): the picture, blurred where the mask says so.

    A tile's blur comes from the tile and what lies within the radius around it; tiles that lie alike in their pictures are worked together.
    """

    def done(place: tuple, held: list[tuple]) -> list[tuple]:
        x0, y0, x1, y1, left, top = place
        around = np.stack([part for _, part, _ in held])
        inner = (slice(None), slice(y0 - top, y1 - top), slice(x0 - left, x1 - left))
        mask = np.stack([np.zeros((y1 - y0, x1 - x0), np.uint8) if a is None else np.frombuffer(a, np.uint8).reshape(y1 - y0, x1 - x0) for _, _, a in held])
        shown = preview(around[inner], separable_blurs(around, radius)[inner], mask)
        return [(*own, x1 - x0, y1 - y0, one.tobytes()) for (own, _, _), one in zip(held, shown, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None
        for batch in batches:
            out, waiting = [], {}
            for video, frame, tx, ty, alpha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (video, frame) != key:
                    key, part = (video, frame), picture_size(reader, video, frame)[2]
                x0, y0 = tx * tile, ty * tile
                x1, y1 = min(width, x0 + tile), min(height, y0 + tile)
                box = (max(0, x0 - radius), max(0, y0 - radius), min(width, x1 + radius), min(height, y1 + radius))
                place = (x0, y0, x1, y1, *box[:2])
                same = waiting.setdefault(place, [])
                same.append(((video, frame, tx, ty), part(video, frame, box), alpha))
                if len(same) * tile * tile >= PIXELS:
                    out += done(place, same)
                    same.clear()
            yield _batch(out + [row for place, same in waiting.items() if same for row in done(place, same)], PREVIEWS)

    dealt = masks.select(*TILES, "alpha").repartition(tasks(masks), *KEYS).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(run, PREVIEWS)


def write_previews(path: str, made: DataFrame) -> None:
    """Replace the partitions that ``made`` has rows of, and no others; tasks write aside, the commit moves whole partitions."""
    parted = made.withColumn("part", F.floor(F.col("frame_index") / PART))
    parted.repartition(tasks(made), "video_id", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id", "part").parquet(path)


def refresh_previews(spark: SparkSession, path: str, masks: DataFrame, changed: DataFrame, width: int, height: int, reader: Reader, radius: int, tile: int = TILE) -> None:
    """Compose the ``changed`` tiles anew from ``masks`` (all current tiles); the other tiles of their partitions are copied as they are."""
    new = composed(changed.join(masks, list(TILES), "left"), width, height, reader, radius, tile)
    parts = changed.select("video_id", F.floor(F.col("frame_index") / PART).alias("part")).distinct()
    stored = read_previews(spark, path)
    rest = stored.join(parts, ["video_id", "part"], "left_semi").join(changed.select(*TILES), list(TILES), "left_anti").drop("part")
    write_previews(path, new.unionByName(rest.select(*new.columns)))


def read_previews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREVIEWS + ", part bigint").parquet(path)
