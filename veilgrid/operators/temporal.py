"""Repair of detections over time, and the classification of problem frames.

``frames`` has one row a frame: ``video_id, frame_index, stored, faces`` with faces an array
of struct<face_idx,x,y,w,h,conf>; frames with a stored mask hold no faces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veilgrid.functions.geometry import centre_distance, f32, floored_area, iou

WEAK, STRONG, LEAST_IOU, MOST_AREA, MOST_SHIFT = 0.5, 0.7, 0.2, 3.0, 0.5
LEAST_FRAMES = 3
FACE = "struct<face_idx:int,x:double,y:double,w:double,h:double,conf:float>"


def by_frame() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("frame_index")


def frames(spine: DataFrame, detections: DataFrame) -> DataFrame:
    """The spine with its faces; masks stored by hand take a frame's faces away."""
    face = F.struct("face_idx", "x", "y", "w", "h", "conf")
    grouped = detections.groupBy("video_id", "frame_index").agg(F.bool_or("stored").alias("stored"), F.sort_array(F.collect_list(face)).alias("all"))
    none = F.array().cast(f"array<{FACE}>")
    joined = spine.select("video_id", "frame_index").join(grouped, ["video_id", "frame_index"], "left")
    stored = F.coalesce("stored", F.lit(False))
    return joined.select("video_id", "frame_index", stored.alias("stored"), F.when(stored, none).otherwise(F.coalesce("all", none)).alias("faces"))


def gap_fill(frames: DataFrame) -> DataFrame:
    """Single empty frames between two with faces take the faces before them (``filled``); other columns pass through."""
    before, after = F.lag("faces").over(by_frame()), F.lead("faces").over(by_frame())
    empty = ~F.col("stored") & (F.size("faces") == 0) & (F.size(F.coalesce(before, F.array())) > 0) & (F.size(F.coalesce(after, F.array())) > 0)
    return frames.withColumn("filled", empty).withColumn("faces", F.when(F.col("filled"), before).otherwise(F.col("faces")))


def _overlaps(others: str) -> Column:
    """For each face its overlap with each of ``others``; negative where area or shift speak against a continuation."""

    def one(face: Column, other: Column) -> Column:
        ratio = floored_area(face) / floored_area(other)
        near = centre_distance(face, other) / F.greatest(F.lit(1.0), other["w"], other["h"]) <= MOST_SHIFT
        return iou(face, other) * F.when((ratio <= MOST_AREA) & (ratio >= 1 / MOST_AREA) & near, 1.0).otherwise(-1.0)

    return F.transform("faces", lambda f: F.transform(F.coalesce(others, F.array().cast(f"array<{FACE}>")), lambda o: one(f, o)))


def best_overlap(overlaps: list[float], survived: list[bool] | None = None) -> float:
    """The first of largest size among those that survived; 0 without one."""
    best = 0.0
    for k, x in enumerate(overlaps):
        if abs(x) > abs(best) and (survived is None or survived[k]):
            best = x
    return best


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which faces of each frame stay; frames come segment by segment, in order, and only the frame before is kept."""
    key, last = None, None
    for batch in batches:
        out = []
        for *now, ranks, before, after in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            kept = []
            for rank, b, a in zip(ranks, before, after, strict=True):
                if rank == 1:
                    own, ahead = best_overlap(b, last if now == key else None), best_overlap(a)
                    kept.append((own if abs(own) >= abs(ahead) else ahead) >= LEAST_IOU)
                else:
                    kept.append(rank == 2)
            key, last = now, kept
            out.append(kept)
        columns = [*(batch.column(k) for k in (0, 5, 6, 7)), pa.array(out, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, names=["video_id", "frame_index", "row", "faces", "kept"])


def consistency_filter(frames: DataFrame) -> DataFrame:
    """Drop weak faces, and middling ones that neither neighbour frame confirms; frames marked ``exempt`` keep theirs.

    A frame's outcome depends on the frame before it only through faces of middling
    confidence, so a video falls into short segments. What two faces are to each other is
    computed beforehand; the pass over a segment only carries which faces of the frame before survived.
    """
    exempt = F.col("exempt") if "exempt" in frames.columns else F.lit(False)
    rank = lambda f: F.when(exempt | (f["conf"] >= f32(STRONG)), 2).when(f["conf"] >= f32(WEAK), 1).otherwise(0)
    others = [c for c in frames.columns if c not in ("video_id", "frame_index", "faces")]
    seen = frames.withColumn("ranks", F.transform("faces", rank)).withColumn("before", F.lag("faces").over(by_frame())).withColumn("after", F.lead("faces").over(by_frame()))
    first = ~F.array_contains("ranks", 1) | (F.size(F.coalesce("before", F.array())) == 0)
    cut = seen.withColumn("segment", F.sum(first.cast("int")).over(by_frame()))
    rows = cut.select("video_id", "segment", "ranks", _overlaps("before").alias("before"), _overlaps("after").alias("after"), "frame_index", F.struct(*others).alias("row"), "faces")
    kind = rows.schema
    schema = f"video_id {kind['video_id'].dataType.simpleString()}, frame_index {kind['frame_index'].dataType.simpleString()}, row {kind['row'].dataType.simpleString()}, faces array<{FACE}>, kept array<boolean>"
    done = rows.repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "frame_index").mapInArrow(_survivors, schema)
    return done.select("video_id", "frame_index", *(F.col(f"row.{c}").alias(c) for c in others), F.filter("faces", lambda _, k: F.get("kept", k)).alias("faces"))


def run_filter(frames: DataFrame, least: int = 2) -> DataFrame:
    """Runs of frames with faces shorter than ``least`` lose them; frames marked ``exempt`` keep theirs."""
    has = F.size("faces") > 0
    order = F.row_number().over(Window.partitionBy("video_id", "has").orderBy("frame_index"))
    island = frames.withColumn("has", has).withColumn("island", F.col("frame_index") - order)
    length = F.count("*").over(Window.partitionBy("video_id", "has", "island"))
    short = F.col("has") & (length < least)
    if "exempt" in frames.columns:
        short &= ~F.col("exempt")
    return island.withColumn("faces", F.when(short, F.array().cast(f"array<{FACE}>")).otherwise(F.col("faces"))).select(*frames.columns)


def temporal_fix(frames: DataFrame, every: int = 1, tracking: bool = True) -> DataFrame:
    """Gap filling, consistency and run filters, for videos of three frames or more; shorter ones stay as they are.

    Frames detected only each ``every`` frames without ``tracking`` stay as they are too.
    """
    if every > 1 and not tracking:
        return frames
    total = F.count("*").over(Window.partitionBy("video_id"))
    fixed = run_filter(consistency_filter(gap_fill(frames.withColumn("exempt", total < LEAST_FRAMES))))
    return fixed.select(*frames.columns)


def write_back(frames: DataFrame) -> DataFrame:
    """The face data that is stored after the repair: frames with faces, with their least confidence; others are deleted."""
    return frames.where(~F.col("stored") & (F.size("faces") > 0)).withColumn("min_conf", F.array_min(F.transform("faces", lambda f: f["conf"])))


def explode_faces(frames: DataFrame) -> DataFrame:
    return frames.select("video_id", "frame_index", F.explode("faces").alias("f")).select("video_id", "frame_index", "f.face_idx", "f.conf")


def low_cutoff(threshold: float) -> Column:
    return F.greatest(f32(0.0), F.least(f32(0.99), (f32(threshold) + f32(0.05)).cast("float")))


def issues(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per frame and kind of issue a row: noface, lowconf, flicker."""
    has = F.size("faces") > 0
    around = F.coalesce(F.lag(has).over(by_frame()), F.lit(False)) & F.coalesce(F.lead(has).over(by_frame()), F.lit(False))
    seen = frames.select("video_id", "frame_index", has.alias("has"), F.array_min(F.transform("faces", lambda f: f["conf"])).alias("least"), around.alias("around"))
    kinds = F.array(F.when(~F.col("has"), "noface"), F.when(F.col("has") & (F.col("least") < low_cutoff(threshold)), "lowconf"), F.when(~F.col("has") & F.col("around"), "flicker"))
    return seen.select("video_id", "frame_index", F.explode(F.array_compact(kinds)).alias("issue"))
