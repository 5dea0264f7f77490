"""Detection over frames: detector plug-ins, filters by area and pixel statistics, regions, tracking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.geometry import f32

#: A detector maps a batch of frames to faces: it is made once in each task and called with Arrow batches.
Detector = Callable[[pa.RecordBatch], pa.RecordBatch]

LEAST_AREA, LEAST_ASPECT, MOST_ASPECT = 0.001, 0.5, 2.0
BYPASS = 0.85
PAD, LEAST_PAD, LEAST_SIDE = 0.35, 32.0, 64.0
MOST_SHARE = 0.9


def detect(frames: DataFrame, make: Callable[[], Detector], schema: str) -> DataFrame:
    """Faces of all frames by a detector; frames are independent, so this needs no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = make()
        for batch in batches:
            yield detector(batch)

    return frames.mapInArrow(run, schema)


def passes_area(w: Column, h: Column, width: int, height: int) -> Column:
    """Large enough and neither flat nor narrow; all pass where a frame is so small that a pixel would do."""
    least = max(1.0, float(width) * height) * LEAST_AREA
    if least <= 1.0:
        return F.lit(True)
    aspect = F.when(h > 0, w / h).otherwise(0.0)
    return (F.greatest(F.lit(0.0), w * h) >= least) & aspect.between(LEAST_ASPECT, MOST_ASPECT)


def filter_faces(faces: DataFrame, stats: DataFrame | None, width: int, height: int) -> DataFrame:
    """Faces that pass by area and, unless their confidence is high, by the pixel statistics (``face keys, passed``).

    Without statistics, or for a face that has none, area alone decides.
    """
    by_area = faces.where(passes_area(F.col("w"), F.col("h"), width, height))
    if stats is None:
        return by_area
    keys = ["video_id", "frame_index", "face_idx"]
    judged = by_area.join(stats.select(*keys, "passed"), keys, "left")
    return judged.where((F.col("conf") >= f32(BYPASS)) | F.coalesce("passed", F.lit(True))).select(*faces.columns)


def region_of_faces(spine: DataFrame, faces: DataFrame, width: int, height: int) -> DataFrame:
    """The padded box around all faces of each frame, 64 pixels at least, within the frame; the whole frame without faces."""
    hull = faces.groupBy("video_id", "frame_index").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    rows = spine.select("video_id", "frame_index").join(hull, ["video_id", "frame_index"], "left")

    def sides(low: str, high: str, size: float) -> tuple[Column, Column]:
        a, b, end = F.col(low), F.col(high), F.lit(float(size))
        pad = F.greatest(F.greatest(F.lit(1.0), b - a) * PAD, F.lit(LEAST_PAD))
        begin, stop = F.greatest(F.lit(0.0), a - pad), F.least(end, b + pad)
        small = (stop - begin) < LEAST_SIDE
        shifted = F.greatest(F.lit(0.0), begin - (LEAST_SIDE - (stop - begin)) / 2)
        grown = F.least(end, shifted + LEAST_SIDE)
        begin, stop = F.when(small, F.greatest(F.lit(0.0), grown - LEAST_SIDE)).otherwise(begin), F.when(small, grown).otherwise(stop)
        return F.when(a.isNull(), 0.0).otherwise(begin), F.when(a.isNull(), end).otherwise(stop)

    (left, right), (top, bottom) = sides("x0", "x1", width), sides("y0", "y1", height)
    placed = rows.select("video_id", "frame_index", left.alias("x"), top.alias("y"), right.alias("r"), bottom.alias("b"))
    return placed.select("video_id", "frame_index", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


def region_usable(w: Column, h: Column, width: int, height: int) -> Column:
    """A region is worth a search of its own if it is not tiny and leaves out a good part of the frame."""
    return (w >= LEAST_SIDE) & (h >= LEAST_SIDE) & ~((w >= width * MOST_SHARE) & (h >= height * MOST_SHARE))


def region_first(spine: DataFrame, faces: DataFrame, width: int, height: int) -> DataFrame:
    """How each frame is searched, given the faces of the frame before it: ``attempt``, ``hit``, ``area``.

    The region around the last faces is searched first; a hit needs a face with its centre
    inside. Else, and without a usable region, the whole frame is searched.
    """
    regions = region_of_faces(spine, faces, width, height).join(faces.select("video_id", "frame_index").distinct(), ["video_id", "frame_index"], "left_semi")
    before = regions.withColumn("frame_index", F.col("frame_index") + 1).where(region_usable(F.col("w"), F.col("h"), width, height))
    region = before.select("video_id", "frame_index", F.struct("x", "y", "w", "h").alias("region"))
    centres = faces.select("video_id", "frame_index", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    rows = spine.select("video_id", "frame_index").join(region, ["video_id", "frame_index"], "left").join(centres, ["video_id", "frame_index"], "left")
    inside = F.col("cx").between(F.col("region.x"), F.col("region.x") + F.col("region.w")) & F.col("cy").between(F.col("region.y"), F.col("region.y") + F.col("region.h"))
    hit = F.coalesce(F.bool_or(F.coalesce(inside, F.lit(False))), F.lit(False))
    return rows.groupBy("video_id", "frame_index").agg(F.max(F.col("region").isNotNull()).alias("attempt"), hit.alias("hit"), F.max(F.rint(F.col("region.w") * F.col("region.h")).cast("bigint")).alias("area"))


def region_summary(searched: DataFrame) -> DataFrame:
    """By video: attempts, hits, searches of whole frames, mean area of the attempts (rounded areas)."""
    one = lambda c: F.sum(c.cast("bigint"))
    sums = searched.groupBy("video_id").agg(one(F.col("attempt")).alias("attempts"), one(F.col("attempt") & F.col("hit")).alias("hits"), one(~(F.col("attempt") & F.col("hit"))).alias("fallbacks"), F.coalesce(F.sum(F.when(F.col("attempt"), F.col("area"))), F.lit(0)).alias("area"))
    return sums.select("video_id", "attempts", "hits", "fallbacks", F.when(F.col("attempts") > 0, F.rint(F.col("area") / F.col("attempts"))).otherwise(0.0).alias("avg_area"))


def _held(every: int, tracking: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, last = None, None
        for batch in batches:
            detected, source = [], []
            for v, frame, any_faces in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if v != video:
                    video, last = v, None
                look = every <= 1 or frame % every == 0 or last is None
                if look:
                    last = frame if any_faces else None
                detected.append(look)
                source.append(last if look or tracking else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(detected, pa.bool_()), pa.array(source, pa.int64())], names=["video_id", "frame_index", "detected", "held_from"])

    return run


def hold_last(frames: DataFrame, every: int, tracking: bool = True) -> DataFrame:
    """Detection each ``every`` frames, or at once while nothing is held; with ``tracking`` the frames between keep the last faces.

    ``frames`` has a row a frame that is to be processed with ``faces``, what a detector would find. Returns ``video_id,
    frame_index, detected, held_from, faces``. One ordered pass by video decides which frame's
    faces count and carries that frame's number alone; a join brings the faces.
    """
    flags = frames.select("video_id", F.col("frame_index").cast("bigint").alias("frame_index"), (F.size("faces") > 0).alias("any"))
    done = flags.repartition("video_id").sortWithinPartitions("video_id", "frame_index").mapInArrow(_held(every, tracking), "video_id bigint, frame_index bigint, detected boolean, held_from bigint")
    found = frames.select("video_id", F.col("frame_index").alias("held_from"), "faces")
    return done.join(found, ["video_id", "held_from"], "left").select("video_id", "frame_index", "detected", "held_from", "faces")


STUB_SCHEMA = "video_id bigint, frame_index bigint, x double, y double, w double, h double, conf float"


def stub_detector() -> Detector:
    """A detector without a model, for tests and plans: a face whose place follows from the frame number, on most frames."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        frame = batch.column(1).to_numpy()
        keep = frame % 9 != 4
        seen = frame[keep]
        columns = [batch.column(0).filter(pa.array(keep)), pa.array(seen), *(pa.array(v.astype("float64")) for v in (seen * 7 % 1000, seen * 3 % 500, 0 * seen + 96, 0 * seen + 128))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(((50 + seen % 50) / 100).astype("float32"))], names=["video_id", "frame_index", "x", "y", "w", "h", "conf"])

    return found


def analysis_rows(spine: DataFrame, by_frame: DataFrame) -> DataFrame:
    """Per frame its time, whether it has a face (confidence 1 or 0), and the first face's box."""
    rows = spine.join(by_frame, ["video_id", "frame_index"], "left").withColumn("first", F.get("faces", F.lit(0)))
    has = F.col("first").isNotNull()
    return rows.select("video_id", "frame_index", (F.col("frame_index") / F.col("fps")).alias("time_s"), has.alias("has_face"), has.cast("double").alias("confidence"), "first.x", "first.y", "first.w", "first.h")


def overlays(by_frame: DataFrame) -> DataFrame:
    """Frames whose boxes are drawn: the overlay is on and there is one at least."""
    return by_frame.where(F.col("overlay") & (F.size("faces") > 0))
