"""Detection over the frames of a video in order, as one loop: look, filter, hold, carry.

A frame is looked at each ``every`` frames, or at once while nothing is held. The region around the
held faces is searched first, and only where the detector finds nothing in it, or there is no usable region,
the whole frame. What is found is filtered by area, aspect and the statistics of the frame's own
pixels (a sure face needs none); the rest is held. With ``tracking`` the frames between keep the held
faces. Frames with a stored mask are passed over and leave what is held as it is.

What is searched depends on what was held, so a video is one chain of steps: videos are worked side by
side, and a worker keeps no more of a video than the held faces. As a stream the held faces are the state of the video.

Cases: frames need not be without gaps; of repeated frames the first counts, and a frame that comes to the stream
after a later one is dropped; null faces are none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilgrid.operators.detect import BYPASS, LEAST_AREA, LEAST_ASPECT, LEAST_PAD, LEAST_SIDE, MOST_ASPECT, MOST_SHARE, PAD
from veilgrid.operators.pictures import face_statistics
from veilgrid.operators.rasters import Box, Reader, tasks

#: x, y, w, h and confidence.
Face = tuple[float, float, float, float, float]
FACES = "array<struct<x:double,y:double,w:double,h:double,conf:float>>"
SCHEMA = f"video_id bigint, frame_index bigint, detected boolean, attempt boolean, hit boolean, calls int, area double, held_from bigint, faces {FACES}"


@dataclass
class Frame:
    """What a detector gets: where the frame is, its picture when asked for, and what is known of it."""

    video_id: int
    frame_index: int
    reader: Reader
    known: list[Face]

    @property
    def picture(self) -> np.ndarray:
        return self.reader(self.video_id, self.frame_index)


#: Finds the faces of a frame within a box of whole pixels (x0, y0, x1, y1), in the frame's coordinates.
Detector = Callable[[Frame, Box], list[Face]]


def known_faces(frame: Frame, box: Box) -> list[Face]:
    """A detector without a model: the known faces with their centre in the box."""
    x0, y0, x1, y1 = box
    return [f for f in frame.known if x0 <= f[0] + f[2] / 2 < x1 and y0 <= f[1] + f[3] / 2 < y1]


def sometimes_blind(frame: Frame, box: Box) -> list[Face]:
    """Like ``known_faces``, but each seventh frame it finds nothing in a box that begins inside the frame."""
    return [] if frame.frame_index % 7 == 3 and box[:2] != (0, 0) else known_faces(frame, box)


def _side(low: float, high: float, size: float) -> tuple[float, float]:
    pad = max(max(1.0, high - low) * PAD, LEAST_PAD)
    begin, stop = max(0.0, low - pad), min(size, high + pad)
    if stop - begin < LEAST_SIDE:
        stop = min(size, max(0.0, begin - (LEAST_SIDE - (stop - begin)) / 2) + LEAST_SIDE)
        begin = max(0.0, stop - LEAST_SIDE)
    return begin, stop


def search_box(faces: list[Face], width: int, height: int) -> tuple[Box, float] | None:
    """The box around faces that is worth a search of its own, and its area before it is cut to pixels; None if there is none."""
    left, right = _side(min(f[0] for f in faces), max(f[0] + f[2] for f in faces), float(width))
    top, bottom = _side(min(f[1] for f in faces), max(f[1] + f[3] for f in faces), float(height))
    w, h = right - left, bottom - top
    if w < LEAST_SIDE or h < LEAST_SIDE or w >= width * MOST_SHARE and h >= height * MOST_SHARE:
        return None
    x0, y0 = int(np.floor(left)), int(np.floor(top))
    return (x0, y0, min(width, x0 + int(np.ceil(w))), min(height, y0 + int(np.ceil(h)))), w * h


@dataclass
class Loop:
    """One video's loop; ``held`` are the faces that are carried, found in frame ``held_from``."""

    width: int
    height: int
    every: int
    tracking: bool
    detector: Detector
    reader: Reader
    held: list[Face] = field(default_factory=list)
    held_from: int | None = None

    def passes(self, frame: Frame, face: Face) -> bool:
        x, y, w, h, conf = face
        least = max(1.0, float(self.width) * self.height) * LEAST_AREA
        if least <= 1.0:
            return True
        ratio = w / h if h > 0 else 0.0
        if max(0.0, w * h) < least or not LEAST_ASPECT <= ratio <= MOST_ASPECT:
            return False
        return np.float32(conf) >= np.float32(BYPASS) or face_statistics(frame.picture, x, y, w, h)[-1]

    def step(self, video: int, index: int, stored: bool, known: list[Face]) -> tuple:
        """Take the next frame; a row of SCHEMA."""
        if stored:
            return (video, index, False, False, False, 0, None, None, [])
        look = self.every <= 1 or index % self.every == 0 or not self.held
        if not look:
            kept = self.held if self.tracking else []
            return (video, index, False, False, False, 0, None, self.held_from if kept else None, kept)
        frame, found, calls, area = Frame(video, index, self.reader, known), [], 0, None
        box = search_box(self.held, self.width, self.height) if self.held else None
        if box:
            found, area, calls = self.detector(frame, box[0]), box[1], 1
        hit = bool(found)
        if not hit:
            found, calls = self.detector(frame, (0, 0, self.width, self.height)), calls + 1
        self.held = [f for f in found if self.passes(frame, f)]
        self.held_from = index if self.held else None
        return (video, index, True, box is not None, hit, calls, area, self.held_from, self.held)


def _known(faces: list[dict] | None) -> list[Face]:
    return [(f["x"], f["y"], f["w"], f["h"], f["conf"]) for f in faces or []]


def _as_rows(faces: list[Face]) -> list[dict]:
    return [dict(zip(("x", "y", "w", "h", "conf"), f, strict=True)) for f in faces]


def _columns(frames: DataFrame) -> DataFrame:
    """The columns that the loop reads, of any input that has them."""
    faces = F.transform("faces", lambda f: F.struct(*(f[c].cast("double").alias(c) for c in "xywh"), f["conf"].cast("float").alias("conf")))
    return frames.select(F.col("video_id").cast("bigint"), F.col("frame_index").cast("bigint"), F.coalesce(F.col("stored"), F.lit(False)).alias("stored"), faces.alias("faces")).where("video_id is not null and frame_index is not null")


def detection_loop(frames: DataFrame, width: int, height: int, every: int, detector: Detector, reader: Reader, tracking: bool = True) -> DataFrame:
    """The loop over all videos: ``frames`` has ``video_id, frame_index, stored, faces`` (known to the detector). Returns SCHEMA."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, loop = None, None, None
        for batch in batches:
            rows = []
            for video, index, stored, faces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if video != held:
                    held, last, loop = video, None, Loop(width, height, every, tracking, detector, reader)
                if index != last:
                    *row, found = loop.step(video, index, stored, _known(faces))
                    rows.append((*row, _as_rows(found)))
                    last = index
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)], schema=arrow)

    return _columns(frames).repartition(tasks(frames), "video_id").sortWithinPartitions("video_id", "frame_index").mapInArrow(run, SCHEMA)


class LoopProcessor(StatefulProcessor):
    """The loop over a stream: the held faces, and the last frame taken, are the state of a video."""

    def __init__(self, make: Callable[[], Loop]):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", f"last bigint, held_from bigint, faces {FACES}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        loop, last = self.make(), None
        if self.state.exists():
            last, loop.held_from, faces = self.state.get()
            loop.held = [tuple(f) for f in faces or []]
        out = []
        for row in pd.concat(rows).sort_values("frame_index", kind="stable").itertuples():
            if last is None or row.frame_index > last:
                known = [] if row.faces is None else [dict(f) if isinstance(f, dict) else f.asDict() for f in row.faces]
                *values, found = loop.step(key[0], row.frame_index, row.stored, _known(known))
                out.append((*values, _as_rows(found)))
                last = row.frame_index
        self.state.update((last, loop.held_from, [tuple(f) for f in loop.held]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        yield frame.astype({"held_from": "Int64", "area": "float64", "calls": "int32"})

    def close(self) -> None:
        pass


def detection_stream(frames: DataFrame, width: int, height: int, every: int, detector: Detector, reader: Reader, tracking: bool = True) -> DataFrame:
    """``detection_loop`` over a stream whose frames come in order, in whatever batches."""

    def make() -> Loop:
        return Loop(width, height, every, tracking, detector, reader)

    return _columns(frames).groupBy("video_id").transformWithStateInPandas(LoopProcessor(make), SCHEMA, "Append", "None")


def call_summary(done: DataFrame) -> DataFrame:
    """By video: calls of the detector, regions tried, hits in them, searches of whole frames, and the mean area tried (rounded areas)."""
    one = lambda c: F.sum(c.cast("bigint"))
    sums = done.groupBy("video_id").agg(F.sum("calls").alias("calls"), one(F.col("attempt")).alias("attempts"), one(F.col("hit")).alias("hits"), one(F.col("detected") & ~F.col("hit")).alias("fallbacks"), F.coalesce(F.sum(F.rint("area")), F.lit(0.0)).alias("total"))
    return sums.select("video_id", "calls", "attempts", "hits", "fallbacks", F.when(F.col("attempts") > 0, F.rint(F.col("total") / F.col("attempts"))).otherwise(0.0).alias("avg_area"))
