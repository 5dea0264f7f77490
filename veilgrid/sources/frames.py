"""A Spark data source of frames: pictures of videos, made or decoded where they are read.

``spark.read.format("frames")`` needs the options ``videos``, a JSON list of [video_id, frames, width,
height], as a listing of files would give it, and ``reader``, the dotted name of a function that
takes width and height and returns a reader of (video, frame). Each range of ``framesPerPartition``
frames is a partition. Conditions on ``video_id`` and ``frame_index`` are taken over by the source, so
a query for one frame reads one range, of it one frame; a detector after it sees that frame alone.

Cases: a video without frames has no partition; conditions that contradict each other, or
compare with null, give no partition; other conditions are left to Spark.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "video_id bigint, frame_index bigint, width int, height int, picture binary, made bigint"
KINDS = {"video_id": pa.int64(), "frame_index": pa.int64(), "width": pa.int32(), "height": pa.int32(), "picture": pa.binary(), "made": pa.int64()}
PUSHED = ("video_id", "frame_index")
#: Bytes of pictures in an Arrow batch.
BATCH_BYTES = 16 << 20


@dataclass
class Wanted:
    """What is asked of a column: bounds, and the values allowed if they are listed."""

    low: float = float("-inf")
    high: float = float("inf")
    values: set | None = None

    def add(self, f: Filter) -> bool:
        """Narrow by a condition; whether it is of a kind that can be taken over."""
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, (EqualTo, In)):
            allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.values = allowed if self.values is None else self.values & allowed
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def among(self, first: int, last: int) -> Iterable[int]:
        """The values of first to last (exclusive) that are wanted."""
        if self.values is not None:
            return sorted(v for v in self.values if v is not None and max(first, self.low) <= v <= min(last - 1, self.high))
        return range(int(max(first, self.low)), int(min(last - 1, self.high)) + 1)


@dataclass
class FrameRange(InputPartition):
    video_id: int
    width: int
    height: int
    frames: tuple[int, ...] | range


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.videos = json.loads(options["videos"])
        self.maker = options["reader"]
        self.each = int(options.get("framesPerPartition", "256"))
        self.wanted = {c: Wanted() for c in PUSHED}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column not in self.wanted or not self.wanted[column].add(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for video, frames, width, height in self.videos:
            if not self.wanted["video_id"].among(video, video + 1):
                continue
            wanted = self.wanted["frame_index"]
            for first in range(0, frames, self.each) if wanted.values is None else sorted({v // self.each * self.each for v in wanted.among(0, frames)}):
                chosen = wanted.among(first, min(frames, first + self.each))
                if chosen:
                    out.append(FrameRange(video, width, height, chosen if isinstance(chosen, range) else tuple(chosen)))
        return out or [FrameRange(0, 0, 0, ())]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        module, name = self.maker.rsplit(".", 1)
        picture = getattr(importlib.import_module(module), name)(partition.width, partition.height)
        each = max(1, BATCH_BYTES // max(1, partition.width * partition.height * 4))
        frames = list(partition.frames)
        for k in range(0, len(frames), each):
            rows = [(partition.video_id, f, partition.width, partition.height, picture(partition.video_id, f).tobytes(), k + j + 1) for j, f in enumerate(frames[k : k + each])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], type=t) for j, t in enumerate(KINDS.values())], names=list(KINDS))


class FrameSource(DataSource):
    """``made`` tells how many pictures the partition has made so far."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def read_frames(spark: SparkSession, videos: list[tuple[int, int, int, int]], reader: str, frames_per_partition: int = 256) -> DataFrame:
    """Frames of ``videos`` (id, number of frames, width, height) by the reader of this dotted name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").option("videos", json.dumps(videos)).option("reader", reader).option("framesPerPartition", str(frames_per_partition)).load()
