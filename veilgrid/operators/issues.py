"""Lists of problem frames: resolving, hiding, merging, stepping through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.geometry import frame_time_text
from veilgrid.operators.lookups import asof_forward

KEYS = ["video_id", "frame_index"]
KINDS = ("noface", "lowconf", "flicker")
#: What users read.
LABELS = {"noface": "얼굴 없음", "lowconf": "신뢰도 낮음", "flicker": "연속 끊김"}


def resolved(issues: DataFrame, edited: DataFrame) -> DataFrame:
    """Issues of frames that nobody edited or resolved: such a frame leaves the lists of all kinds."""
    return issues.join(edited.select(*KEYS), KEYS, "left_anti")


def merged(issues: DataFrame) -> DataFrame:
    """Every frame with an issue once, in order."""
    return issues.select(*KEYS).distinct().orderBy(*KEYS)


def entries(issues: DataFrame, videos: DataFrame, edited: DataFrame, hide_resolved: bool) -> DataFrame:
    """Rows of the issue list: ``video_id, frame_index, issue, label, time_text, resolved, visible``."""
    marked = issues.join(edited.select(*KEYS).distinct().withColumn("resolved", F.lit(True)), KEYS, "left")
    named = marked.join(videos.select("video_id", "fps"), "video_id").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    label = F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), F.col("issue"))
    return named.select(*KEYS, "issue", label.alias("label"), frame_time_text(F.col("frame_index"), F.col("fps")).alias("time_text"), "resolved", visible(F.col("resolved"), hide_resolved).alias("visible"))


def visible(is_resolved: Column, hide_resolved: bool) -> Column:
    return ~is_resolved if hide_resolved else F.lit(True)


def shown(issues: DataFrame, kinds: list[str]) -> DataFrame:
    """Issues of the kinds that are switched on."""
    return issues.where(F.col("issue").isin(kinds))


def first_at_or_after(issues: DataFrame, targets: DataFrame) -> DataFrame:
    """For each ``video_id, target`` the first problem frame not before it (null if none) and the very first one of the video."""
    marks = issues.select("video_id", "frame_index").distinct()
    found = asof_forward(targets.select("video_id", "target"), marks, "video_id", "target", "frame_index")
    first = marks.groupBy("video_id").agg(F.min("frame_index").alias("first"))
    return found.join(first, "video_id", "left").select("video_id", "target", F.col("frame_index").alias("first_after"), "first")
