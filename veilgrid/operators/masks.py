"""The keyed store of masks and faces, as tables: a log of changes, its state, and saved workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("video_id", "frame_index")
FACES, MASK, REMOVE, CLEAR = "faces", "mask", "remove", "clear"


def repaired_confidences(faces: Column, confidences: Column, least: Column) -> Column:
    """One confidence a face: those given if there are as many, else the least one (or 1) for each."""
    fill = F.coalesce(least, F.lit(1.0)).cast("float")
    return F.when(F.size(F.coalesce(confidences, F.array())) == F.size(faces), confidences).otherwise(F.array_repeat(fill, F.size(faces)))


def bounds_only(faces: Column) -> Column:
    return F.transform(faces, lambda f: F.struct(f["x"], f["y"], f["w"], f["h"]))


def confidences_only(faces: Column) -> Column:
    return F.transform(faces, lambda f: f["conf"])


def after_changes(log: DataFrame) -> DataFrame:
    """The state that a log leaves: a row a frame that has a stored mask or faces (``stored``, ``faces``).

    ``log`` has ``video_id, frame_index, seq, op, faces, width, height``. Setting a mask takes
    the frame's faces away; setting faces without any, or without a size, removes them; a clear
    (without frame) takes all of its video. The latest change of a frame counts: sums and
    maxima by key, no replay.
    """
    cleared = log.where(F.col("op") == CLEAR).groupBy("video_id").agg(F.max("seq").alias("cleared"))
    live = log.where(F.col("op") != CLEAR).join(cleared, "video_id", "left").where("cleared is null or seq > cleared")
    has = (F.col("op") == FACES) & (F.size(F.coalesce("faces", F.array())) > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    latest = live.groupBy(*KEYS).agg(F.coalesce(F.bool_or(F.col("op") == MASK), F.lit(False)).alias("stored"), F.max_by(F.when(has, F.col("faces")), "seq").alias("faces"))
    return latest.where("stored or faces is not null")


def unprocessed(frames: DataFrame, stored: DataFrame, faces: DataFrame) -> DataFrame:
    """Frames that have neither a mask nor faces yet."""
    return frames.join(entries(stored, faces), list(KEYS), "left_anti")


def entries(stored: DataFrame, faces: DataFrame) -> DataFrame:
    """Keys of all frames with a mask or faces."""
    return stored.select(*KEYS).union(faces.select(*KEYS)).distinct()


def first_workspace(workspaces: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (``path, mode``) the first saved workspace (smallest ``seq``), letter case aside."""
    keyed = workspaces.select(F.lower("path").alias("path_key"), F.lower("mode").alias("mode_key"), F.struct("seq", "path", "mode").alias("row"))
    first = keyed.groupBy("path_key", "mode_key").agg(F.min("row").alias("row"))
    on = (F.lower(asked["path"]) == F.col("path_key")) & (F.lower(asked["mode"]) == F.col("mode_key"))
    return asked.join(first, on).select(asked["path"].alias("asked_path"), asked["mode"].alias("asked_mode"), "row.seq", "row.path", "row.mode")


def save_workspace(masks: DataFrame, workspaces: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masks and workspaces after ``saved`` workspaces (with ``indices``, the frames of their masks) replace those of their paths and modes."""
    new = saved.select(F.lower("path").alias("k"), F.lower("mode").alias("m"))
    on = lambda df: (F.lower(df["path"]) == F.col("k")) & (F.lower(df["mode"]) == F.col("m"))
    kept = workspaces.join(new, on(workspaces), "left_anti").unionByName(saved.drop("indices"), allowMissingColumns=True)
    files = saved.select("path", "mode", F.explode("indices").alias("mask_index"))
    return masks.join(new, on(masks), "left_anti").unionByName(files), kept


def load_masks(workspaces: DataFrame, files: DataFrame) -> DataFrame:
    """The mask indices of each workspace whose file is there: ``path, mode, mask_index``."""
    wanted = workspaces.select("path", "mode", F.explode("indices").alias("mask_index"))
    there = files.select(F.lower("path").alias("k"), F.lower("mode").alias("m"), F.col("mask_index").alias("i"))
    return wanted.join(there, (F.lower("path") == F.col("k")) & (F.lower("mode") == F.col("m")) & (F.col("mask_index") == F.col("i")), "left_semi")


def without_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows whose ``path`` is none of ``paths``, letter case aside; blank paths remove nothing."""
    gone = paths.where(F.trim("path") != "").select(F.lower("path").alias("k"))
    return rows.join(gone, F.lower(rows["path"]) == F.col("k"), "left_anti")


def evicted(opens: DataFrame, keep: int = 5) -> DataFrame:
    """Paths that fall out of the ``keep`` latest ones; their workspaces go too (see ``without_paths``)."""
    latest = opens.groupBy(F.lower("path").alias("key")).agg(F.max_by("path", "seq").alias("path"), F.max("seq").alias("seq"))
    kept = latest.orderBy(F.desc("seq")).limit(keep).select("key")
    return latest.join(kept, "key", "left_anti").select("path", "seq")


def restored(snapshots: DataFrame, default_span: float) -> DataFrame:
    """Snapshots with span, start and selected frame brought within their video (``total_frames``, ``fps``)."""
    span = F.when(F.col("span") <= 0, default_span).otherwise(F.col("span"))
    most = F.greatest(F.lit(0.0), F.col("total_frames") / F.col("fps") - span)
    frame = F.when(F.col("total_frames") <= 0, -1).otherwise(F.greatest(F.lit(0), F.least(F.col("selected"), F.col("total_frames") - 1)))
    return snapshots.withColumns({"view_start": F.greatest(F.lit(0.0), F.least(F.col("view_start"), most)), "span": span, "selected": frame})


def settings(saved: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """The latest saved settings of each user, with defaults for what was never set."""
    latest = saved.groupBy("user_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in defaults))
    return latest.select("user_id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


def nearest_option(value: Column, options: list[float], default: float, tolerance: float = 0.0001) -> Column:
    """The option that a saved value means, within the tolerance; else the default."""
    out = F.lit(default)
    for option in reversed(options):
        out = F.when(F.abs(value - option) < tolerance, option).otherwise(out)
    return out


def persisted_edits(edits: DataFrame) -> DataFrame:
    """Log rows of edited masks: frames with at least one change that was not undone become stored masks."""
    return edits.where("dirty").groupBy(*KEYS).agg(F.max("seq").alias("seq")).select(*KEYS, "seq", F.lit(MASK).alias("op"))


def not_undone(actions: DataFrame) -> DataFrame:
    """Strokes that no later undo takes back: an undo takes the latest stroke that is still there.

    ``actions`` has ``video_id, frame_index, seq, undo``. Walking backwards from a stroke, it is undone
    when the undos after it outnumber the strokes after it at some point: a running
    balance and its suffix maximum, in two windows.
    """
    order = Window.partitionBy(*KEYS).orderBy("seq")
    # An undo with nothing to take back does nothing: the balance never falls below zero.
    step = F.when(F.col("undo"), -1).otherwise(1)
    raw = actions.withColumn("raw", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.least(F.lit(0), F.min("raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = raw.withColumn("level", F.col("raw") - floor)
    later = Window.partitionBy(*KEYS).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return level.withColumn("least", F.min("level").over(later)).where(~F.col("undo") & (F.col("least") >= F.col("level"))).drop("raw", "level", "least")


def dirty_rects(strokes: DataFrame, width: int, height: int) -> DataFrame:
    """The box of each frame's strokes (``cx, cy, radius``) within the picture, half-open; none where all lie outside."""
    r = F.col("radius")
    box = strokes.groupBy(*KEYS).agg(
        F.greatest(F.lit(0), F.min(F.col("cx") - r)).alias("x0"), F.greatest(F.lit(0), F.min(F.col("cy") - r)).alias("y0"),
        F.least(F.lit(width), F.max(F.col("cx") + r + 1)).alias("x1"), F.least(F.lit(height), F.max(F.col("cy") + r + 1)).alias("y1"),
    )
    return box.where("x0 < x1 and y0 < y1")
