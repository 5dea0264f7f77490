"""What an export decides and does, frame by frame, and what a run resumes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["video_id", "frame_index"]


def rate(num: Column, den: Column) -> Column:
    return num / F.when(den != 0, den)


def probed(streams: DataFrame) -> DataFrame:
    """Frame rate, frames and seconds of each stream row.

    Columns: ``avg_num, avg_den, r_num, r_den, duration, tb_num, tb_den, file_duration_us, nb_frames``.
    The rate is the average one, else the base one, else 30; frames are whole ones. ``export_frames``
    are those the stream states, else duration by rate (0 without either), rounded half to even.
    """
    known = F.when(F.col("avg_num") != 0, rate(F.col("avg_num"), F.col("avg_den"))).when(F.col("r_num") != 0, rate(F.col("r_num"), F.col("r_den")))
    in_file = F.when(F.col("file_duration_us") > 0, F.col("file_duration_us") / 1e6).otherwise(0.0)
    stated = F.col("duration") * rate(F.col("tb_num"), F.col("tb_den"))
    seconds = F.when(F.col("duration") > 0, stated).otherwise(in_file)
    export_seconds = F.when(F.col("duration") != 0, stated).otherwise(in_file)
    fps = F.coalesce(known, F.lit(30.0))
    guessed = F.when((F.coalesce(known, F.lit(0.0)) > 0) & (export_seconds > 0), F.rint(export_seconds * known)).otherwise(F.greatest(F.lit(0.0), F.col("nb_frames").cast("double")))
    export_frames = F.when(F.col("nb_frames") > 0, F.col("nb_frames").cast("double")).otherwise(guessed)
    return streams.select("video_id", fps.alias("fps"), F.greatest(F.lit(0), F.floor(seconds * fps)).cast("bigint").alias("total_frames"), F.greatest(F.lit(0.0), seconds).alias("duration_s"), export_frames.cast("bigint").alias("export_frames"))


def read_from(frames: DataFrame, starts: DataFrame) -> DataFrame:
    """Frames of a sequential read: those whose time stamp is not before the wanted one of ``starts`` (``video_id, at``)."""
    return frames.join(starts, "video_id").where("pts >= at").drop("at")


def encoder_choice(asked: DataFrame, containers: DataFrame, encoders: DataFrame, fallback: str = "h264", common: str = "yuv420p") -> DataFrame:
    """The encoder of each job: the input's codec if the container takes it and an encoder exists, else the fallback.

    ``asked``: ``job_id, container, codec, pix_fmt``; ``containers``: ``container, codec``;
    ``encoders``: ``codec, pix_fmts`` (null: all). Also the pixel format, and why the codec was not kept. These
    capability tables are small by nature: as many rows as there are codecs.
    """
    takes = containers.select("container", "codec", F.lit(True).alias("takes"))
    has = encoders.select("codec", "pix_fmts", F.lit(True).alias("has"))
    own = asked.join(takes, ["container", "codec"], "left").join(has, "codec", "left")
    reason = F.when(F.col("takes").isNull(), "container").when(F.col("has").isNull(), "encoder")
    picked = own.withColumn("reason", reason).withColumn("chosen", F.when(F.col("reason").isNull(), F.col("codec")).otherwise(fallback))
    formats = encoders.select(F.col("codec").alias("chosen"), F.col("pix_fmts").alias("chosen_fmts"))
    kept = F.col("chosen_fmts").isNull() | F.array_contains("chosen_fmts", F.col("pix_fmt"))
    return picked.join(formats, "chosen", "left").select("job_id", "chosen", F.when(kept, F.col("pix_fmt")).otherwise(common).alias("pix_fmt"), "reason")


def negotiated(listed: Column, preferred: Column, last: bool) -> Column:
    """The preferred one if it is listed or nothing is, else the first or the last listed."""
    other = F.element_at(listed, -1) if last else F.element_at(listed, 1)
    return F.when(listed.isNull() | (F.size(listed) == 0) | F.array_contains(listed, preferred), preferred).otherwise(other)


def audio_choice(container_takes: Column, transcodable: Column) -> Column:
    """Passed through, transcoded, or dropped."""
    return F.when(container_takes, "copy").when(transcodable, "aac").otherwise("drop")


def output_name(source: Column, taken: Column, choice: Column, number: Column) -> Column:
    """``<base>_blur.mp4``; on a conflict overwritten, or numbered (the first free ``number``, the plain name beyond 9999), or null if cancelled."""
    base = F.concat(F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit("_blur"))
    plain = F.concat(base, F.lit(".mp4"))
    numbered = F.when(number < 10_000, F.concat(base, F.lit(" ("), number.cast("string"), F.lit(").mp4"))).otherwise(plain)
    return F.when(~taken | (choice == "overwrite"), plain).when(choice == "save_as", numbered)


def export_plan(spine: DataFrame, stored: DataFrame, faces: DataFrame) -> DataFrame:
    """What happens to each frame: a stored mask before faces, the faces to blur, nothing for the others (``source, faces``)."""
    own = faces.groupBy(*KEYS).agg(F.count("*").alias("faces"))
    masks = stored.select(*KEYS).distinct().withColumn("is_stored", F.lit(True))
    kind = F.when(F.col("is_stored"), "stored").when(F.col("faces") > 0, "faces").otherwise("copy")
    return spine.select(*KEYS).join(masks, KEYS, "left").join(own, KEYS, "left").select(*KEYS, kind.alias("source"), F.when(kind == "faces", F.col("faces")).otherwise(0).alias("faces"))


def resume_needed(auto: Column, completed: Column, resume_index: Column) -> Column:
    return auto & ~completed & (resume_index > 0)


def still_to_do(spine: DataFrame, done: DataFrame, resume: DataFrame) -> DataFrame:
    """Frames of a run taken up again: from the resume frame on (that one included), without those that have an entry."""
    last = resume.select("video_id", F.greatest(F.lit(0), "resume_index").alias("resume_index"))
    rest = spine.join(last, "video_id", "left").where("frame_index >= coalesce(resume_index, 0)")
    return rest.join(done.select(*KEYS), KEYS, "left_anti").select(*KEYS)


def in_range(frames: DataFrame, start: Column, total: Column) -> DataFrame:
    """Frames from the start (brought within the video) up to the last one."""
    first = F.greatest(F.lit(0), F.least(start, total - 1))
    return frames.where((F.col("frame_index") >= first) & (F.col("frame_index") < total))


def current_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Results that are not stale: no newer request of their key was made before they were finished.

    ``requests``: ``key, stamp, asked_ms``; ``results``: ``key, stamp, done_ms``. Stamps rise with time,
    so a result stands if it is done before the key's next request: one window by key.
    """
    following = requests.select("key", "stamp", F.lead("asked_ms").over(Window.partitionBy("key").orderBy("stamp")).alias("next_ms"))
    return results.join(following, ["key", "stamp"]).where("next_ms is null or done_ms < next_ms").drop("next_ms")


def busy_progress(exporting: Column, export: Column, detecting: Column, detect: Column, loading: Column, load: Column) -> Column:
    """The progress to show: of the export, else of detection, else of loading; null if idle."""
    return F.when(exporting, export).when(detecting, detect).when(loading, load)


def perf_sums(log: DataFrame, stages: list[str], lot: int = 60) -> DataFrame:
    """Calls and milliseconds of each stage and of all, by video and lot of frames."""
    sums = log.withColumn("lot", F.expr(f"frame_index div {lot}")).groupBy("video_id", "lot").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in stages))
    return sums.withColumn("total_ms", sum((F.col(c) for c in stages), F.lit(0)))
