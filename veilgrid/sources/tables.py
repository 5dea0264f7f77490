"""Frame, detection, sample and pixel tables, derived from the event stream, and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEOS = 8
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "wmv", "webm")
STATE_SCHEMA = (
    "Recents array<struct<Title:string,Path:string,LastOpened:timestamp>>, "
    "Workspaces array<struct<VideoPath:string,Mode:string,SelectedFrameIndex:int,ViewStartSeconds:double,SecondsPerScreen:double,"
    "LastOpened:timestamp,MaskIndices:array<int>,AutoResumeIndex:int,AutoCompleted:boolean>>, "
    "AutoSettings struct<DownscaleRatio:double,DownscaleQuality:int,AutoTrackingEnabled:boolean,AutoDetectEveryNFrames:int,ParallelSessionCount:int,"
    "AutoUseOrtOptimization:boolean,AutoUseGpu:boolean,OrtThreads:int,AutoExportAfter:boolean,DetectionThreshold:double,ConfidenceThreshold:double,NmsThreshold:double,BlurRadius:int>"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def video_of(e: DataFrame) -> DataFrame:
    return e.withColumn("video_id", F.col("event_id") % VIDEOS).withColumn("frame_index", F.expr(f"event_id div {VIDEOS}"))


def video_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("video_id") % 4
    fps = F.when(slot == 0, 30.0).when(slot == 1, 25.0).when(slot == 2, 29.97).otherwise(24.0)
    frames = video_of(events(spark, sf_dir).select("event_id")).groupBy("video_id").agg((F.max("frame_index") + 1).alias("total_frames"))
    return frames.select("video_id", "total_frames", F.lit(1280).alias("width"), F.lit(720).alias("height"), fps.cast("double").alias("fps"))


def frame_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = video_meta(spark, sf_dir).where("total_frames > 0")
    return meta.select("video_id", "fps", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total_frames") - 1)).alias("frame_index"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = video_of(events(spark, sf_dir).select("event_id", "user_id", "event_type", "value").where("event_type <> 'error'"))
    f = e.withColumn("k", F.explode(F.when(F.col("value") > 60, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return f.selectExpr(
        "video_id", "frame_index", "k face_idx",
        "cast(k*300 + ((video_id*53)%200) + (frame_index%40)*3 + (user_id%4)*12 as double) x",
        "cast(((video_id*31)%120) + (frame_index%30)*2 + (user_id%3)*10 as double) y",
        "cast(60 + (user_id%5)*22 as double) w", "cast(72 + (user_id%5)*26 as double) h",
        "cast(cast(40+(event_id*37+user_id*11+k*23)%60 as double)/100 as float) conf",
        "(event_type='signup' and user_id%10=0) stored",
    )


def frame_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = video_of(events(spark, sf_dir).select("event_id", "event_type").where("event_type <> 'error'"))
    return e.selectExpr("video_id", "frame_index frame_no", "frame_index*3000 + (event_id*7)%900 pts")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = video_of(events(spark, sf_dir).select("event_id"))
    return e.selectExpr("video_id job_id", "event_id seq", "frame_index*700 + (event_id*13)%500 t_ms", "3*frame_index + (event_id*7)%9 progress")


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id")
    return e.selectExpr("concat('/v/', case when event_id%2=0 then 'Clip' else 'clip' end, cast(user_id%12 as string), '.mp4') path", "event_id seq")


def pattern(spark: SparkSession, width: int = 120, height: int = 90) -> DataFrame:
    """The checkered test image, one row a pixel."""
    x, y = F.col("x"), F.col("y")
    grid, even = (x % 12 == 0) | (y % 12 == 0), (F.floor(x / 6) + F.floor(y / 6)) % 2 == 0
    at = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    tone = lambda a, b, c: F.when(grid, a).when(even, b).otherwise(c)
    return at.select("x", "y", tone(140, 120, 90).alias("b"), tone(220, 190, 140).alias("g"), tone(240, 210, 160).alias("r"))


def pattern_faces(spark: SparkSession, width: int = 120, height: int = 90, percents: tuple[float, ...] = (1, 3, 5, 12)) -> DataFrame:
    """Centred squares that cover the given percents of the image's width and height product's root."""
    side = F.rint(F.sqrt(F.col("pct") / 100 * width * height))
    return spark.createDataFrame([(k, float(p)) for k, p in enumerate(percents)], "face_idx int, pct double").select("face_idx", ((width - side) / 2).alias("x"), ((height - side) / 2).alias("y"), side.alias("w"), side.alias("h"))


def state_documents(spark: SparkSession, path: str) -> DataFrame:
    """Saved application states; damaged documents come as nulls."""
    return spark.read.schema(STATE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def to_state(workspaces: DataFrame) -> DataFrame:
    """State documents (``path, document``) of saved workspaces (``path, mode, indices``), in the form that ``state_documents`` reads."""
    one = F.struct(F.col("path").alias("VideoPath"), F.col("mode").alias("Mode"), F.col("indices").alias("MaskIndices"))
    return workspaces.groupBy("path").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("Workspaces"))).alias("document"))


#: Fixed value: the first bytes of a PNG file.
PNG = "89504E470D0A1A0A"


def mask_files(spark: SparkSession, path: str) -> DataFrame:
    """Mask pictures as binary rows; what is no picture has null content, and empty files have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", F.when(F.hex(F.substring("content", 1, 8)) == PNG, F.col("content")).alias("content"))


def videos_only(df: DataFrame, path_col: str) -> DataFrame:
    """Rows whose path has one of the accepted video extensions."""
    return df.where(F.lower(F.regexp_extract(path_col, r"\.([^.]+)$", 1)).isin(*VIDEO_EXTENSIONS))
