"""Rounding, carry, empty inputs and ties."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import functions as F

from veilgrid.functions import geometry as G
from veilgrid.operators import lookups, pixels, rates, state, temporal
from veilgrid.plans.catalog import QUERIES
from veilgrid.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_time_text(spark):
    assert one(spark, G.frame_time_text(F.lit(5), F.lit(0.0))) == "00:00.00"
    assert one(spark, G.frame_time_text(F.lit(89), F.lit(29.97))) == "00:02.29"
    assert one(spark, G.frame_time_text(F.lit(30 * 3600), F.lit(30.0))) == "60:00.00"


def test_radius_rounds_half_to_even(spark):
    assert one(spark, G.blur_radius(F.lit(1.0), F.lit(1.0), 100, 100, 10)) == 4
    assert one(spark, G.blur_radius(F.lit(90.0), F.lit(90.0), 100, 100, 1)) == 1


def test_iou_without_overlap(spark):
    r = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    assert one(spark, G.iou(r(0.0), r(10.0))) == 0.0
    assert one(spark, G.iou(r(0.0), r(0.0))) == 1.0


def test_empty_tables(spark):
    frames = spark.createDataFrame([], f"video_id bigint, frame_index bigint, stored boolean, faces array<{temporal.FACE}>")
    assert temporal.temporal_fix(frames).count() == 0
    assert temporal.issues(frames).count() == 0
    samples = spark.createDataFrame([], "job_id bigint, seq bigint, t_ms bigint, progress bigint")
    assert rates.throttle(samples, 5).count() == 0
    assert state.free_number(spark.createDataFrame([], "n int")).first()["n"] == 1
    assert pixels.mask_bounds(spark.createDataFrame([], "x int, y int, alpha int")).first() == (0, 0, 0, 0)


def test_nearest_takes_the_smaller_on_ties(spark):
    frames = spark.createDataFrame([(0, 15)], "video_id bigint, frame_index bigint")
    keys = spark.createDataFrame([(0, 10), (0, 20)], "video_id bigint, k bigint")
    assert lookups.nearest_step(frames, keys, 7).first()["k"] == 10


def test_double_gap_stays(spark):
    face = [(0, 0.0, 0.0, 9.0, 9.0, 0.9)]
    rows = [(0, i, False, face if i in (0, 3) else []) for i in range(4)]
    frames = spark.createDataFrame(rows, f"video_id bigint, frame_index bigint, stored boolean, faces array<{temporal.FACE}>")
    assert temporal.gap_fill(frames).where("filled").count() == 0


def test_brush_stamps_along_a_stroke(spark):
    rows = [(0, 2, 10, 22, 10, 2, 255), (1, 12, 0, 12, 20, 1, 0), (2, -5, 2, 3, 2, 1, 255), (3, 29, 19, 29, 19, 1, 255)]
    strokes = spark.createDataFrame(rows, "seq int, cx int, cy int, tx int, ty int, radius int, value int")
    want = {}
    for _, fx, fy, tx, ty, r, value in rows:
        far = math.hypot(tx - fx, ty - fy)
        steps = max(1, math.ceil(far / max(1.0, r * 0.5)))
        for i in range(steps + 1):
            cx, cy = round(fx + i * (tx - fx) / steps), round(fy + i * (ty - fy) / steps)
            if 0 <= cx < 30 and 0 <= cy < 20:
                want |= {(x, y): value for x in range(30) for y in range(20) if (x - cx) ** 2 + (y - cy) ** 2 <= r * r}
    assert {(p["x"], p["y"]): p["value"] for p in pixels.brush(strokes, 30, 20).collect()} == want
    assert want[12, 10] == 0 and want[7, 10] == want[17, 10] == 255


def test_brush_keeps_frames_apart(spark):
    strokes = spark.createDataFrame([(0, f, f, 5, 5, 1, 255 * f) for f in (0, 1)], "video_id int, frame_index int, seq int, cx int, cy int, radius int, value int")
    got = pixels.brush(strokes, 30, 20).groupBy("frame_index", "value").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 5), (1, 255, 5)]


def thousand_events(spark):
    """1,001 events; the last one's stroke begins at (110, 53)."""
    path = tempfile.mkdtemp(prefix="spark-")
    spark.range(1001).selectExpr("id event_id", "id % 50 user_id").write.parquet(f"{path}/events.parquet")
    return path


def test_strokes_after_the_first_hundreds_are_drawn(spark):
    last = QUERIES["brush_segments"](spark, thousand_events(spark)).where("video_id = 0 and x = 110 and y = 53").first()
    assert last["value"] == 255


def test_upsert_leaves_no_open_out(spark):
    kept = {r["seq"] for r in QUERIES["workspace_upsert_all"](spark, thousand_events(spark)).collect()}
    assert set(range(500, 1001)) <= kept


def test_videos_below_three_frames_keep_their_faces(spark):
    weak, strong = [(0, 0.0, 0.0, 9.0, 9.0, 0.4)], [(0, 0.0, 0.0, 9.0, 9.0, 0.9)]
    rows = [(0, 0, False, weak), (1, 0, False, weak), (1, 1, False, []), (2, 0, False, weak), (2, 1, False, strong), (2, 2, False, strong)]
    frames = spark.createDataFrame(rows, f"video_id bigint, frame_index bigint, stored boolean, faces array<{temporal.FACE}>")
    got = temporal.temporal_fix(frames)
    assert got.count() == len(rows)
    assert sorted((r["video_id"], r["frame_index"]) for r in temporal.explode_faces(got).collect()) == [(0, 0), (1, 0), (2, 1), (2, 2)]


def test_pixel_operators_keep_frames_apart(spark):
    """Two frames, the second brighter and with another face, give what each gives alone."""
    frame = lambda df, k: df.select(F.lit(7).alias("video_id"), F.lit(k).alias("frame_index"), "*")
    image = tables.pattern(spark, 30, 24)
    images = [image, image.select("x", "y", *((F.col(c) / 2 + F.col("x")).cast("int").alias(c) for c in "bgr"))]
    faces = [spark.createDataFrame([(k, 2.0 + 9 * k, 3.0, 6.0 + k, 5.0)], "face_idx int, x double, y double, w double, h double") for k in (0, 1)]
    mask = lambda f: pixels.mask_raster(f, 30, 24)
    runs = [
        lambda i, f: mask(f), lambda i, f: pixels.mask_bounds(mask(f)), lambda i, f: pixels.radius_map(f, 30, 24, 24), lambda i, f: pixels.box_mean(i, 2),
        lambda i, f: pixels.box_separable(i, 2, 30, 24), lambda i, f: pixels.masked_blend(i, pixels.box_mean(i, 2), mask(f)), lambda i, f: pixels.region_stats(i, 2, 2, 25, 20),
        lambda i, f: pixels.downscale_nearest(i, 0.4, 30, 24), lambda i, f: pixels.mask_decay(mask(f).withColumn("seq", F.lit(0))),
    ]
    both = [frame(t[0], 0).unionByName(frame(t[1], 1)).coalesce(1) for t in (images, faces)]
    for n, run in enumerate(runs):
        got = sorted(map(tuple, run(*both).collect()))
        assert got == sorted((7, k, *row) for k in (0, 1) for row in run(images[k], faces[k]).collect()), n
