"""Detection, issue lists, the mask store, views and exports on hand-written edge rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veilgrid.functions import views as V
from veilgrid.operators import detect, export, issues, masks, rates, temporal
from veilgrid.sources import tables

FACE = "face_idx int, x double, y double, w double, h double, conf float"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_regions_grow_to_their_least_size_and_stay_inside(spark):
    boxes = [(0, 0.0, 0.0, 1.0, 1.0), (1, 99.0, 79.0, 1.0, 1.0), (2, 40.0, 30.0, 4.0, 4.0)]
    faces = spark.createDataFrame([(0, k, *b) for k, *b in boxes], "video_id bigint, frame_index bigint, x double, y double, w double, h double")
    spine = spark.createDataFrame([(0, k) for k in range(4)], "video_id bigint, frame_index bigint")
    got = {r["frame_index"]: (r["x"], r["y"], r["w"], r["h"]) for r in detect.region_of_faces(spine, faces, 100, 80).collect()}
    assert got == {0: (0.0, 0.0, 64.0, 64.0), 1: (36.0, 16.0, 64.0, 64.0), 2: (8.0, 0.0, 68.0, 66.0), 3: (0.0, 0.0, 100.0, 80.0)}


def test_tiny_frames_pass_every_face(spark):
    assert one(spark, detect.passes_area(F.lit(0.1), F.lit(5.0), 30, 30)) is True
    wide = lambda w, h: one(spark, detect.passes_area(F.lit(w), F.lit(h), 1280, 720))
    assert wide(60.0, 30.0) and wide(30.0, 60.0) and not wide(60.1, 30.0) and not wide(30.0, 0.0)


def test_high_confidence_needs_no_statistics(spark):
    faces = spark.createDataFrame([(0, 0, k, 0.0, 0.0, 80.0, 80.0, c) for k, c in enumerate((0.85, 0.84, 0.84, 0.84))], f"video_id bigint, frame_index bigint, {FACE}")
    stats = spark.createDataFrame([(0, 0, 0, False), (0, 0, 1, False), (0, 0, 2, True)], "video_id bigint, frame_index bigint, face_idx int, passed boolean")
    assert sorted(r["face_idx"] for r in detect.filter_faces(faces, stats, 1280, 720).collect()) == [0, 2, 3]
    assert detect.filter_faces(faces.limit(0), stats, 1280, 720).count() == 0


def test_a_detector_is_made_once_a_task(spark):
    import pyarrow as pa

    def make():
        made = []

        def found(batch):
            made.append(1)
            n = batch.num_rows
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([0.5] * n, pa.float32())], names=["frame_index", "conf"])

        return found

    got = detect.detect(spark.range(7).withColumnRenamed("id", "frame_index"), make, "frame_index bigint, conf float")
    assert sorted(r["frame_index"] for r in got.collect()) == list(range(7))


def held(spark, found, every, tracking=True):
    face = [(0, 0.0, 0.0, 9.0, 9.0, 0.9)]
    rows = [(0, k, face if f else []) for k, f in enumerate(found)]
    frames = spark.createDataFrame(rows, f"video_id bigint, frame_index bigint, faces array<{temporal.FACE}>")
    return {r["frame_index"]: (r["detected"], r["held_from"]) for r in detect.hold_last(frames, every, tracking).collect()}


def test_faces_are_held_between_detections(spark):
    assert held(spark, [1, 1, 0, 0, 0, 1, 1], 4) == {0: (True, 0), 1: (False, 0), 2: (False, 0), 3: (False, 0), 4: (True, None), 5: (True, 5), 6: (False, 5)}
    assert held(spark, [1, 1, 1], 2, tracking=False) == {0: (True, 0), 1: (False, None), 2: (True, 2)}


def test_undo_takes_the_latest_stroke_back(spark):
    rng = np.random.default_rng(4)
    rows = [(0, int(f), k, bool(u)) for k, (f, u) in enumerate(zip(rng.integers(0, 3, 200), rng.random(200) < 0.5, strict=True))]
    stacks: dict[int, list[int]] = {0: [], 1: [], 2: []}
    for _, f, k, undo in rows:
        if undo:
            stacks[f][-1:] = []
        else:
            stacks[f].append(k)
    got = masks.not_undone(spark.createDataFrame(rows, "video_id bigint, frame_index bigint, seq bigint, undo boolean"))
    assert sorted(r["seq"] for r in got.collect()) == sorted(sum(stacks.values(), []))


def test_a_mask_takes_faces_away_and_a_clear_takes_all(spark):
    face = [(0, 0.0, 0.0, 9.0, 9.0, 0.9)]
    log = [(0, 0, 1, "faces", face, 9, 9), (0, 0, 2, "mask", None, 9, 9), (0, 1, 3, "mask", None, 9, 9), (0, 1, 4, "faces", face, 9, 9), (0, 2, 5, "faces", face, 9, 0), (0, 3, 6, "faces", face, 9, 9), (0, 3, 7, "remove", None, 9, 9),
           (1, 0, 1, "faces", face, 9, 9), (1, None, 2, "clear", None, None, None), (1, 1, 3, "faces", face, 9, 9)]
    got = masks.after_changes(spark.createDataFrame(log, f"video_id bigint, frame_index bigint, seq bigint, op string, faces array<{temporal.FACE}>, width int, height int"))
    assert sorted((r["video_id"], r["frame_index"], r["stored"], r["faces"] is not None) for r in got.collect()) == [(0, 0, True, False), (0, 1, True, True), (1, 1, False, True)]


def test_confidences_are_repaired(spark):
    faces, none = F.array(F.lit(1), F.lit(2)), F.lit(None).cast("array<float>")
    assert one(spark, masks.repaired_confidences(faces, none, F.lit(None).cast("float"))) == [1.0, 1.0]
    assert one(spark, masks.repaired_confidences(faces, F.array(F.lit(0.25).cast("float")), F.lit(0.5).cast("float"))) == [0.5, 0.5]


def test_finished_jobs_and_jobs_without_progress_have_no_estimate(spark):
    samples = spark.createDataFrame([(0, k, k * 1000, p) for k, p in enumerate((0, 10, 20, 100))], "job_id bigint, seq bigint, t_ms bigint, progress bigint")
    assert {r["seq"]: r["eta_ms"] for r in rates.sliding_eta(samples, 100).collect()} == {1: None, 2: 8000, 3: None}


def test_resolved_frames_leave_all_lists(spark):
    found = spark.createDataFrame([(0, 1, "noface"), (0, 1, "flicker"), (0, 2, "lowconf")], "video_id bigint, frame_index bigint, issue string")
    edited = spark.createDataFrame([(0, 1)], "video_id bigint, frame_index bigint")
    assert [tuple(r) for r in issues.merged(issues.resolved(found, edited)).collect()] == [(0, 2)]
    assert [tuple(r) for r in issues.merged(found).collect()] == [(0, 1), (0, 2)]
    targets = spark.createDataFrame([(0, 2), (0, 3), (9, 0)], "video_id bigint, target bigint")
    assert {(r["video_id"], r["target"]): (r["first_after"], r["first"]) for r in issues.first_at_or_after(found, targets).collect()} == {(0, 2): (2, 1), (0, 3): (None, 1), (9, 0): (None, None)}


def test_write_back_keeps_frames_with_faces(spark):
    rows = [(0, 0, False, [(0, 0.0, 0.0, 9.0, 9.0, 0.9), (1, 0.0, 0.0, 9.0, 9.0, 0.75)]), (0, 1, False, []), (0, 2, True, [])]
    frames = spark.createDataFrame(rows, f"video_id bigint, frame_index bigint, stored boolean, faces array<{temporal.FACE}>")
    assert [(r["frame_index"], r["min_conf"]) for r in temporal.write_back(frames).collect()] == [(0, 0.75)]
    assert temporal.temporal_fix(frames, every=3, tracking=False).collect() == frames.collect()


def test_texts_and_names(spark):
    assert one(spark, V.eta_text(F.lit(3_661_000))) == "1시간 1분 1초"
    assert one(spark, V.eta_text(F.lit(59_999))) == "59초" and one(spark, V.age_text(F.lit(60_000))) == "1분 0초"
    assert one(spark, V.position_text(F.lit(-1), F.lit(9))) == "- / -"
    assert one(spark, V.percent(F.lit(1), F.lit(1), True)) == 100 and one(spark, V.percent(F.lit(1), F.lit(200), False)) == 0
    assert one(spark, V.library_name(F.lit("libavcodec.61.dylib"))) == "avcodec"
    assert one(spark, V.thread_choices(F.lit(5))) == [1, 2, 4, 5] and one(spark, V.thread_choices(F.lit(0))) == [1]
    assert one(spark, V.from_letterbox(F.lit(0.0), F.lit(10.0), 100.0, 50.0, 50.0, 50.0)) is None
    assert one(spark, export.output_name(F.lit("/a/b.c.mov"), F.lit(True), F.lit("save_as"), F.lit(3))) == "b.c_blur (3).mp4"
    assert one(spark, export.output_name(F.lit("/a/b.mov"), F.lit(True), F.lit("cancel"), F.lit(3))) is None


def test_file_sources(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"Recents": [{"Title": "a", "Path": "/a.mp4"}], "Workspaces": []}')
    (tmp_path / "bad.json").write_text("{nothing")
    (tmp_path / "mask_1.png").write_bytes(b"\x89PNG\r\n\x1a\n rest")
    (tmp_path / "mask_2.png").write_bytes(b"GIF89a no picture of that kind")
    (tmp_path / "mask_3.png").write_bytes(b"")
    assert tables.state_documents(spark, str(tmp_path / "state.json")).first()["Recents"][0]["Path"] == "/a.mp4"
    assert tables.state_documents(spark, str(tmp_path / "bad.json")).where("Recents is not null").count() == 0
    assert sorted(r["content"] is None for r in tables.mask_files(spark, str(tmp_path)).collect()) == [False, True]
    paths = spark.createDataFrame([("a.MP4",), ("b.txt",), ("noext",)], "p string")
    assert [r["p"] for r in tables.videos_only(paths, "p").collect()] == ["a.MP4"]
