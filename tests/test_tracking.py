"""The detection loop: batch against stream, and its rules on hand-made frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veilgrid.operators import tracking
from veilgrid.operators.pictures import scene_reader
from veilgrid.plans import editing

SF = "/root/testdata/sf0.001"
READER = "video_id bigint, frame_index bigint, stored boolean, faces array<struct<x:double,y:double,w:double,h:double,conf:float>>"


def busy_reader():
    """Pictures whose left half looks like skin with edges, and whose right half is flat."""

    def busy(video, frame):
        picture = np.full((720, 1280, 4), 90, np.uint8)
        picture[:, :640] = (120, 150, 200, 255)
        picture[::8, :640] = (30, 40, 60, 255)
        return picture

    return busy


def run(spark, rows, every=4, detector=tracking.known_faces, tracked=True):
    frames = spark.createDataFrame(rows, READER).withColumn("block", F.lit(1)).repartition(3)
    done = tracking.detection_loop(frames, 1280, 720, every, detector, busy_reader(), tracked).orderBy("video_id", "frame_index").collect()
    return [(r["frame_index"], r["detected"], r["attempt"], r["hit"], r["calls"], r["held_from"], [f["x"] for f in r["faces"]]) for r in done]


def face(x, conf=0.9, size=100.0):
    return (float(x), 100.0, size, size, conf)


def test_looks_holds_and_carries(spark):
    rows = [(1, k, k == 2, [face(100 + k)] if k < 6 else []) for k in range(10)]
    assert run(spark, rows) == [
        (0, True, False, False, 1, 0, [100.0]), (1, False, False, False, 0, 0, [100.0]), (2, False, False, False, 0, None, []), (3, False, False, False, 0, 0, [100.0]),
        (4, True, True, True, 1, 4, [104.0]), *[(k, False, False, False, 0, 4, [104.0]) for k in (5, 6, 7)], (8, True, True, False, 2, None, []), (9, True, False, False, 1, None, []),
    ]
    untracked = run(spark, rows, tracked=False)
    assert [r[6] for r in untracked] == [[100.0], [], [], [], [104.0], [], [], [], [], []]


def test_weak_faces_need_pixels(spark):
    rows = [(1, 0, False, [face(100, 0.5), face(900, 0.5), face(900, 0.86), face(20, 0.99, 10.0)])]
    assert run(spark, rows)[0][6] == [100.0, 900.0]


def test_a_miss_in_the_region_searches_the_frame(spark):
    rows = [(1, k, False, [face(100 if k < 4 else 900)]) for k in range(5)]
    assert run(spark, rows)[4] == (4, True, True, False, 2, 4, [900.0])
    both = [(1, k, False, [face(100), face(600)]) for k in range(9)]
    blind = run(spark, both, every=1, detector=tracking.sometimes_blind)
    assert [r[4] for r in blind] == [1, 1, 1, 2, 1, 1, 1, 1, 1]


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, 0, None, None), (1, 0, None, [face(100)]), (None, 1, False, []), (1, None, False, []), (1, 5, False, [face(100)])]
    assert [r[0] for r in run(spark, rows)] == [0, 5]
    assert run(spark, rows[:0]) == []


def test_stream_equals_batch(spark, tmp_path):
    frames = editing.loop_frames(spark, SF).select("video_id", "frame_index", "stored", "faces").where("video_id < 3")
    reader = scene_reader(1280, 720)
    want = sorted(map(tuple, tracking.detection_loop(frames, 1280, 720, 4, tracking.sometimes_blind, reader).drop("faces").collect()), key=str)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low, high in ((0, 30), (30, 31), (31, 10_000)):  # the stream is stopped and begun again between the batches
            frames.where(F.col("frame_index").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = tracking.detection_stream(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")), 1280, 720, 4, tracking.sometimes_blind, reader)
            q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).start()
            q.processAllAvailable()
            q.stop()
    finally:
        spark.conf.unset(key)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("faces").collect()), key=str)
    assert got == want and len(want) == 375
