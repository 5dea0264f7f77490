"""Streams with timers against the batch operators; a stream that is stopped, and one whose batch fails, and begun again."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.operators import export, rates
from veilgrid.streaming import timers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.unset(key)


def some_events(spark, seed=3, count=240):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 3)), k, int(1000 + 60 * k + rng.integers(-200, 200))) for k in range(count)]
    return spark.createDataFrame(rows, "job_id bigint, seq bigint, t_ms bigint")


#: An event far later, which moves the watermark past all others.
END = 10_000_000


def streamed(spark, tmp_path, events, make, parts=4):
    folder, most = str(tmp_path), events.agg(F.max("t_ms")).first()[0]
    events = events.unionByName(spark.createDataFrame([(-1, -1, END)], events.schema))
    schema, step = events.schema, most // parts + 1
    for k in range(parts + 1):  # begun again for each part
        low, high = k * step, (k + 1) * step if k < parts else END + 1
        events.where(f"t_ms >= {low} and t_ms < {high}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = make(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").start()
        q.processAllAvailable()
        q.stop()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").where("job_id >= 0").select("job_id", "t_ms", "seq").collect())


def test_throttle_stream_equals_batch(spark, rocks, tmp_path):
    events = some_events(spark)
    want = sorted(tuple(r) for r in rates.throttle(events, 500).select("job_id", "t_ms", "seq").collect())
    assert streamed(spark, tmp_path, events, lambda s: timers.throttle_stream(s, 500)) == want and len(want) > 20


def test_debounce_stream_equals_batch(spark, rocks, tmp_path):
    events = some_events(spark, 5).dropDuplicates(["job_id", "t_ms"])
    want = sorted(tuple(r) for r in rates.debounce(events, 300).select("job_id", "t_ms", "seq").collect())
    assert streamed(spark, tmp_path, events, lambda s: timers.debounce_stream(s, 300)) == want and len(want) > 10


def test_current_results_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    asked = [(int(rng.integers(0, 3)), k, 1000 + 100 * k) for k in range(120)]
    requests = spark.createDataFrame(asked, "key bigint, stamp bigint, asked_ms bigint")
    results = spark.createDataFrame([(key, k, t + int(rng.integers(20, 900))) for key, k, t in asked], "key bigint, stamp bigint, done_ms bigint")
    want = sorted(tuple(r) for r in export.current_results(requests, results).collect())
    end = lambda name: spark.createDataFrame([(-1, 10_000, END)], f"key bigint, stamp bigint, {name} bigint")
    for part, (low, high) in enumerate(((0, 5000), (5000, 9000), (9000, END + 1))):
        for name, df, c in (("a", requests.unionByName(end("asked_ms")), "asked_ms"), ("b", results.unionByName(end("done_ms")), "done_ms")):
            df.where(f"{c} >= {low} and {c} < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = timers.current_results_stream(*(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for name, df in (("a", requests), ("b", results))), 1000)
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).start()
        q.processAllAvailable()
        q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("key >= 0").collect())
    assert got == want and 0 < len(want) < 120


def test_an_upsert_that_dies_and_is_begun_again_has_each_frame_once(spark, tmp_path, monkeypatch):
    rows = [(1, k % 40, k) for k in range(100)]
    frames = spark.createDataFrame(rows, "video_id bigint, frame_index bigint, seq bigint")
    path = str(tmp_path / "table")

    def begin():
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return timers.upsert_stream(stream, path, ["video_id", "frame_index"], "seq", str(tmp_path / "state")).start()

    for low in (0, 30, 60):
        frames.where(f"seq >= {low} and seq < {low + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    real, calls = timers.name_generation, []

    def dies(p, number):
        calls.append(number)
        if len(calls) == 2:  # the generation is written, its name is not
            raise RuntimeError("gone")
        real(p, number)

    with monkeypatch.context() as m:
        m.setattr(timers, "name_generation", dies)
        q = begin()
        with pytest.raises(Exception):
            q.processAllAvailable()
    assert timers.generation(path)[0] == 0
    frames.where("seq >= 90").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = begin()
    q.processAllAvailable()
    q.stop()
    got = {r["frame_index"]: r["seq"] for r in spark.read.parquet(timers.generation(path)[1]).collect()}
    assert got == {f: max(s for _, g, s in rows if g == f) for f in range(40)}
    number = timers.generation(path)[0]
    q = begin()  # nothing new: nothing is written again
    q.processAllAvailable()
    q.stop()
    assert timers.generation(path)[0] == number
