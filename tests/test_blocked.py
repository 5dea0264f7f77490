"""Windows by blocks against windows by sequence, and one long sequence in many tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilgrid.operators import blocked, issues, lookups


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    at = sorted(set(rng.integers(0, 900, 300).tolist()))
    data = [(v, int(p), None if rng.random() < 0.6 else int(p), int(rng.integers(-3, 4))) for v in (1, 2) for p in at if v == 1 or p > 400] + [(3, 5, None, 1)]
    return spark.createDataFrame(data, "video_id bigint, p bigint, known bigint, n int").repartition(4)


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_blocks_equal_windows(rows, size):
    w = Window.partitionBy("video_id").orderBy("p")
    cut = blocked.cut(rows, "video_id", "p", size)
    both = blocked.neighbours(cut, "video_id", "p", F.col("known"))
    both = blocked.running_sum(both, "video_id", "p", F.col("n"), "total")
    both = blocked.nearest_known(both, "video_id", "p", F.col("known"), "below", "above")
    columns = ["video_id", "p", "before", "after", "total", "below", "above"]
    got = sorted(map(str, both.select(columns).collect()))
    plain = rows.select(
        "video_id", "p", F.lag("known").over(w).alias("before"), F.lead("known").over(w).alias("after"), F.sum("n").over(w).alias("total"),
        F.max("known").over(w).alias("below"), F.min("known").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("above"),
    )
    assert got == sorted(map(str, plain.select(columns).collect()))


def test_lookups_do_not_depend_on_blocks(spark, rows):
    frames = rows.select("video_id", F.col("p").alias("frame_index"))
    marks = rows.where("known is not null").select("video_id", F.col("known").alias("frame_index"))
    keys = marks.select("video_id", F.col("frame_index").alias("k"))
    for run in (lambda s: lookups.circular_neighbours(frames.join(marks, ["video_id", "frame_index"], "left_anti"), marks, s), lambda s: lookups.nearest_step(frames, keys, 20, s), lambda s: lookups.asof_forward(frames, keys, "video_id", "frame_index", "k", s)):
        assert sorted(map(str, run(3).collect())) == sorted(map(str, run(10_000).collect()))
    assert lookups.circular_neighbours(frames, marks.limit(0)).where("next_mark is not null or prev_mark is not null").count() == 0


def test_one_long_video_is_many_tasks(spark):
    frames = spark.range(400_000).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame_index"))
    marks = frames.where("frame_index % 1000 = 7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    counts = lookups.asof_forward(frames, marks.select("video_id", F.col("frame_index").alias("k")), "video_id", "frame_index", "k").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 4 and max(r["count"] for r in counts) < 150_000
    after = issues.first_at_or_after(marks, frames.withColumnRenamed("frame_index", "target")).where("target = 123456").first()
    assert (after["first_after"], after["first"]) == (124_007, 7)
