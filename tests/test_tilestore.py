"""Tile versions and incremental previews against a replay of the whole log and a full rebuild."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.operators import pictures, pixels, rasters, tilestore

W, H, TILE = 50, 37, 16


def log(spark, seed=1, count=260, frames=5):
    rng, rows = np.random.default_rng(seed), []
    for k in range(count):
        cx, cy = int(rng.integers(-5, W + 5)), int(rng.integers(-5, H + 5))
        rows.append((int(rng.integers(1, 3)), int(rng.integers(0, frames)) * 40, k, bool(rng.random() < 0.4), cx, cy, cx + int(rng.integers(-9, 10)), cy + int(rng.integers(-9, 10)), int(rng.integers(1, 5)), int(rng.choice([0, 255]))))
    kind = "video_id bigint, frame_index bigint, seq bigint, undo boolean, cx int, cy int, tx int, ty int, radius int, value int"
    return rows, spark.createDataFrame(rows, kind).repartition(4)


def stamps_of(spark, df):
    got = {}
    for r in pixels.stamps(df.drop("undo")).collect():
        got.setdefault(r["seq"], []).append((r["cx"], r["cy"]))
    return got


def replay(rows, stamps, until):
    """(video, frame) to the mask after all actions up to ``until``, with whole snapshots on a stack."""
    masks, stacks = {}, {}
    for v, f, seq, undo, *_, radius, value in sorted(rows, key=lambda r: r[2]):
        if seq > until:
            break
        mask, stack = masks.setdefault((v, f), np.zeros((H, W), int)), stacks.setdefault((v, f), [])
        if undo:
            if stack:
                masks[v, f] = stack.pop()
            continue
        stack.append(mask.copy())
        ys, xs = np.mgrid[0:H, 0:W]
        for cx, cy in stamps[seq]:
            if 0 <= cx < W and 0 <= cy < H:
                mask[(xs - cx) ** 2 + (ys - cy) ** 2 <= radius * radius] = value
    return masks


def assembled(tiles):
    masks = {}
    for r in tiles.collect():
        x0, y0 = r["tx"] * TILE, r["ty"] * TILE
        part = np.frombuffer(bytes(r["alpha"]), np.uint8).reshape(min(TILE, H - y0), -1)
        masks.setdefault((r["video_id"], r["frame_index"]), np.zeros((H, W), int))[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]] = part
    return masks


def same(got, want):
    return all((got.get(k, np.zeros((H, W), int)) == m).all() for k, m in want.items()) and set(got) <= set(want)


def test_versions_equal_a_replay_at_every_time(spark):
    rows, df = log(spark)
    stamps = stamps_of(spark, df)
    stored = tilestore.versions(tilestore.tiled(tilestore.ended(df), W, H, TILE), W, H, TILE).cache()
    for until in (0, 50, 131, 200, 259):
        assert same(assembled(tilestore.current(stored, F.lit(until))), replay(rows, stamps, until)), until
    assert same(assembled(tilestore.current(stored)), replay(rows, stamps, 999))


@pytest.mark.parametrize("border", [0, 97, 180])
def test_a_store_that_grows_equals_one_made_at_once(spark, tmp_path, border):
    rows, df = log(spark, 7)
    stamps = stamps_of(spark, df)
    tilestore.versions(tilestore.tiled(tilestore.ended(df.where(F.col("seq") < border)), W, H, TILE), W, H, TILE).write.parquet(str(tmp_path / "store"))
    first = spark.read.schema(tilestore.VERSIONS).parquet(str(tmp_path / "store"))
    second, changed = tilestore.extended(first, df, W, H, TILE)
    assert same(assembled(tilestore.current(second)), replay(rows, stamps, 999))
    before, after = assembled(tilestore.current(first)), replay(rows, stamps, 999)
    keys = set(map(tuple, changed.collect()))
    for (v, f), mask in after.items():
        old = before.get((v, f), np.zeros((H, W), int))
        for ty in range(-(-H // TILE)):
            for tx in range(-(-W // TILE)):
                part = np.s_[ty * TILE : (ty + 1) * TILE, tx * TILE : (tx + 1) * TILE]
                assert (v, f, tx, ty) in keys or (mask[part] == old[part]).all()


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_a_refresh_equals_a_rebuild_and_leaves_other_files(spark, tmp_path):
    rows, df = log(spark, 9, 200)
    path, store, reader = str(tmp_path / "previews"), str(tmp_path / "store"), rasters.pattern_reader(W, H)
    border = 150
    # After the border only one mask changes.
    df = df.where((F.col("seq") < border) | ((F.col("video_id") == 1) & (F.col("frame_index") == 80)))
    tilestore.versions(tilestore.tiled(tilestore.ended(df.where(F.col("seq") < border)), W, H, TILE), W, H, TILE).write.parquet(store)
    first = spark.read.schema(tilestore.VERSIONS).parquet(store)
    touched = first.select(*tilestore.TILES).distinct()
    tilestore.write_previews(path, tilestore.composed(touched.join(tilestore.current(first), list(tilestore.TILES), "left"), W, H, reader, 3, TILE))
    before = files(path)
    second, changed = tilestore.extended(first, df, W, H, TILE)
    tilestore.refresh_previews(spark, path, tilestore.current(second), changed, W, H, reader, 3, TILE)
    gone = before - files(path)
    assert gone and all("/video_id=1/part=1/" in f for f in gone) and len(before) > len(gone)
    all_touched = second.select(*tilestore.TILES).distinct()
    rebuilt = tilestore.composed(all_touched.join(tilestore.current(second), list(tilestore.TILES), "left"), W, H, reader, 3, TILE)
    table = lambda d: {(r["video_id"], r["frame_index"], r["tx"], r["ty"]): bytes(r["pixels"]) for r in d.collect()}
    got = table(tilestore.read_previews(spark, path))
    assert got == table(rebuilt)
    masks = replay([r for r in rows if r[2] < border or r[:2] == (1, 80)], stamps_of(spark, df), 999)
    for (v, f, tx, ty), data in got.items():
        whole = pictures.preview(reader(v, f), pictures.separable_blur(reader(v, f), 3), masks[v, f].astype(np.uint8))
        assert data == whole[ty * TILE : (ty + 1) * TILE, tx * TILE : (tx + 1) * TILE].tobytes()


def test_strokes_know_which_undo_took_them_back(spark):
    acts = "suusssuuus"
    df = spark.createDataFrame([(1, 1, k, a == "u") for k, a in enumerate(acts)] + [(1, 1, 0, False)], "video_id bigint, frame_index bigint, seq bigint, undo boolean")
    assert {r["seq"]: r["ended"] for r in tilestore.ended(df).collect()} == {0: 1, 3: 8, 4: 7, 5: 6, 9: None}
    assert tilestore.ended(df.limit(0)).count() == 0
