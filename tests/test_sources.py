"""The frame source with pushed conditions, the picture codec, and the workspace sink: commit, abort and recovery."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.sources import frames, png, workspaces

READER = "veilgrid.operators.rasters.pattern_reader"
VIDEOS = [(1, 1000, 16, 12), (2, 40, 16, 12), (3, 0, 16, 12)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_frame_is_read_for_one_frame(spark):
    all_frames = frames.read_frames(spark, VIDEOS, READER, 100)
    one = all_frames.where("video_id = 1 and frame_index = 437")
    rows = one.collect()
    assert one.rdd.getNumPartitions() == 1 and [(r["video_id"], r["frame_index"], r["made"]) for r in rows] == [(1, 437, 1)]
    assert not re.search(r"\bFilter\b", plan(one)) and re.search(r"\bFilter\b", plan(all_frames.where("frame_index % 2 = 1")))
    from veilgrid.operators.rasters import pattern_reader

    assert bytes(rows[0]["picture"]) == pattern_reader(16, 12)(1, 437).tobytes()


@pytest.mark.parametrize("condition, want", [
    ("frame_index >= 995", {(1, k) for k in range(995, 1000)}), ("frame_index in (3, 39, 40) and video_id > 1", {(2, 3), (2, 39)}), ("frame_index < 2", {(v, k) for v in (1, 2) for k in range(2)}),
    ("frame_index > 10 and frame_index <= 12 and video_id = 2", {(2, 11), (2, 12)}), ("frame_index = 5 and frame_index = 6", set()), ("frame_index % 500 = 499", {(1, 499), (1, 999)}), ("video_id = 3", set()), ("video_id = null", set()),
])
def test_conditions_give_the_right_frames(spark, condition, want):
    got = frames.read_frames(spark, VIDEOS, READER, 100).where(condition).select("video_id", "frame_index").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_all_frames_by_ranges(spark):
    df = frames.read_frames(spark, VIDEOS, READER, 100)
    assert df.rdd.getNumPartitions() == 11 and df.count() == 1040


def test_pictures_survive_encoding():
    rng = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        picture = rng.integers(0, 256, (7, 5, channels)).astype(np.uint8)
        assert (png.decode(png.encode(picture)) == picture).all()


def test_every_line_filter_is_read():
    """Lines filtered by hand in all five ways."""
    import struct
    import zlib

    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, (10, 6, 3)).astype(int)
    lines = bytearray()
    for y in range(10):
        way = y % 5
        lines.append(way)
        for i in range(18):
            at = lambda yy, ii: int(picture[yy].ravel()[ii]) if yy >= 0 and ii >= 0 else 0
            a, b, c = at(y, i - 3), at(y - 1, i), at(y - 1, i - 3)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines.append((at(y, i) - (0, a, b, (a + b) // 2, paeth)[way]) % 256)
    data = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)) + png._chunk(b"tEXt", b"x") + png._chunk(b"IDAT", zlib.compress(bytes(lines))[:20]) + png._chunk(b"IDAT", zlib.compress(bytes(lines))[20:]) + png._chunk(b"IEND", b"")
    assert (png.decode(data) == picture).all()
    assert png.decode(data[:-3]) is None and png.decode(data[:60] + b"!" + data[61:]) is None and png.decode(b"") is None and png.decode(b"GIF89a") is None


def mask_rows(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], workspaces.ROW + ", extra int")


def alpha(k, width=4, height=3):
    return bytes((k + j) % 256 for j in range(width * height))


def saved(spark, root):
    spaces, masks = workspaces.load(spark, root)
    listed = {(r["VideoPath"], r["Mode"]): (r["SelectedFrameIndex"], tuple(r["MaskIndices"])) for r in spaces.collect()}
    return listed, {(r["path"], r["mode"], r["frame_index"]): bytes(r["alpha"]) for r in masks.collect()}


SNAPSHOT = json.dumps({"SelectedFrameIndex": 5, "ViewStartSeconds": 1.5, "LastOpened": "2024-05-06T07:08:09Z", "AutoCompleted": True})


def test_workspaces_are_saved_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "state")
    assert saved(spark, root) == ({}, {})
    rows = [("/v/A.mp4", "Auto", k, 4, 3, alpha(k), SNAPSHOT) for k in range(5)] + [("/v/B.mp4", "Manual", None, None, None, None, None), ("/v/B.mp4", None, 1, 4, 3, alpha(1), None), ("/v/A.mp4", "Auto", 7, 4, 3, b"xx", None), ("/v/A.mp4", "Auto", 3, 4, 3, alpha(99), None), ("/v/A.mp4", "Auto", -1, 4, 3, alpha(1), None)]
    workspaces.save(mask_rows(spark, rows).repartition(4), root)
    listed, masks = saved(spark, root)
    assert listed == {("/v/A.mp4", "Auto"): (5, (0, 1, 2, 3, 4)), ("/v/B.mp4", "Manual"): (None, ())}
    assert masks == {("/v/A.mp4", "Auto", k): alpha(k) for k in range(5)}
    # The second write replaces that workspace alone, whatever the case of its path.
    workspaces.save(mask_rows(spark, [("/V/a.MP4", "Auto", 9, 4, 3, alpha(9), None)]), root)
    listed, masks = saved(spark, root)
    assert listed == {("/V/a.MP4", "Auto"): (None, (9,)), ("/v/B.mp4", "Manual"): (None, ())}
    assert masks == {("/V/a.MP4", "Auto", 9): alpha(9)}
    assert sorted(os.listdir(root)) == ["state.json", "workspaces"]


def test_pictures_that_are_gone_or_damaged_give_no_mask(spark, tmp_path):
    root = str(tmp_path)
    workspaces.save(mask_rows(spark, [("/v/A.mp4", "Auto", k, 4, 3, alpha(k), None) for k in range(4)]), root)
    folder = f"{root}/workspaces/{workspaces.folder_name('/v/A.mp4')}/Auto"
    os.remove(f"{folder}/mask_0.png")
    for k, content in ((1, b""), (2, b"no picture")):
        with open(f"{folder}/mask_{k}.png", "wb") as f:
            f.write(content)
    assert saved(spark, root)[1] == {("/v/A.mp4", "Auto", 3): alpha(3)}
    with open(f"{root}/state.json", "w") as f:
        f.write("{broken")
    assert saved(spark, root) == ({}, {})


def test_a_write_that_fails_leaves_the_old_state(spark, tmp_path):
    root = str(tmp_path)
    workspaces.save(mask_rows(spark, [("/v/A.mp4", "Auto", k, 4, 3, alpha(k), SNAPSHOT) for k in range(3)]), root)
    before = saved(spark, root)

    @F.udf("binary")
    def dies(k, a):
        if k == 60:
            os._exit(9)  # the task's process goes in the middle of its work
        return bytes(a)

    rows = mask_rows(spark, [("/v/A.mp4", "Auto", k, 4, 3, alpha(k), None) for k in range(100)])
    with pytest.raises(Exception):
        workspaces.save(rows.withColumn("alpha", dies("frame_index", "alpha")), root)
    assert saved(spark, root) == before and sorted(os.listdir(root)) == ["state.json", "workspaces"]


@pytest.mark.parametrize("dies_at", range(6))
def test_a_commit_that_dies_is_undone_or_finished(spark, tmp_path, monkeypatch, dies_at):
    """The commit's driver dies at its first, second, ... change of the folder."""
    root = str(tmp_path)
    workspaces.save(mask_rows(spark, [("/v/A.mp4", "Auto", 1, 4, 3, alpha(1), None), ("/v/B.mp4", "Auto", 1, 4, 3, alpha(2), None)]), root)
    before = saved(spark, root)
    writer = workspaces.WorkspaceWriter(root)
    rows = [{"path": p, "mode": "Auto", "frame_index": 5, "width": 4, "height": 3, "alpha": alpha(5), "snapshot": None} for p in ("/v/A.mp4", "/v/C.mp4")]
    empty = [{"path": "/v/B.mp4", "mode": "Auto", "frame_index": None, "snapshot": None}]
    messages = [writer.write(iter(rows)), writer.write(iter(empty)), None]
    done, real = [], {"rename": os.rename, "replace": os.replace, "rmtree": workspaces.shutil.rmtree}

    def dying(name):
        def call(*args, **more):
            if len(done) == dies_at:
                raise KeyboardInterrupt
            done.append(name)
            return real[name](*args, **more)

        return call

    with monkeypatch.context() as m:
        m.setattr(workspaces.os, "rename", dying("rename"))
        m.setattr(workspaces.os, "replace", dying("replace"))
        m.setattr(workspaces.shutil, "rmtree", dying("rmtree"))
        with pytest.raises(KeyboardInterrupt):
            writer.commit(messages)
    listed, masks = saved(spark, root)
    after = {("/v/A.mp4", "Auto"): (None, (5,)), ("/v/B.mp4", "Auto"): (None, ()), ("/v/C.mp4", "Auto"): (None, (5,))}, {(p, "Auto", 5): alpha(5) for p in ("/v/A.mp4", "/v/C.mp4")}
    assert not os.path.exists(f"{root}/{workspaces.JOURNAL}")
    assert (listed, masks) in (before, after)


def test_no_frame_goes_through_the_driver(spark, tmp_path, monkeypatch):
    """What tasks tell the driver, the document and what the driver lists stay as small for many masks as for few."""
    import pickle

    told, documents = {}, {}
    for n in (10, 400):
        monkeypatch.setattr(workspaces, "HELD", 7)
        writer = workspaces.WorkspaceWriter(root := str(tmp_path / f"of {n}"))
        message = writer.write({"path": "/v/A.mp4", "mode": "Auto", "frame_index": k, "width": 4, "height": 3, "alpha": alpha(k), "snapshot": SNAPSHOT} for k in range(n))
        writer.commit([message])
        told[n], documents[n] = len(pickle.dumps(message)), os.path.getsize(f"{root}/state.json")
        listed, masks = saved(spark, root)
        assert listed == {("/v/A.mp4", "Auto"): (5, tuple(range(n)))} and masks == {("/v/A.mp4", "Auto", k): alpha(k) for k in range(n)}
        assert not workspaces.load(spark, root)[1].inputFiles()
    assert abs(told[400] - told[10]) < 16 and abs(documents[400] - documents[10]) < 16


def test_documents_that_hold_their_frames_are_read(spark, tmp_path):
    root = str(tmp_path)
    workspaces.save(mask_rows(spark, [("/v/A.mp4", "Auto", k, 4, 3, alpha(k), SNAPSHOT) for k in range(3)]), root)
    document = workspaces.read_document(root)
    del document["Workspaces"][0]["MaskLists"]
    document["Workspaces"][0]["MaskIndices"] = [0, 2, 8]
    workspaces.replace_json(f"{root}/state.json", document)
    assert saved(spark, root) == ({("/v/A.mp4", "Auto"): (5, (0, 2, 8))}, {("/v/A.mp4", "Auto", k): alpha(k) for k in (0, 2)})
    workspaces.save(mask_rows(spark, [("/v/B.mp4", "Auto", 1, 4, 3, alpha(1), None)]), root)
    assert saved(spark, root)[0] == {("/v/A.mp4", "Auto"): (5, (0, 2, 8)), ("/v/B.mp4", "Auto"): (None, (1,))}


def files_below(root):
    return [os.path.join(d, x) for d, _, names in os.walk(root) for x in names]


def test_many_masks_take_few_files_and_little_disk(spark, tmp_path):
    """A file of its own takes whole blocks of the disk for a mask of a few bytes."""
    root = str(tmp_path)
    rows = [("/v/A.mp4", mode, k, 4, 3, alpha(k), SNAPSHOT) for k in range(3000) for mode in ("Auto", "Manual")] + [("/v/B.mp4", "Auto", k, 4, 3, alpha(k), None) for k in range(3)]
    workspaces.save(mask_rows(spark, rows).repartition(4), root)
    listed, masks = saved(spark, root)
    assert listed == {("/v/A.mp4", "Auto"): (5, tuple(range(3000))), ("/v/A.mp4", "Manual"): (5, tuple(range(3000))), ("/v/B.mp4", "Auto"): (None, (0, 1, 2))}
    assert masks == {(r[0], r[1], r[2]): r[5] for r in rows}
    found = files_below(root)
    assert len(found) < 40 and sum(os.stat(f).st_blocks * 512 for f in found) < len(rows) * 64
    # The few masks of a workspace stay pictures of their own.
    assert sum(f.endswith(".png") for f in found) == 3


def test_packs_hold_masks_of_all_sizes_and_damaged_ones_give_none(spark, tmp_path, monkeypatch):
    root, rng = str(tmp_path), np.random.default_rng(4)
    monkeypatch.setattr(workspaces, "HELD_BYTES", 4000)
    rows = [(path, "Auto", k, w, h, rng.integers(0, 256, w * h, dtype=np.uint8).tobytes(), None) for path in ("/v/A.mp4", "/v/B.mp4") for k in range(400) for w, h in [(1 + k % 7, 2 + k % 5)]]
    fields = [c.split()[0] for c in workspaces.ROW.split(", ")]
    writer = workspaces.WorkspaceWriter(root)
    # Rows of the two come by turns: what is held of each is put away together.
    turns = sorted(rows, key=lambda r: (r[2], r[0]))
    writer.commit([writer.write(dict(zip(fields, r, strict=True)) for r in turns[:300]), writer.write(dict(zip(fields, r, strict=True)) for r in turns[300:])])
    everything = {(r[0], r[1], r[2]): r[5] for r in rows}
    assert saved(spark, root)[1] == everything
    packs = sorted(f for f in files_below(root) if f.endswith(".parquet"))
    assert len(packs) > 3
    with open(packs[0], "r+b") as f:
        f.seek(os.path.getsize(packs[0]) // 2)
        f.write(b"\xff" * 40)
    os.remove(packs[1])
    with open(packs[2], "wb"):
        pass
    left = saved(spark, root)[1]
    assert 0 < len(left) < len(everything) and left.items() < everything.items()
