"""Frames as rasters against plain loops: fading over blocks, gaps and new sizes, blur, and single-frame figures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.operators import pictures, rasters


def some_faces(seed=3, frames=90):
    """Two videos with gaps, faces beyond the edges, and one video whose size changes back and forth."""
    rng, rows = np.random.default_rng(seed), []
    for video in (1, 2):
        for frame in range(frames):
            width, height = (48, 36) if video == 1 or frame % 30 < 20 else (40, 70)
            for _ in range(int(rng.choice([0, 0, 1, 2]))):
                rows.append((video, frame + (200 if frame > 60 else 0), float(rng.integers(-8, width)), float(rng.integers(-8, height)), float(rng.integers(0, 14)), float(rng.integers(0, 14)), width, height))
    return rows


def table(spark, rows):
    kind = "video_id bigint, frame_index bigint, x double, y double, w double, h double, width int, height int"
    return spark.createDataFrame(rows, kind).withColumns({"block": F.lit("clash"), "value": F.lit(1), "boxes": F.lit(2)}).repartition(5)


def in_order(rows):
    """Frames with their faces, video by video."""
    frames = {}
    for v, f, *box, w, h in rows:
        frames.setdefault((v, f, w, h), set()).add(tuple(box))
    return sorted((k, np.array(sorted(b), dtype=float)) for k, b in frames.items())


def folded(rows):
    """(video, frame) to the box and the faded values, one frame after the other."""
    out, held, prev = {}, None, None
    for (v, f, w, h), boxes in in_order(rows):
        if held != (v, w, h):
            held, prev = (v, w, h), np.zeros((h, w), int)
        box, alpha = rasters.face_mask(boxes, w, h)
        if alpha.size:
            x0, y0, x1, y1 = box
            for y in range(y0, y1):
                for x in range(x0, x1):
                    prev[y, x] = max(int(alpha[y - y0, x - x0]), prev[y, x] * 3 // 4)
            out[v, f] = (box, prev[y0:y1, x0:x1].copy())
    return out


def plain_blur(picture, box, smooth, radii, base):
    height, width = picture.shape[:2]
    x0, y0, x1, y1 = box
    out = picture[y0:y1, x0:x1].astype(int)
    for j in range(y1 - y0):
        for i in range(x1 - x0):
            s = int(smooth[j, i])
            if s:
                r = int(radii[j, i]) or max(1, base)
                part = picture[max(0, y0 + j - r) : min(height, y0 + j + r + 1), max(0, x0 + i - r) : min(width, x0 + i + r + 1)].reshape(-1, 4).astype(int)
                mean = part.sum(axis=0) // len(part)
                out[j, i] = mean if s == 255 else [*((mean[:3] * s + out[j, i, :3] * (255 - s) + 127) // 255), 255]
    return out


@pytest.mark.parametrize("block", [1, 7, 64])
def test_fading_equals_a_fold(spark, block):
    rows = some_faces()
    got = {(r["video_id"], r["frame_index"]): r for r in rasters.faded_masks(table(spark, rows), F.col("width"), F.col("height"), block).collect()}
    want = folded(rows)
    assert sorted(got) == sorted(want)
    for key, (box, smooth) in want.items():
        r = got[key]
        assert (r["x0"], r["y0"], r["x1"], r["y1"]) == box
        assert np.frombuffer(bytes(r["smooth"]), np.uint8).tolist() == smooth.ravel().tolist()


def test_export_equals_plain_loops(spark):
    rows = [(*r[:6], 48, 36) for r in some_faces(5, 30) if r[0] == 1]
    rng = np.random.default_rng(0)
    pictures = rng.integers(0, 256, (400, 36, 48, 4)).astype(np.uint8)
    got = {(r["video_id"], r["frame_index"]): r for r in rasters.export(table(spark, rows), F.lit(48), F.lit(36), 5, lambda v, f: pictures[f], block=8).collect()}
    want, faces = folded(rows), {(k[0], k[1]): b for k, b in in_order(rows)}
    assert sorted(got) == sorted(want)
    for (v, f), (box, smooth) in want.items():
        new = plain_blur(pictures[f], box, smooth, rasters.face_radii(faces[v, f], 48, 36, 5, box), 5)
        r, lit = got[v, f], smooth > 0
        assert np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(new.shape).tolist() == new.tolist()
        assert [r["changed"], r["b"], r["g"], r["r"], r["a"]] == [int(lit.sum()), *new[lit].sum(axis=0).tolist()]


def test_nothing_in_nothing_out(spark):
    empty = table(spark, some_faces()).limit(0)
    assert rasters.export(empty, F.lit(48), F.lit(36), 5, rasters.pattern_reader(48, 36)).count() == 0
    odd = table(spark, [(1, 0, 5.0, 5.0, None, 4.0, 48, 36), (1, 0, float("nan"), 5.0, 4.0, 4.0, 48, 36), (1, 1, 500.0, 500.0, 4.0, 4.0, 48, 36)])
    # The face far outside is clamped to the last pixel's row and column and lights it.
    assert [(r["frame_index"], r["lit"]) for r in rasters.masks(odd, F.lit(48), F.lit(36)).collect()] == [(1, 1)]
    assert rasters.masks(odd.where("frame_index = 0"), F.lit(48), F.lit(36)).count() == 0


def test_a_long_gap_keeps_what_was_not_touched(spark):
    """A pixel fades only when a mask's bounds cover it, however many frames lie between."""
    rows = [(1, 0, 20.0, 20.0, 8.0, 8.0, 64, 64), (1, 100_000, 19.0, 19.0, 4.0, 4.0, 64, 64)]
    got = {r["frame_index"]: r for r in rasters.faded_masks(table(spark, rows), F.col("width"), F.col("height")).collect()}
    alone = rasters.face_mask(np.array([[19.0, 19.0, 4.0, 4.0]]), 64, 64)[1]
    smooth = np.frombuffer(bytes(got[100_000]["smooth"]), np.uint8).reshape(alone.shape)
    assert (smooth > alone).any() and (smooth == folded(rows)[1, 100_000][1]).all()


def test_radii_and_masks_of_a_frame(spark):
    rows = [(1, 0, 3.0, 4.0, 10.0, 12.0, 48, 36), (1, 0, 20.0, 4.0, 20.0, 25.0, 48, 36)]
    r = rasters.radii(table(spark, rows), F.lit(48), F.lit(36), 24).collect()[0]
    whole = rasters.face_radii(np.array([x[2:6] for x in rows]), 48, 36, 24, (0, 0, 48, 36))
    assert (r["covered"], r["radius"], r["most"]) == (int((whole > 0).sum()), int(whole.sum()), int(whole.max()))


def test_face_statistics_read_no_whole_picture(spark, monkeypatch):
    """Boxes of one shape are worked together, with the figures of each alone; a reader that knows parts is not asked for pictures."""
    reader = pictures.scene_reader(640, 360)
    rows = [(k % 3, k // 2, k % 2, float(k * 7 % 700 - 20), float(k * 5 % 380 - 10), float(1 + k % 4 * 40), float(k % 5 * 30)) for k in range(600)]
    want = {r[:3]: pictures.face_statistics(reader(r[0], r[1]), *r[3:]) for r in rows}
    assert len({w[0] for w in want.values()}) > 9
    table = spark.createDataFrame(rows, "video_id bigint, frame_index bigint, face_idx int, x double, y double, w double, h double")
    asked = lambda v, f: reader(v, f)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in pictures.face_stats(table, asked).collect()} == want
    whole = rasters.Rolled(reader.made, 640, 360, reader.shift)
    whole.__class__ = type("Parts", (rasters.Rolled,), {"__call__": lambda *_: 1 / 0})
    assert {tuple(r)[:3]: tuple(r)[3:] for r in pictures.face_stats(table, whole).collect()} == want


def test_an_export_reads_only_what_lies_around_lit_pixels(spark):
    """Two faces far apart: their boxes are worked each, with what the whole picture gives."""
    reader = rasters.pattern_reader(900, 120)
    faces = np.array([[40.0, 30.0, 40.0, 50.0], [760.0, 20.0, 60.0, 70.0]])
    box, alpha = rasters.face_mask(faces, 900, 120)
    radii, taken = rasters.face_radii(faces, 900, 120, 9, box), []

    def read(part):
        taken.append((part[2] - part[0]) * (part[3] - part[1]))
        return reader.part(3, 5, part)

    got = rasters.blurred_box(read, (900, 120), box, alpha, radii, 9)
    assert (got == rasters.blurred(reader(3, 5), box, alpha, radii, 9)).all()
    assert (got[:, 200:600] == reader(3, 5)[box[1] : box[3], box[0] + 200 : box[0] + 600]).all() and sum(taken[1:]) < 900 * 120 // 3
    plain = reader(3, 5).astype(int)
    for y, x in ((60, 60), (55, 790), (40, 70)):
        r, a = int(radii[y - box[1], x - box[0]]), int(alpha[y - box[1], x - box[0]])
        mean = plain[y - r : y + r + 1, x - r : x + r + 1].sum(axis=(0, 1)) // (2 * r + 1) ** 2
        assert a and ((mean * a + plain[y, x] * (255 - a) + 127) // 255 == got[y - box[1], x - box[0]]).all()


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_blurs_and_previews_of_many_pictures_are_those_of_each(spark, radius):
    rng = np.random.default_rng(6)
    some, masks = rng.integers(0, 256, (5, 21, 34, 4), dtype=np.uint8), rng.integers(0, 256, (5, 21, 34), dtype=np.uint8)
    whole = pictures.separable_blurs(some, radius)
    shown = pictures.preview(some, whole, masks)
    for k in range(5):
        assert (whole[k] == pictures.separable_blur(some[k], radius)).all()
        assert (shown[k] == pictures.preview(some[k], whole[k], masks[k])).all()
    reader = rasters.pattern_reader(64, 40)
    rows = [(k % 2, k // 2, float(k * 7 % 70 - 9), float(k * 5 % 44 - 6), float(2 + k % 9), float(3 + k % 7)) for k in range(60)]
    table = spark.createDataFrame(rows, "video_id bigint, frame_index bigint, x double, y double, w double, h double")
    got = {(r["video_id"], r["frame_index"]): (r["b"], r["g"], r["r"]) for r in pictures.blended_sums(table, F.lit(64), F.lit(40), reader, radius).collect()}
    assert len(got) > 40
    for v, f, *box in rows:
        (x0, y0, x1, y1), alpha = rasters.face_mask(np.array([box]), 64, 40)
        assert ((v, f) in got) == bool(alpha.size)
        if not alpha.size:
            continue
        mask = np.zeros((40, 64), np.uint8)
        mask[y0:y1, x0:x1] = alpha
        want = pictures.preview(reader(v, f), pictures.separable_blur(reader(v, f), radius), mask)
        assert got[v, f] == tuple(want[..., c].sum() for c in range(3))


def test_steps_of_blocks_are_worked_once(spark):
    """Sums of blocks, the pass over them and the frames: three works; which strips were touched is not asked of a second one."""
    faded = rasters.fades(table(spark, some_faces()), F.col("width"), F.col("height"))
    assert faded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 3


@pytest.mark.parametrize("base", [1, 4, 24, 150])
def test_sums_of_an_export_are_those_of_its_pixels(spark, base):
    """Random pictures with random alpha, faces at all edges and one upon the other, radii as a map and as boxes, windows beyond the picture and of many pixels."""
    rng = np.random.default_rng(base)
    for width, height in ((90, 70), (31, 160)):
        picture = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
        for faces in ([[-9.0, -9.0, 30.0, 30.0], [60.0, 40.0, 50.0, 60.0]], [[20.0, 10.0, 25.0, 30.0], [24.0, 14.0, 4.0, 4.0]], [[12.0, 30.0, 9.0, 9.0]]):
            boxes = np.array(faces)
            box, alpha = rasters.face_mask(boxes, width, height)
            smooth = np.maximum(alpha, np.where(rng.random(alpha.shape) < 0.2, rng.integers(0, 256, alpha.shape), 0).astype(np.uint8))
            smooth[:, smooth.shape[1] // 2] = 0
            radii = rasters.face_radii(boxes, width, height, base, box)
            what = (lambda b: picture[b[1] : b[3], b[0] : b[2]], (width, height), box, smooth)  # noqa: B023
            want = plain_blur(picture, box, smooth, radii, base)
            for r in (radii, rasters.padded_radii(boxes, width, height, base)):
                assert (rasters.blurred_box(*what, r, base) == want).all()
                assert rasters.blurred_sums(*what, r, base) == want[smooth > 0].sum(axis=0).tolist()
