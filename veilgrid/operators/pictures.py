"""Work on whole pictures (height x width x 4 bytes: blue, green, red, alpha) by numpy, frame by frame.

Pictures come from a reader where they are worked and are never moved. Frames do not depend on
each other here, so this needs no exchange beyond dealing the frames to tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.operators.rasters import Reader, Rolled, _batch, _frames, by_block, face_mask, pattern, picture_size, tasks

#: Pixels of pictures that are blurred at once.
PIXELS = 1 << 18
#: Steps between sampled points at most, samples at least, and the shares and variance that a face needs.
MOST_STEP, LEAST_SAMPLES, LEAST_SKIN, LEAST_EDGES, LEAST_VARIANCE = 4, 20, 0.015, 0.02, 200.0


def over_frames(frames: DataFrame, reader: Reader, worker: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """``video_id, frame_index`` and what ``worker`` makes of each frame's picture, in the columns of ``schema``."""
    full = f"video_id bigint, frame_index bigint, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(v, f, *worker(reader(v, f))) for v, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], full)

    keys = frames.select(F.col("video_id").cast("bigint"), F.col("frame_index").cast("bigint"))
    return keys.repartition(tasks(frames), "video_id", "frame_index").mapInArrow(run, full)


def target_size(width: int, height: int, ratio: float) -> tuple[int, int]:
    """Sides rounded half to even, one pixel at least; ratios that do not shrink leave the size."""
    return (max(1, round(width * ratio)), max(1, round(height * ratio))) if 0 < ratio < 1 else (width, height)


def planar(picture: np.ndarray) -> np.ndarray:
    """Blue, green and red as planes of shares of 255."""
    return np.moveaxis(picture[..., :3], 2, 0).astype(np.float32) * np.float32(1 / 255)


def nearest(picture: np.ndarray, ratio: float) -> np.ndarray:
    """Planes of a smaller picture: each pixel takes the one at the truncated position."""
    height, width = picture.shape[:2]
    wide, high = target_size(width, height, ratio)
    xs, ys = (np.minimum((np.arange(n) * (1 / ratio)).astype(int), most - 1) for n, most in ((wide, width), (high, height)))
    return planar(picture[ys[:, None], xs[None, :]])


def bilinear(picture: np.ndarray, ratio: float) -> np.ndarray:
    """Planes of a smaller picture: each pixel mixes the four around its position, counted from the corner."""
    height, width = picture.shape[:2]
    wide, high = target_size(width, height, ratio)

    def ends(n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.arange(n) * (1 / ratio)
        low = np.minimum(np.floor(place).astype(int), most - 1)
        return low, np.minimum(low + 1, most - 1), place - low

    (x0, x1, fx), (y0, y1, fy) = ends(wide, width), ends(high, height)
    part = picture[..., :3].astype(float)
    fx, fy = fx[None, :, None], fy[:, None, None]
    top = part[y0][:, x0] * (1 - fx) * (1 - fy) + part[y0][:, x1] * fx * (1 - fy)
    mixed = top + part[y1][:, x0] * (1 - fx) * fy + part[y1][:, x1] * fx * fy
    return (np.moveaxis(mixed, 2, 0) * (1 / 255)).astype(np.float32)


def separable_blur(picture: np.ndarray, radius: int) -> np.ndarray:
    """Integer means across, then down, the edge pixels repeated outward; opaque."""
    out = picture[..., :3].astype(np.int64)
    for axis in (1, 0):
        pad = [(0, 0)] * 3
        pad[axis] = (radius + 1, radius)
        sums = np.cumsum(np.pad(out, pad, mode="edge"), axis=axis)
        size, window = out.shape[axis], 2 * radius + 1
        out = (np.take(sums, np.arange(window, window + size), axis=axis) - np.take(sums, np.arange(size), axis=axis)) // window
    return np.concatenate([out, np.full((*out.shape[:2], 1), 255)], axis=2).astype(np.uint8)


def separable_blurs(pictures: np.ndarray, radius: int) -> np.ndarray:
    """``separable_blur`` of pictures of one size, one a row: a running sum goes over all of them at once."""
    window = 2 * radius + 1
    kind = np.uint16 if window * 255 < 1 << 16 else np.int64
    # Pictures last, so that each step works on what lies together.
    out = np.ascontiguousarray(pictures[..., :3].transpose(1, 2, 3, 0).astype(kind))
    for axis in (1, 0):
        lines, made = np.moveaxis(out, axis, 0), np.empty_like(out)
        means, last = np.moveaxis(made, axis, 0), out.shape[axis] - 1
        total = np.zeros(lines.shape[1:], kind)
        for k in range(-radius, radius + 1):
            total += lines[min(max(k, 0), last)]
        for k in range(last + 1):
            np.floor_divide(total, kind(window), out=means[k])
            total += lines[min(k + radius + 1, last)]
            total -= lines[max(k - radius, 0)]
        out = made
    done = np.full(pictures.shape, 255, np.uint8)
    done[..., :3] = out.transpose(3, 0, 1, 2)
    return done


def preview(picture: np.ndarray, blurred: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The picture with its blurred form where the mask (a byte a pixel) says so; opaque. Also of several, one a row."""
    # 255 * 255 + 127 fits 16 bits.
    alpha = mask.astype(np.uint16)[..., None]
    out = ((blurred * alpha + picture * (255 - alpha) + np.uint16(127)) // np.uint16(255)).astype(np.uint8)
    out[..., 3] = 255
    return out


def blended_sums(faces: DataFrame, width: Column, height: Column, reader: Reader, radius: int) -> DataFrame:
    """Of the preview of every frame with faces, blurred by its mask: the sums of its channels ``b, g, r``.

    Blurred and blended is what lies around the mask, of frames with masks of like size and place together; elsewhere a preview is the picture.
    """
    schema = "video_id bigint, frame_index bigint, b bigint, g bigint, r bigint"

    def sums(pictures: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(pictures).view("<u4").reshape(len(pictures), -1)
        return np.stack([((flat >> shift) & 255).sum(axis=1, dtype=np.int64) for shift in (0, 8, 16)], axis=1)

    def done(place: tuple, held: list[tuple]) -> list[tuple]:
        (top, left, high, wide), around = place[:4], np.stack([h[3] for h in held])
        inner, masks = around[:, top : top + high, left : left + wide], np.zeros((len(held), high, wide), np.uint8)
        for mask, (*_, x, y, alpha) in zip(masks, held, strict=True):
            mask[y : y + alpha.shape[0], x : x + alpha.shape[1]] = alpha
        shown = preview(inner, separable_blurs(around, radius)[:, top : top + high, left : left + wide], masks)
        found = sums(np.stack([h[2] for h in held])) + sums(shown) - sums(inner)
        return [(h[0], h[1], *c) for h, c in zip(held, found.tolist(), strict=True)]

    def span(low: int, high: int, most: int) -> tuple[int, int]:
        """Whole eighths from ``low`` to ``high``, within the picture."""
        size = min(most, -(-(high - low) // 8) * 8)
        return min(low, most - size), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, waiting = [], {}
            for video, _, frame, wide, high, boxes in _frames(batch):
                (x0, y0, x1, y1), alpha = face_mask(boxes, wide, high)
                if alpha.size:
                    own_wide, own_high, part = picture_size(reader, video, frame)
                    picture = part(video, frame, (0, 0, own_wide, own_high))
                    (left, across), (top, down) = span(x0, x1, own_wide), span(y0, y1, own_high)
                    first, upper = max(0, left - radius), max(0, top - radius)
                    around = picture[upper : top + down + radius, first : left + across + radius]
                    place = (top - upper, left - first, down, across, around.shape, picture.shape)
                    same = waiting.setdefault(place, [])
                    same.append((video, frame, picture, around, x0 - left, y0 - top, alpha))
                    if len(same) * own_wide * own_high >= PIXELS * 4:
                        out += done(place, same)
                        same.clear()
            yield _batch(out + [row for place, same in waiting.items() if same for row in done(place, same)], schema)

    return by_block(faces, width, height).mapInArrow(run, schema)


def luma(part: np.ndarray) -> np.ndarray:
    b, g, r = (part[..., k].astype(np.int32) for k in range(3))
    return (77 * r + 150 * g + 29 * b) >> 8


def skin(part: np.ndarray) -> np.ndarray:
    b, g, r = (part[..., k].astype(np.int32) for k in range(3))
    cb, cr = 128 + ((-43 * r - 85 * g + 128 * b) >> 8), 128 + ((128 * r - 107 * g - 21 * b) >> 8)
    return (cb >= 77) & (cb <= 127) & (cr >= 133) & (cr <= 173)


def face_box(width: int, height: int, x: float, y: float, w: float, h: float) -> tuple[int, int, int, int, int] | None:
    """A face's whole pixels within the picture and the step of its grid; None for a box of a pixel's width or height."""
    clamp = lambda v, most: int(max(0, min(max(0, most - 1), v)))
    x0, y0, x1, y1 = clamp(np.floor(x), width), clamp(np.floor(y), height), clamp(np.ceil(x + w) - 1, width), clamp(np.ceil(y + h) - 1, height)
    if x1 <= x0 or y1 <= y0:
        return None
    return x0, y0, x1 + 1, y1 + 1, int(max(1, min(MOST_STEP, np.floor(np.sqrt((x1 - x0 + 1) * (y1 - y0 + 1) / LEAST_SAMPLES)))))


def part_statistics(parts: np.ndarray) -> list[tuple[int, int, int, float, bool]]:
    """Samples, skin and edge counts and luma variance of sampled boxes of one shape (one a row), and whether they may be faces."""
    shades = luma(parts)
    samples, pairs = shades[0].size, shades[0, :, 1:].size + shades[0, 1:].size
    skins = np.count_nonzero(skin(parts), axis=(1, 2))
    edges = sum(np.count_nonzero(np.abs(np.diff(shades, axis=k)) > 20, axis=(1, 2)) for k in (2, 1))
    flat = shades.reshape(len(parts), -1).astype(np.int64)
    total, squares = flat.sum(axis=1), np.einsum("ij,ij->i", flat, flat)
    # In whole numbers up to the one division.
    variance = (samples * squares - total * total) / (samples * (samples - 1)) if samples > 1 else np.zeros(len(parts))
    passed = (samples >= LEAST_SAMPLES) & (skins / samples >= LEAST_SKIN) & (edges / max(1, pairs) >= LEAST_EDGES) & (variance >= LEAST_VARIANCE)
    return [(samples, *row) for row in zip(skins.tolist(), edges.tolist(), variance.tolist(), passed.tolist(), strict=True)]


def face_statistics(picture: np.ndarray, x: float, y: float, w: float, h: float) -> tuple[int | None, int | None, int | None, float | None, bool]:
    """Samples, skin and edge counts and luma variance of a box, on a grid of its own step, and whether it may be a face.

    The box is cut to whole pixels of the picture; a box of a pixel's width or height has no figures and fails.
    """
    box = face_box(picture.shape[1], picture.shape[0], x, y, w, h)
    if box is None:
        return NO_FIGURES
    x0, y0, x1, y1, step = box
    return part_statistics(picture[None, y0:y1:step, x0:x1:step])[0]


NO_FIGURES = (None, None, None, None, False)
#: Sampled boxes of a shape that are worked at once.
TOGETHER = 128


def face_stats(faces: DataFrame, reader: Reader) -> DataFrame:
    """``video_id, frame_index, face_idx, samples, skin, edges, variance, passed`` of every face, on its frame's own pixels.

    Of a picture only the sampled boxes are read, if its reader can; boxes of one shape are worked together.
    """
    schema = "video_id bigint, frame_index bigint, face_idx int, samples bigint, skin bigint, edges bigint, variance double, passed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, waiting = None, None, {}
        for batch in batches:
            out = []

            def done(parts: list) -> None:
                figures = part_statistics(np.stack([p for _, p in parts]))
                out.extend((*k, *f) for (k, _), f in zip(parts, figures, strict=True))  # noqa: B023
                parts.clear()

            for v, f, k, *sides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != (v, f):
                    held, size = (v, f), picture_size(reader, v, f)
                box = face_box(*size[:2], *sides)
                if box is None:
                    out.append((v, f, k, *NO_FIGURES))
                    continue
                part = size[2](v, f, box[:4], box[4])
                same = waiting.setdefault(part.shape, [])
                same.append(((v, f, k), part))
                if len(same) == TOGETHER:
                    done(same)
            for same in waiting.values():
                if same:
                    done(same)
            yield _batch(out, schema)

    columns = [F.col("video_id").cast("bigint"), F.col("frame_index").cast("bigint"), F.col("face_idx").cast("int"), *(F.col(c).cast("double") for c in "xywh")]
    whole = faces.select(*columns).dropna(subset=["x", "y", "w", "h"])
    dealt = whole.repartition(tasks(faces), "video_id", "frame_index")
    # Readers that give whole pictures are asked once a frame.
    return (dealt if isinstance(reader, Rolled) else dealt.sortWithinPartitions("video_id", "frame_index")).mapInArrow(run, schema)


#: Sides of the flat squares of the scene.
TILE = 200


@functools.cache
def scene(width: int, height: int) -> np.ndarray:
    """The test picture with flat grey squares."""
    x, y = np.arange(width)[None, :], np.arange(height)[:, None]
    flat = ((x // TILE + y // TILE) % 3 == 0)[..., None]
    return np.where(flat, np.array([90, 90, 90, 255], np.uint8), pattern(width, height)).astype(np.uint8)


def scene_reader(width: int, height: int) -> Reader:
    """The scene, which moves with the frame: 5 pixels right and 3 down, from a place of the video's own."""
    return Rolled(scene, width, height, lambda video, frame: (3 * frame % height, (17 * video + 5 * frame) % width))
