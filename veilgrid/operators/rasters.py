"""Frames as rasters: a binary value a frame, worked by numpy where it lies.

Pictures are arrays of height x width x 4 bytes (blue, green, red, alpha). Faces come as rows
``video_id, frame_index, x, y, w, h``; a frame without a face has no mask and takes no part.
Frames are cut into blocks of ``BLOCK`` (``FADING_BLOCK`` where masks fade) by their number, so that one long video is many tasks.

A mask fades over the frames of its video: each frame with a mask sets the pixels within the mask's
bounds to max(alpha, 3/4 of the value before). What a whole block does to a pixel is the
same kind of step: max(c, d(n, value before)), with c what the block gives from nothing, n how often it
touches the pixel and d(n, .) n times three quarters. Such steps can be put together, so blocks are
summed up side by side, one ordered pass over the sums by strips of rows gives each block the
values it begins with, and the blocks are then worked side by side. A new frame size begins from nothing.

Cases: faces outside the frame or without area still give the mask their clamped boxes give; null
boxes are left out; repeated faces change nothing; no faces give no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, STRIP = 64, 64
#: Fading masks are carried from block to block: fewer and longer blocks carry less.
FADING_BLOCK = 256
INNER = 0.65 * 0.65
#: Three quarters of 255, again and again, come to nothing after so many steps.
DECAY_STEPS = 18
#: Bytes of pictures in an Arrow batch.
BATCH_BYTES = 16 << 20
#: A pixel's four channels lie in one whole number, 16 bits each; the sum of a window's line has room there up to this radius.
PACKED_RADIUS = 128
EACH, OPAQUE = np.uint64(0x0001000100010001), np.uint64(255 << 48)

Box = tuple[int, int, int, int]
#: The radius of each pixel of a box (0: the base), or boxes of the picture with their radii, of which the largest counts.
Radii = np.ndarray | list[tuple[int, int, int, int, int]]
#: Gives the picture of a video's frame.
Reader = Callable[[int, int], np.ndarray]


@functools.cache
def decay_table() -> np.ndarray:
    """``table[n, v]``: v after n times three quarters, rounded down."""
    rows = [np.arange(256)]
    for _ in range(DECAY_STEPS):
        rows.append(rows[-1] * 3 // 4)
    return np.array(rows, dtype=np.uint8)


def clamped(v: float, most: int) -> int:
    return int(max(0, min(most, v)))


def soft_ellipse(wide: int, high: int) -> np.ndarray:
    """Alpha of a face's padded box."""
    dx, dy = np.arange(wide) - (wide - 1) / 2.0, np.arange(high) - (high - 1) / 2.0
    rx, ry = max(1.0, wide / 2.0), max(1.0, high / 2.0)
    d2 = (dx * dx / (rx * rx))[None, :] + (dy * dy / (ry * ry))[:, None]
    t = (d2 - INNER) / (1.0 - INNER)
    soft = np.rint((1.0 - t * t * (3.0 - 2.0 * t)) * 255.0)
    return np.where(d2 <= INNER, 255, np.where(d2 <= 1.0, soft, 0)).astype(np.uint8)


def lit_ellipse(wide: int, high: int) -> tuple[int, int, np.ndarray]:
    """Where the lit pixels of ``soft_ellipse`` begin (column, row), and alpha within their bounds."""
    alpha = soft_ellipse(wide, high)
    rows, columns = np.flatnonzero(alpha.any(axis=1)), np.flatnonzero(alpha.any(axis=0))
    alpha = np.ascontiguousarray(alpha[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]) if len(rows) else alpha[:0, :0]
    alpha.flags.writeable = False
    return (int(columns[0]), int(rows[0]), alpha) if len(rows) else (0, 0, alpha)


#: Boxes of few pixels are of few sizes: the latest ones are kept, at most 256 x 64 KB.
kept_ellipse = functools.lru_cache(256)(lit_ellipse)


def face_mask(faces: np.ndarray, width: int, height: int) -> tuple[Box, np.ndarray]:
    """The bounds of the lit pixels, and alpha within: soft ellipses, the largest where they overlap."""
    boxes = []
    for x, y, w, h in faces.tolist():
        pad_x, pad_y = max(6.0, w * 0.15), max(6.0, h * 0.25)
        x0, y0 = clamped(np.floor(x - pad_x), max(0, width - 1)), clamped(np.floor(y - pad_y), max(0, height - 1))
        x1, y1 = clamped(np.ceil(x + w + pad_x), width), clamped(np.ceil(y + h + pad_y), height)
        if x0 < x1 and y0 < y1:
            made = kept_ellipse if (x1 - x0) * (y1 - y0) <= 1 << 16 else lit_ellipse
            left, top, alpha = made(x1 - x0, y1 - y0)
            if alpha.size:
                boxes.append((x0 + left, y0 + top, x0 + left + alpha.shape[1], y0 + top + alpha.shape[0], alpha))
    if len(boxes) < 2:
        return (boxes[0][:4], boxes[0][4]) if boxes else ((0, 0, 0, 0), np.zeros((0, 0), np.uint8))
    left, top, right, bottom = (f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max)))
    alpha = np.zeros((bottom - top, right - left), np.uint8)
    for x0, y0, x1, y1, a in boxes:
        part = alpha[y0 - top : y1 - top, x0 - left : x1 - left]
        np.maximum(part, a, out=part)
    return (left, top, right, bottom), alpha


def face_radii(faces: np.ndarray, width: int, height: int, base: int, box: Box) -> np.ndarray:
    """The blur radius of each pixel of ``box``: the largest of the faces whose padded box holds it, else 0, which means ``base``."""
    x0, y0, x1, y1 = box
    out = np.zeros((y1 - y0, x1 - x0), np.int32)
    for left, top, right, bottom, radius in padded_radii(faces, width, height, base):
        left, top, right, bottom = max(x0, left), max(y0, top), min(x1, right), min(y1, bottom)
        if left < right and top < bottom:
            part = out[top - y0 : bottom - y0, left - x0 : right - x0]
            np.maximum(part, radius, out=part)
    return out


def padded_radii(faces: np.ndarray, width: int, height: int, base: int) -> list[tuple[int, int, int, int, int]]:
    """The padded boxes of faces, cut to the frame, and their blur radii."""
    out = []
    for x, y, w, h in faces.tolist():
        share = w * h * 100.0 / (width * height)
        scale = 0.4 if share <= 1 else 0.55 if share <= 3 else 0.7 if share <= 5 else 1.0
        radius = max(1, base) if base <= 1 else int(max(1, min(base, np.rint(base * scale))))
        pad_x, pad_y = max(6.0, w * 0.15), max(6.0, h * 0.25)
        out.append((int(np.floor(max(0.0, x - pad_x))), int(np.floor(max(0.0, y - pad_y))), int(np.ceil(min(float(width), x + w + pad_x))), int(np.ceil(min(float(height), y + h + pad_y))), radius))
    return out


def box_means(box: Box, radius: int, sums: np.ndarray, origin: tuple[int, int], limits: tuple[int, int]) -> np.ndarray:
    """Integer means over the square windows of the pixels of ``box``, from a summed-area table that begins at ``origin``.

    Windows are cut at the edges of the picture; ``limits`` are its width and height.
    """
    x0, y0, x1, y1 = box
    if x0 >= radius and y0 >= radius and x1 + radius <= limits[0] and y1 + radius <= limits[1]:
        window, left, top = 2 * radius + 1, x0 - radius - origin[0], y0 - radius - origin[1]
        across = slice(left, left + x1 - x0 + window)
        rows = sums[top + window : top + window + y1 - y0, across] - sums[top : top + y1 - y0, across]
        return (rows[:, window:] - rows[:, : x1 - x0]) // rows.dtype.type(window * window)
    xs, ys = np.arange(x0, x1), np.arange(y0, y1)
    left, right = np.maximum(0, xs - radius), np.minimum(limits[0], xs + radius + 1)
    top, bottom = np.maximum(0, ys - radius), np.minimum(limits[1], ys + radius + 1)
    rows = sums[bottom - origin[1]] - sums[top - origin[1]]
    total = rows[:, right - origin[0]] - rows[:, left - origin[0]]
    area = ((bottom - top)[:, None] * (right - left)[None, :])[..., None].astype(total.dtype)
    # Whole numbers below 2^24 are exact as floats, and so is then the whole part of their quotient.
    return (total.astype(np.float32) / area.astype(np.float32)).astype(total.dtype) if radius < 128 else total // area


def summed_area(part: np.ndarray) -> np.ndarray:
    """``out[j, i]``: the sum of the first j rows and i columns."""
    kind = np.int32 if part.shape[0] * part.shape[1] * 255 < 1 << 31 else np.int64
    out = np.zeros((part.shape[0] + 1, part.shape[1] + 1, part.shape[2]), kind)
    np.cumsum(part, axis=0, dtype=kind, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
    return out


def blurred(picture: np.ndarray, box: Box, smooth: np.ndarray, radii: np.ndarray, base: int) -> np.ndarray:
    """The pixels of ``box``, blurred by their radii (0: ``base``) and blended by ``smooth``.

    Fully masked pixels take the mean of all four channels; others become opaque.
    """
    return blurred_box(lambda b: picture[b[1] : b[3], b[0] : b[2]], (picture.shape[1], picture.shape[0]), box, smooth, radii, base)


def blurred_box(read: Callable[[Box], np.ndarray], limits: tuple[int, int], box: Box, smooth: np.ndarray, radii: Radii, base: int) -> np.ndarray:
    """``blurred`` of a picture of size ``limits``, of which ``read`` gives parts: only what lies around lit pixels is read and worked."""
    out = read(box).copy()
    for (a, b, c, d), alpha, mixed in blurred_parts(read, limits, box, smooth, radii, base):
        np.copyto(out[b:d, a:c], mixed.view(np.uint16).reshape(d - b, c - a, 4), where=(alpha > 0)[..., None], casting="unsafe")
    return out


def blurred_sums(read: Callable[[Box], np.ndarray], limits: tuple[int, int], box: Box, smooth: np.ndarray, radii: Radii, base: int) -> list[int]:
    """Sums of the four channels of ``blurred_box`` over lit pixels."""
    totals = np.zeros(4, np.int64)
    for _, alpha, mixed in blurred_parts(read, limits, box, smooth, radii, base):
        # 257 values of a byte have room in 16 bits.
        for top in range(0, len(mixed), 257):
            totals += np.add.reduce(mixed[top : top + 257], axis=0).view(np.uint16).reshape(-1, 4).sum(axis=0, dtype=np.int64)
        dark = mixed.ravel()[np.flatnonzero(alpha == 0)]
        totals -= dark.view(np.uint16).reshape(-1, 4).sum(axis=0, dtype=np.int64)
    return totals.tolist()


def blurred_parts(read: Callable[[Box], np.ndarray], limits: tuple[int, int], box: Box, smooth: np.ndarray, radii: Radii, base: int) -> Iterator[tuple[Box, np.ndarray, np.ndarray]]:
    """Parts of ``box`` (counted from its corner) of one radius each, alpha of the pixels that they stand for, and these blurred and blended, channels in 16 bits each.

    A part is worked for all channels at once: sums along lines by one running sum, down the columns by another.
    """
    x0, y0, _, _ = box
    most = max(1, base)
    columns = np.flatnonzero(np.bitwise_or.reduce(smooth, axis=0))
    for span in np.split(columns, np.flatnonzero(np.diff(columns) > 2 * most) + 1) if len(columns) else []:
        a, c = int(span[0]), int(span[-1]) + 1
        rows = np.flatnonzero(smooth[:, a:c].max(axis=1))
        b, d = int(rows[0]), int(rows[-1]) + 1
        alpha, whole = smooth[b:d, a:c], (x0 + a, y0 + b, x0 + c, y0 + d)
        for radius, (i, j, k, m), mask in radius_pieces(alpha, radii if isinstance(radii, list) else radii[b:d, a:c], whole, most):
            own, inner = alpha[j:m, i:k], (whole[0] + i, whole[1] + j, whole[0] + k, whole[1] + m)
            reach = radius if radius <= PACKED_RADIUS else 0
            around = packed(read, inner, reach, limits)
            new = means(around, inner, radius, limits) if reach else wide_means(read, inner, radius, limits)
            own = own if mask is None else np.where(mask, own, np.uint8(0))
            yield (a + i, b + j, a + k, b + m), own, blended(around[reach : reach + m - j, reach : reach + k - i], new, own)


def radius_pieces(alpha: np.ndarray, radii: Radii, whole: Box, most: int) -> list[tuple[int, Box, np.ndarray | None]]:
    """Radii, boxes (counted from the corner of ``whole``) and masks (none: all of the box) that give each lit pixel its one radius."""

    def boxes(here: np.ndarray) -> Iterator[Box]:
        """Boxes of what is set, without wide gaps between columns."""
        xs = np.flatnonzero(np.logical_or.reduce(here, axis=0))
        for part in np.split(xs, np.flatnonzero(np.diff(xs) > 8) + 1) if len(xs) else []:
            i, k = int(part[0]), int(part[-1]) + 1
            ys = np.flatnonzero(here[:, i:k].any(axis=1))
            yield i, int(ys[0]), k, int(ys[-1]) + 1

    (x0, y0, x1, y1), (high, wide) = whole, alpha.shape
    if isinstance(radii, list):
        cut = [(r, (max(0, a - x0), max(0, b - y0), min(wide, c - x0), min(high, d - y0))) for a, b, c, d, r in radii if a < x1 and b < y1 and c > x0 and d > y0]
        cut.sort()
        if cut and cut[-1][1] == (0, 0, wide, high):
            return [(*cut[-1], None)]
        # The largest radius first: what it takes is not left to others.
        rest, out = alpha > 0, []
        for radius, (i, j, k, m) in reversed(cut):
            alone = all(i >= o[2] or k <= o[0] or j >= o[3] or m <= o[1] for _, o, _ in out)
            out.append((radius, (i, j, k, m), None if alone else rest[j:m, i:k].copy()))
            rest[j:m, i:k] = False
        return out + [(most, (i, j, k, m), rest[j:m, i:k]) for i, j, k, m in boxes(rest)]
    lit, wanted = alpha > 0, np.where(radii > 0, radii, most)
    return [(r, (i, j, k, m), here[j:m, i:k]) for r in np.flatnonzero(np.bincount(wanted[lit])).tolist() for here in [(wanted == r) & lit] for i, j, k, m in boxes(here)]


def packed(read: Callable[[Box], np.ndarray], box: Box, reach: int, limits: tuple[int, int]) -> np.ndarray:
    """The pixels of ``box`` and ``reach`` around it, channels in 16 bits each; nothing beyond the picture."""
    left, top, right, bottom = box[0] - reach, box[1] - reach, box[2] + reach, box[3] + reach
    inner = (max(0, left), max(0, top), min(limits[0], right), min(limits[1], bottom))
    part = read(inner)
    if inner == (left, top, right, bottom):
        wide = part.astype(np.uint16, order="C")
    else:
        wide = np.zeros((bottom - top, right - left, 4), np.uint16)
        wide[inner[1] - top : inner[3] - top, inner[0] - left : inner[2] - left] = part
    return wide.view(np.uint64)[..., 0]


def wide_means(read: Callable[[Box], np.ndarray], box: Box, radius: int, limits: tuple[int, int]) -> np.ndarray:
    """``means`` of any radius."""
    left, top, right, bottom = max(0, box[0] - radius), max(0, box[1] - radius), min(limits[0], box[2] + radius), min(limits[1], box[3] + radius)
    return box_means(box, radius, summed_area(read((left, top, right, bottom))), (left, top), limits).astype(np.uint16, order="C").view(np.uint64)[..., 0]


def means(around: np.ndarray, box: Box, radius: int, limits: tuple[int, int]) -> np.ndarray:
    """Integer means over the square windows of the pixels of ``box``, cut at the edges of the picture, channels in 16 bits each.

    ``around`` are the pixels of the box and ``radius`` around it.
    """
    (x0, y0, x1, y1), window, size = box, 2 * radius + 1, around.size
    wide, high = x1 - x0, y1 - y0
    # All lines one after the other, modulo 2^64: differences are right.
    sums = np.empty(size + window, np.uint64)
    sums[0] = 0
    np.cumsum(around.ravel(), out=sums[1 : size + 1])
    across = (sums[window:] - sums[:size]).reshape(around.shape)[:, :wide]
    # Sums of whole windows need more than 16 bits.
    down = np.empty((high + window, 4 * wide), np.uint32)
    down[0] = 0
    down[1:] = across.view(np.uint16)
    running_sums(down)
    total = down[window:] - down[:-window]
    if x0 >= radius and y0 >= radius and x1 + radius <= limits[0] and y1 + radius <= limits[1]:
        total //= np.uint32(window * window)
    else:
        # Division by the one count and then by the other is division by their product.
        across_counts, down_counts = (np.minimum(most, at + radius + 1) - np.maximum(0, at - radius) for most, at in zip(limits, (np.arange(x0, x1), np.arange(y0, y1)), strict=True))
        for p, q in equal_runs(down_counts):
            total[p:q] //= np.uint32(down_counts[p])
        for p, q in equal_runs(across_counts):
            total[:, 4 * p : 4 * q] //= np.uint32(across_counts[p])
    return total.astype(np.uint16).view(np.uint64)


def running_sums(rows: np.ndarray, group: int = 16) -> None:
    """Each row becomes the sum of the rows up to it: within groups of rows, all groups at once, and then group by group."""
    whole = len(rows) // group * group
    groups = rows[:whole].reshape(-1, group, rows.shape[1])
    for k in range(1, group):
        groups[:, k] += groups[:, k - 1]
    for k in range(1, len(groups)):
        groups[k] += groups[k - 1, -1]
    for k in range(max(1, whole), len(rows)):
        rows[k] += rows[k - 1]


def equal_runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ends of the runs of equal values."""
    ends = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(ends, ends[1:], strict=False))


def blended(before: np.ndarray, new: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """``new`` by ``alpha`` over ``before``, channels in 16 bits each; what is mixed at all becomes opaque."""
    share = (alpha * EACH).view(np.uint16)
    rest = np.uint16(255) - share
    rest *= before.view(np.uint16)
    # 255 * 255 + 127 fits 16 bits.
    mixed = np.multiply(new.view(np.uint16), share, out=share)
    mixed += rest
    mixed += np.uint16(127)
    mixed //= np.uint16(255)
    out = mixed.view(np.uint64)
    if out.min() < OPAQUE:
        mixed.reshape(*alpha.shape, 4)[..., 3][(alpha > 0) & (alpha < 255)] = 255
    return out


@dataclass
class Fading:
    """Mask values of one video at one frame size, and how often each pixel was touched."""

    width: int
    height: int

    def __post_init__(self) -> None:
        self.value = np.zeros((self.height, self.width), np.uint8)
        self.steps = np.zeros((self.height, self.width), np.uint8)

    def step(self, box: Box, alpha: np.ndarray) -> np.ndarray:
        """Take in the mask of a frame; what its pixels are then."""
        x0, y0, x1, y1 = box
        value = self.value[y0:y1, x0:x1]
        # A quarter, rounded up, is taken away.
        lost = value >> 2
        lost += (value & 3) != 0
        np.subtract(value, lost, out=lost)
        return np.maximum(alpha, lost, out=value)

    def count(self, box: Box) -> None:
        """The pixels of ``box`` were touched once more."""
        x0, y0, x1, y1 = box
        steps = self.steps[y0:y1, x0:x1]
        np.minimum(steps + np.uint8(1), DECAY_STEPS, out=steps)


def tasks(df: DataFrame) -> int:
    """Partitions for work that is heavy for its bytes, so that small tables are not put into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def by_block(faces: DataFrame, width: Column, height: Column, block: int = BLOCK) -> DataFrame:
    """``video_id, block, frame_index, width, height, boxes`` of every frame with faces; frames of a block lie together."""
    boxed = faces.select("video_id", F.floor(F.col("frame_index") / block).alias("block"), "frame_index", width.cast("int").alias("width"), height.cast("int").alias("height"), F.array(*(F.col(c).cast("double") for c in "xywh")).alias("box"))
    whole = boxed.where(~F.exists("box", lambda v: v.isNull() | F.isnan(v)))
    return whole.repartition(tasks(faces), "video_id", "block").groupBy("video_id", "block", "frame_index", "width", "height").agg(F.sort_array(F.collect_set("box")).alias("boxes"))


def size_runs(frames: DataFrame) -> DataFrame:
    """``video_id, block, first_run, last_run, strips``: numbers of the runs of equal frame size that a block begins and ends in, and the strips of the frames that it begins with."""
    size = F.struct("width", "height")
    within = Window.partitionBy("video_id", "block").orderBy("frame_index")
    changed = frames.withColumn("changed", F.coalesce((F.lag(size).over(within) != size).cast("int"), F.lit(0)))
    blocks = changed.groupBy("video_id", "block").agg(F.sum("changed").alias("inside"), F.min_by(size, "frame_index").alias("first"), F.max_by(size, "frame_index").alias("last"))
    along = Window.partitionBy("video_id").orderBy("block")
    entered = blocks.withColumn("entered", F.coalesce((F.lag("last").over(along) != F.col("first")).cast("int"), F.lit(0)))
    numbered = entered.withColumn("last_run", F.sum(F.col("entered") + F.col("inside")).over(along))
    strips = F.when(F.col("first.height") > 0, F.sequence(F.lit(0), F.floor((F.col("first.height") - 1) / STRIP).cast("int")))
    return numbered.select("video_id", "block", (F.col("last_run") - F.col("inside")).alias("first_run"), "last_run", strips.alias("strips"))


def _frames(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Video, block, frame, width, height and faces of each row."""
    names = ("video_id", "block", "frame_index", "width", "height", "boxes")
    for *key, boxes in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
        yield (*key, np.array(boxes, dtype=float).reshape(-1, 4) if boxes else None)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(fields)], schema=fields)


@functools.cache
def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


MASK_SCHEMA = "x0 int, y0 int, x1 int, y1 int, lit bigint, sum bigint, alpha binary"
RADII_SCHEMA = "video_id bigint, frame_index bigint, covered bigint, radius bigint, most int, radii binary"
STEP_SCHEMA = "video_id bigint, block bigint, strip int, value binary, steps binary"
CARRY_SCHEMA = "video_id bigint, block bigint, strip int, value binary"


def block_steps(frames: DataFrame) -> DataFrame:
    """``video_id, block, strip, value, steps``: what a block does to each strip of rows that it touches, since its last change of size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def done() -> Iterator[pa.RecordBatch]:
            rows = [(*held, top // STRIP, zlib.compress(state.value[top : top + STRIP].tobytes(), 1), zlib.compress(state.steps[top : top + STRIP].tobytes(), 1)) for top in range(0, state.height, STRIP) if state.steps[top : top + STRIP].any()]
            yield _batch(rows, STEP_SCHEMA)

        for batch in batches:
            for video, block, _, width, height, boxes in _frames(batch):
                if held != (video, block):
                    if held is not None:
                        yield from done()
                    held, state = (video, block), Fading(width, height)
                elif (state.width, state.height) != (width, height):
                    state = Fading(width, height)
                box, alpha = face_mask(boxes, width, height)
                if alpha.size:
                    state.step(box, alpha)
                    state.count(box)
        if held is not None:
            yield from done()

    ordered = frames.sortWithinPartitions("video_id", "block", "frame_index")
    return ordered.mapInArrow(run, STEP_SCHEMA)


def carried(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """``video_id, block, strip, value``: what each block begins with, where that is not nothing.

    One ordered pass by video, run of equal size and strip of rows, over a row a block.
    """
    placed = steps.join(runs.drop("strips"), ["video_id", "block"])
    writes = placed.select("video_id", F.col("last_run").alias("run"), "strip", "block", F.lit(1).alias("writes"), "value", "steps")
    # A block reads every strip: which ones its run has touched is known only to the steps, and those are not worked twice for it.
    reads = runs.select("video_id", F.col("first_run").alias("run"), "block", F.explode("strips").alias("strip"))
    both = writes.unionByName(reads.select("video_id", "run", "strip", "block", F.lit(0).alias("writes"), F.lit(None).cast("binary").alias("value"), F.lit(None).cast("binary").alias("steps")))
    keys = ["video_id", "run", "strip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, table = None, None, decay_table()
        for batch in batches:
            out = []
            for video, number, strip, block, writes, value, steps in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if held != (video, number, strip):
                    held, state = (video, number, strip), None
                if writes:
                    new = np.frombuffer(zlib.decompress(value), np.uint8)
                    state = new if state is None else np.maximum(new, table.take(np.frombuffer(zlib.decompress(steps), np.uint8).astype(np.intp) * 256 + state))
                elif state is not None and state.any():
                    out.append((video, block, strip, zlib.compress(state.tobytes(), 1)))
            yield _batch(out, CARRY_SCHEMA)

    ordered = both.repartition(tasks(steps), *keys).sortWithinPartitions(*keys, "block", "writes")
    return ordered.mapInArrow(run, CARRY_SCHEMA)


#: A worker turns the faces of a frame, and its faded mask, into the values of the output columns.
Worker = Callable[[int, int, int, int, np.ndarray, Box, np.ndarray], tuple]


def over_faded(faces: DataFrame, width: Column, height: Column, worker: Worker, schema: str, block: int = FADING_BLOCK) -> DataFrame:
    """``worker`` on every frame with a mask: video, frame, width, height, faces, bounds of the mask and its faded values.

    Returns ``video_id, frame_index`` and the columns of ``schema``.
    """
    frames = by_block(faces, width, height, block)
    begun = carried(block_steps(frames), size_runs(frames))
    full = f"video_id bigint, frame_index bigint, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, strips, out, size = None, None, {}, [], 0
        for batch in batches:
            extra = zip(batch.column(batch.schema.get_field_index("strip")).to_pylist(), batch.column(batch.schema.get_field_index("value")).to_pylist(), strict=True)
            for (video, number, frame, wide, high, boxes), (strip, value) in zip(_frames(batch), extra, strict=True):
                if held != (video, number):
                    held, state, strips = (video, number), None, {}
                if value is not None:
                    strips[strip] = np.frombuffer(zlib.decompress(value), np.uint8)
                    continue
                if state is None or (state.width, state.height) != (wide, high):
                    state = Fading(wide, high)
                    for k, flat in strips.items():
                        state.value[k * STRIP : (k + 1) * STRIP] = flat.reshape(-1, wide)
                    strips = {}
                box, alpha = face_mask(boxes, wide, high)
                if alpha.size:
                    row = (video, frame, *worker(video, frame, wide, high, boxes, box, state.step(box, alpha)))
                    out.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes)) + 100
                    if size > BATCH_BYTES:
                        yield _batch(out, full)
                        out, size = [], 0
        yield _batch(out, full)

    nothing = {"strip": F.lit(None).cast("int"), "value": F.lit(None).cast("binary")}
    empty = {"frame_index": F.lit(-1).cast("bigint"), "width": F.lit(0), "height": F.lit(0), "boxes": F.lit(None).cast("array<array<double>>")}
    both = frames.withColumn("frame_index", F.col("frame_index").cast("bigint")).withColumns(nothing).unionByName(begun.withColumns(empty))
    columns = ["video_id", "block", "frame_index", "width", "height", "boxes", "strip", "value"]
    # Values that a block begins with come before its frames.
    ordered = both.select(*columns).repartition(tasks(faces), "video_id", "block").sortWithinPartitions("video_id", "block", F.col("value").isNull(), "frame_index")
    return ordered.mapInArrow(run, full)


def over_frames_with_faces(faces: DataFrame, width: Column, height: Column, worker: Worker, schema: str) -> DataFrame:
    """Like ``over_faded``, with the mask of the frame alone in place of the faded one: frames need no order here."""
    full = f"video_id bigint, frame_index bigint, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = ((v, f, w, h, boxes, *face_mask(boxes, w, h)) for v, _, f, w, h, boxes in _frames(batch))
            yield _batch([(row[0], row[1], *worker(*row)) for row in masked if row[6].size], full)

    return by_block(faces, width, height).mapInArrow(run, full)


def faded_masks(faces: DataFrame, width: Column, height: Column, block: int = FADING_BLOCK) -> DataFrame:
    """``video_id, frame_index, x0, y0, x1, y1, alpha, smooth``: each mask within its bounds, as it is and as it fades, a byte a pixel."""

    def worker(video: int, frame: int, wide: int, high: int, boxes: np.ndarray, box: Box, smooth: np.ndarray) -> tuple:
        return (*box, face_mask(boxes, wide, high)[1].tobytes(), smooth.tobytes())

    return over_faded(faces, width, height, worker, "x0 int, y0 int, x1 int, y1 int, alpha binary, smooth binary", block)


def masks(faces: DataFrame, width: Column, height: Column) -> DataFrame:
    """The mask of every frame with faces: its bounds, ``lit`` pixels, the ``sum`` of alpha, and ``alpha`` within the bounds, a byte a pixel."""

    def worker(video: int, frame: int, wide: int, high: int, boxes: np.ndarray, box: Box, alpha: np.ndarray) -> tuple:
        return (*box, int((alpha > 0).sum()), int(alpha.sum(dtype=np.int64)), alpha.tobytes())

    return over_frames_with_faces(faces, width, height, worker, MASK_SCHEMA)


def fades(faces: DataFrame, width: Column, height: Column, block: int = FADING_BLOCK) -> DataFrame:
    """Of the fading mask of every frame with faces: pixels that are ``lit``, and their sum ``alpha``."""

    def worker(video: int, frame: int, wide: int, high: int, boxes: np.ndarray, box: Box, smooth: np.ndarray) -> tuple:
        return int((smooth > 0).sum()), int(smooth.sum(dtype=np.int64))

    return over_faded(faces, width, height, worker, "lit bigint, alpha bigint", block)


def radii(faces: DataFrame, width: Column, height: Column, base: int) -> DataFrame:
    """Of the radii of every frame with faces: pixels ``covered``, the sum ``radius``, the largest ``most``, and ``radii``, four bytes a pixel of the frame, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v, _, f, w, h, boxes in _frames(batch):
                r = face_radii(boxes, w, h, base, (0, 0, w, h))
                made.append((v, f, int((r > 0).sum()), int(r.sum(dtype=np.int64)), int(r.max(initial=0)), zlib.compress(r.tobytes(), 1)))
            yield _batch([m for m in made if m[2]], RADII_SCHEMA)

    return by_block(faces, width, height).mapInArrow(run, RADII_SCHEMA)


def export(faces: DataFrame, width: Column, height: Column, base: int, reader: Reader, with_pixels: bool = True, block: int = FADING_BLOCK) -> DataFrame:
    """Every frame with a mask, blurred by the sizes of its faces and blended by the fading mask.

    ``reader`` gives a frame's picture where it is worked; pictures are never moved. Returns the box that
    changes, how many of its pixels are ``changed``, the sums of their channels ``b, g, r, a``, and the box's ``pixels`` if asked for.
    """

    def worker(video: int, frame: int, wide: int, high: int, boxes: np.ndarray, box: Box, smooth: np.ndarray) -> tuple:
        own_wide, own_high, part = picture_size(reader, video, frame)
        what = (lambda b: part(video, frame, b), (own_wide, own_high), box, smooth, padded_radii(boxes, wide, high, base), base)
        lit = int(np.count_nonzero(smooth > 0))
        if not with_pixels:
            return (*box, lit, *blurred_sums(*what))
        new = blurred_box(*what)
        return (*box, lit, *new[smooth > 0].sum(axis=0, dtype=np.int64).tolist(), new.tobytes())

    schema = "x0 int, y0 int, x1 int, y1 int, changed bigint, b bigint, g bigint, r bigint, a bigint"
    return over_faded(faces, width, height, worker, schema + (", pixels binary" if with_pixels else ""), block)


def byte_sum(column: Column) -> Column:
    """The sum of the bytes of a binary column; null for null."""

    @F.pandas_udf("bigint")
    def total(values: pd.Series) -> pd.Series:
        return values.map(lambda v: int(np.frombuffer(v, np.uint8).sum(dtype=np.int64)), na_action="ignore")

    return total(column)


@functools.cache
def pattern(width: int, height: int) -> np.ndarray:
    """The checkered test picture, opaque."""
    x, y = np.arange(width)[None, :], np.arange(height)[:, None]
    grid, even = (x % 12 == 0) | (y % 12 == 0), (x // 6 + y // 6) % 2 == 0
    tone = lambda a, b, c: np.where(grid, a, np.where(even, b, c))
    return np.stack([tone(140, 120, 90), tone(220, 190, 140), tone(240, 210, 160), np.full((height, width), 255)], axis=2).astype(np.uint8)


@functools.cache
def doubled(made: Callable[[int, int], np.ndarray], width: int, height: int) -> np.ndarray:
    """A picture twice across and twice down: every rolled form of it is a slice. It is made in each worker."""
    return np.tile(made(width, height), (2, 2, 1))


@dataclass
class Rolled:
    """A reader of one picture that ``shift`` moves (down, right) with the frame; parts are read without the rest."""

    made: Callable[[int, int], np.ndarray]
    width: int
    height: int
    shift: Callable[[int, int], tuple[int, int]]

    def __call__(self, video: int, frame: int) -> np.ndarray:
        return self.part(video, frame, (0, 0, self.width, self.height)).copy()

    def part(self, video: int, frame: int, box: Box, step: int = 1) -> np.ndarray:
        x0, y0, x1, y1 = box
        down, right = self.shift(video, frame)
        top, left = (y0 - down) % self.height, (x0 - right) % self.width
        return doubled(self.made, self.width, self.height)[top : top + y1 - y0 : step, left : left + x1 - x0 : step]


def picture_size(reader: Reader, video: int, frame: int) -> tuple[int, int, Reader]:
    """Width and height of a frame's picture, and a reader for its parts: one that knows its size is not asked for the whole."""
    if isinstance(reader, Rolled):
        return reader.width, reader.height, reader.part
    picture = reader(video, frame)
    return picture.shape[1], picture.shape[0], lambda v, f, box, step=1: picture[box[1] : box[3] : step, box[0] : box[2] : step].copy()


def pattern_reader(width: int, height: int, moving: bool = True) -> Reader:
    """Pictures made from the test picture: frame k shows it moved by k pixels, or always the same."""
    return Rolled(pattern, width, height, (lambda video, frame: (frame % 12, (video + frame) % 12)) if moving else (lambda video, frame: (0, 0)))
