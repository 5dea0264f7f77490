"""Rectangles in other coordinates, moves along a time line, and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgrid.functions.geometry import clamp, nice_step

#: Texts shown to users, and choices offered to them.
HOURS, MINUTES, SECONDS = "시간", "분", "초"
NO_INFORMATION, LAST_DONE, UPDATED, AGO = "정보 없음", "마지막 처리: ", " · 업데이트 ", " 전"
THREAD_CHOICES = (1, 2, 4, 6, 8, 12, 16, 24, 32)
LEAST_SPAN, ZOOM_IN, ZOOM_OUT = 0.05, 0.85, 1.15


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def clamp_rect(r: Column, width: Column, height: Column) -> Column:
    """The part of a rectangle that lies within the size; without width or height if nothing does."""
    zero = F.lit(0.0)
    x, y = F.greatest(zero, r["x"]), F.greatest(zero, r["y"])
    return rect(x, y, F.greatest(zero, F.least(width, r["x"] + r["w"]) - x), F.greatest(zero, F.least(height, r["y"] + r["h"]) - y))


def offset_rect(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["x"] + dx, r["y"] + dy, r["w"], r["h"])


def scale_rect(r: Column, sx: Column, sy: Column) -> Column:
    """Scaled from the origin; left alone if both factors are within 0.0001 of one."""
    same = (F.abs(sx - 1.0) < 0.0001) & (F.abs(sy - 1.0) < 0.0001)
    scaled = rect(r["x"] * sx, r["y"] * sy, r["w"] * sx, r["h"] * sy)
    return F.when(same, rect(r["x"], r["y"], r["w"], r["h"])).otherwise(scaled)


def from_letterbox(px: Column, py: Column, box_w: float, box_h: float, width: float, height: float) -> Column:
    """The image point under a point of the box that shows the image whole and centred; null outside the image."""
    scale = min(box_w / width, box_h / height)
    x, y = (px - (box_w - width * scale) / 2) / scale, (py - (box_h - height * scale) / 2) / scale
    return F.when((x >= 0) & (y >= 0) & (x < width) & (y < height), F.struct(x.alias("x"), y.alias("y")))


def to_letterbox(r: Column, box_w: float, box_h: float, width: float, height: float) -> Column:
    scale = min(box_w / width, box_h / height)
    return rect((box_w - width * scale) / 2 + r["x"] * scale, (box_h - height * scale) / 2 + r["y"] * scale, r["w"] * scale, r["h"] * scale)


def seconds_of(frame: Column, fps: Column) -> Column:
    return F.when(frame < 0, 0.0).otherwise(frame / fps)


def frame_at_x(x: Column, width: float, start: Column, span: Column, fps: Column, total: Column) -> Column:
    """The frame under a pixel of the time line."""
    t = clamp(x / max(1.0, width), F.lit(0.0), F.lit(1.0))
    at = F.floor((start + F.greatest(F.lit(LEAST_SPAN), span) * t) * F.greatest(F.lit(1.0), fps))
    return clamp(at, F.lit(0), F.greatest(F.lit(0), total - 1))


def moved(frame: Column, key: Column, shift: Column, fps: Column, total: Column) -> Column:
    """Where a key leads: arrows by one or (with shift) ten frames, up and down by a second, home and end."""
    step, second = F.when(shift, 10).otherwise(1), F.rint(fps).cast("bigint")
    to = F.when(key == "left", frame - step).when(key == "right", frame + step).when(key == "up", frame + second).when(key == "down", frame - second)
    to = to.when(key == "home", 0).when(key == "end", total - 1).otherwise(frame)
    return F.when(total <= 0, frame).otherwise(clamp(to, F.lit(0), total - 1))


def clamp_start(start: Column, span: Column, duration: Column) -> Column:
    return clamp(start, F.lit(0.0), F.greatest(F.lit(0.0), duration - span))


def wheeled(start: Column, span: Column, duration: Column, delta: Column, anchor: Column, zooming: Column) -> Column:
    """struct<start, span> after a turn of the wheel: a zoom that keeps ``anchor`` (0 to 1) in place, or a pan of a tenth."""
    old = F.greatest(F.lit(LEAST_SPAN), span)
    new = clamp(old * F.when(delta > 0, ZOOM_IN).otherwise(ZOOM_OUT), F.lit(LEAST_SPAN), duration)
    at = clamp(anchor, F.lit(0.0), F.lit(1.0))
    zoomed = F.struct(clamp_start(start + old * at - new * at, new, duration).alias("start"), new.alias("span"))
    panned = F.struct(clamp_start(start - delta * (span / 10.0), span, duration).alias("start"), span.alias("span"))
    same = F.struct(start.alias("start"), span.alias("span"))
    return F.when((duration <= 0) | (F.abs(delta) < 0.01), same).when(zooming, zoomed).otherwise(panned)


def slot_frames(width: float, start: Column, end: Column, fps: Column, total: Column) -> Column:
    """The frames at the middles of the slots (one for each 100 pixels, 1 to 300) of a time line."""
    slots = min(300, max(1, int(width // 100)))
    wide = width / slots
    span = F.greatest(F.lit(0.0001), end - start)
    t = lambda k: clamp((k * wide + wide * 0.5) / max(1.0, width), F.lit(0.0), F.lit(1.0))
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: clamp(F.floor((start + span * t(k)) * fps), F.lit(0), F.greatest(F.lit(0), total - 1)))


def grid_seconds(start: Column, end: Column, lines: int = 12) -> Column:
    """The multiples of a nice step from ``start`` to one step after ``end``."""
    step = nice_step(F.greatest(F.lit(0.0001), end - start) / lines)
    return F.transform(F.sequence(F.ceil(start / step), F.floor(end / step) + 1), lambda k: k * step)


def eta_text(ms: Column) -> Column:
    """Hours, minutes and seconds that are left, larger units only if needed."""
    s = F.floor(F.greatest(F.lit(0), ms) / 1000)
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s / 60), F.pmod(s, F.lit(60))
    long = F.concat(hours.cast("string"), F.lit(f"{HOURS} "), F.pmod(minutes, F.lit(60)).cast("string"), F.lit(f"{MINUTES} "), seconds.cast("string"), F.lit(SECONDS))
    middle = F.concat(minutes.cast("string"), F.lit(f"{MINUTES} "), seconds.cast("string"), F.lit(SECONDS))
    return F.when(ms.isNull(), None).when(s >= 3600, long).when(s >= 60, middle).otherwise(F.concat(seconds.cast("string"), F.lit(SECONDS)))


def age_text(ms: Column) -> Column:
    s = F.floor(F.greatest(F.lit(0), ms) / 1000)
    tail = F.concat(F.pmod(s, F.lit(60)).cast("string"), F.lit(SECONDS))
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit(f"{MINUTES} "), tail)).otherwise(tail)


def status_text(frame: Column, total: Column, age_ms: Column) -> Column:
    """The last frame done of all, and how long ago."""
    place = F.when((frame >= 0) & (total > 0), F.concat((frame + 1).cast("string"), F.lit("/"), total.cast("string"))).otherwise(NO_INFORMATION)
    return F.concat(F.lit(LAST_DONE), place, F.lit(UPDATED), age_text(age_ms), F.lit(AGO))


def position_text(frame: Column, total: Column) -> Column:
    return F.when((total <= 0) | (frame < 0), "- / -").otherwise(F.concat((frame + 1).cast("string"), F.lit(" / "), total.cast("string")))


def opened_text(at: Column) -> Column:
    return F.concat(F.lit("Last opened: "), F.date_format(at, "yyyy-MM-dd HH:mm"))


def percent(frame: Column, total: Column, detecting: bool) -> Column:
    """Percent done, half to even, 100 at most; detection counts from the first frame to the last."""
    whole = F.greatest(F.lit(1), total - 1) if detecting else F.greatest(F.lit(1), total)
    return F.least(F.lit(100), F.rint(frame * 100.0 / whole).cast("int"))


def threshold(value: Column) -> Column:
    return clamp(value, F.lit(0.01), F.lit(0.99)).cast("float")


def radius_setting(value: Column) -> Column:
    return clamp(value, F.lit(6), F.lit(40))


def detect_every(every: Column, tracking: Column) -> Column:
    return F.when(tracking, F.greatest(F.lit(1), every)).otherwise(1)


def thread_choices(cores: Column) -> Column:
    """Numbers of threads to choose from: the offered ones that fit, and all cores."""
    most = F.greatest(F.lit(1), cores)
    return F.array_union(F.filter(F.array(*map(F.lit, THREAD_CHOICES)), lambda c: c <= most), F.array(most))


def library_name(name: Column) -> Column:
    """Without ``lib`` before it, ``.dylib`` after it and what follows a dot."""
    bare = F.regexp_replace(F.regexp_replace(name, "^(?i)lib", ""), r"(?i)\.dylib$", "")
    return F.regexp_replace(bare, r"^([^.]+)\..*$", "$1")
