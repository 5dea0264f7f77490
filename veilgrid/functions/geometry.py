"""Rectangles, radii and time texts as column expressions.

Rounding is half to even (``rint``); confidences are compared as float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value: float) -> Column:
    return F.lit(value).cast("float")


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x, y, w, h; 0 without overlap."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0)
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def floored_area(r: Column) -> Column:
    return F.greatest(F.lit(1.0), r["w"] * r["h"])


def centre_distance(a: Column, b: Column) -> Column:
    dx = (a["x"] + a["w"] / 2) - (b["x"] + b["w"] / 2)
    dy = (a["y"] + a["h"] / 2) - (b["y"] + b["h"] / 2)
    return F.sqrt(dx * dx + dy * dy)


def padded(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> dict[str, Column]:
    """The rectangle grown by 15 % (6 at least) sideways and 25 % (6 at least) up and down, within the frame."""
    pad_x, pad_y = F.greatest(F.lit(6.0), w * 0.15), F.greatest(F.lit(6.0), h * 0.25)
    left, top = F.greatest(F.lit(0.0), x - pad_x), F.greatest(F.lit(0.0), y - pad_y)
    right, bottom = F.least(F.lit(float(width)), x + w + pad_x), F.least(F.lit(float(height)), y + h + pad_y)
    return {"px": left, "py": top, "pw": right - left, "ph": bottom - top}


def blur_radius(w: Column, h: Column, width: int, height: int, base: int) -> Column:
    """Smaller faces get smaller radii, by steps of their share of the frame."""
    if base <= 1:
        return F.lit(max(1, base))
    share = w * h * 100.0 / (width * height)
    scale = F.when(share <= 1, 0.4).when(share <= 3, 0.55).when(share <= 5, 0.7).otherwise(1.0)
    return clamp(F.rint(base * scale).cast("int"), F.lit(1), F.lit(base))


def frame_time_text(frame: Column, fps: Column) -> Column:
    """MM:SS.FF; a remainder that rounds up to the frame rate carries into the seconds."""
    whole = F.floor(frame / fps)
    part = F.rint(frame - whole * fps).cast("int")
    full = F.rint(fps).cast("int")
    carry = part >= full
    seconds = F.when(carry, whole + 1).otherwise(whole).cast("int")
    text = F.format_string("%02d:%02d.%02d", F.floor(seconds / 60).cast("int"), F.pmod(seconds, F.lit(60)), F.when(carry, 0).otherwise(part))
    return F.when(fps <= 0, "00:00.00").otherwise(text)


def clock_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    short = F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))
    long = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.pmod(F.floor(s / 60).cast("int"), F.lit(60)), F.pmod(s, F.lit(60)))
    return F.when(s >= 3600, long).otherwise(short)


def nice_step(raw: Column) -> Column:
    """The next of 1, 2, 5, 10 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(raw, F.lit(1e-9)))))
    n = raw / power
    return F.when(n <= 1, power).when(n <= 2, 2 * power).when(n <= 5, 5 * power).otherwise(10 * power)


def luma(b: Column, g: Column, r: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def skin(b: Column, g: Column, r: Column) -> Column:
    cb = 128 + F.shiftright(-43 * r - 85 * g + 128 * b, 8)
    cr = 128 + F.shiftright(128 * r - 107 * g - 21 * b, 8)
    return cb.between(77, 127) & cr.between(133, 173)


def blend(new: Column, old: Column, alpha: Column) -> Column:
    """Integer alpha blend with rounding; alpha 0 keeps, 255 replaces."""
    return F.when(alpha == 0, old).when(alpha == 255, new).otherwise(F.floor((new * alpha + old * (255 - alpha) + 127) / 255).cast("int"))
