"""Pixel operators on tables of one row a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions.geometry import blend, blur_radius, clamp, luma, padded, skin

INNER = 0.65 * 0.65
FRAME = ("video_id", "frame_index")


def frame_keys(df: DataFrame) -> list[str]:
    """The columns that tell one picture from another; a table without them is one picture."""
    return [c for c in FRAME if c in df.columns]


def _box_rows(faces: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """A row for each pixel of [x0, x1) x [y0, y1), from sequences, not from a join with all pixels."""
    boxed = faces.select("*", x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1")).where("x0 < x1 and y0 < y1")
    lined = boxed.select("*", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("py"))
    return lined.select("*", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("px"))


def mask_raster(faces: DataFrame, width: int, height: int) -> DataFrame:
    """Soft ellipses of all faces, the largest alpha where they overlap."""
    x, y, w, h = (F.col(c) for c in "xywh")
    pad_x, pad_y = F.greatest(F.lit(6.0), w * 0.15), F.greatest(F.lit(6.0), h * 0.25)
    low = lambda v, most: clamp(F.floor(v), F.lit(0), F.lit(max(0, most - 1)))
    high = lambda v, most: clamp(F.ceil(v), F.lit(0), F.lit(most))
    px = _box_rows(faces, low(x - pad_x, width), low(y - pad_y, height), high(x + w + pad_x, width), high(y + h + pad_y, height))
    dx, dy = F.col("px") - (F.col("x0") + F.col("x1") - 1) / 2.0, F.col("py") - (F.col("y0") + F.col("y1") - 1) / 2.0
    rx, ry = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) / 2.0), F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) / 2.0)
    d = px.withColumn("d2", dx * dx / (rx * rx) + dy * dy / (ry * ry)).where("d2 <= 1.0")
    t = (F.col("d2") - INNER) / (1.0 - INNER)
    alpha = F.when(F.col("d2") <= INNER, 255).otherwise(F.rint((1.0 - t * t * (3.0 - 2.0 * t)) * 255.0).cast("int"))
    return d.groupBy(*frame_keys(faces), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.max(alpha).alias("alpha")).where("alpha > 0")


def mask_bounds(mask: DataFrame) -> DataFrame:
    lit = mask.where("alpha > 0")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return lit.groupBy(*frame_keys(mask)).agg(zero(F.min("x")).alias("x0"), zero(F.min("y")).alias("y0"), zero(F.max("x") + 1).alias("x1"), zero(F.max("y") + 1).alias("y1"))


def radius_map(faces: DataFrame, width: int, height: int, base: int) -> DataFrame:
    p = padded(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height)
    sized = faces.withColumn("radius", blur_radius(F.col("w"), F.col("h"), width, height, base))
    px = _box_rows(sized, F.floor(p["px"]), F.floor(p["py"]), F.ceil(p["px"] + p["pw"]), F.ceil(p["py"] + p["ph"]))
    return px.groupBy(*frame_keys(faces), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.max("radius").alias("radius"))


def box_mean(pixels: DataFrame, radius: int, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """Integer mean over a square window cropped at the edges: sums of row sums, as a summed-area table gives."""
    keys = frame_keys(pixels)
    across = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)
    rows = pixels.select(*keys, "x", "y", *(F.sum(c).over(across).alias(c) for c in channels), F.count("*").over(across).alias("n"))
    return rows.select(*keys, "x", "y", *(F.floor(F.sum(c).over(down) / F.sum("n").over(down)).cast("int").alias(c) for c in channels))


def box_separable(pixels: DataFrame, radius: int, width: int, height: int, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """Integer mean across, then down, edges repeated outward."""
    keys = frame_keys(pixels)

    def one(df: DataFrame, axis: str, other: str, size: int) -> DataFrame:
        lead = F.when(F.col(axis) == 0, F.sequence(F.lit(-radius), F.lit(0))).when(F.col(axis) == size - 1, F.sequence(F.lit(size - 1), F.lit(size - 1 + radius)))
        grown = df.withColumn(axis, F.explode(F.coalesce(lead, F.array(axis))))
        w = Window.partitionBy(*keys, other).orderBy(axis).rangeBetween(-radius, radius)
        return grown.select(*keys, "x", "y", *(F.floor(F.sum(c).over(w) / (2 * radius + 1)).cast("int").alias(c) for c in channels)).where(F.col(axis).between(0, size - 1))

    return one(one(pixels, "x", "y", width), "y", "x", height)


def masked_blend(pixels: DataFrame, blurred: DataFrame, mask: DataFrame, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    keys = frame_keys(pixels)
    new = blurred.select(*keys, "x", "y", *(F.col(c).alias(f"new_{c}") for c in channels))
    all_three = pixels.join(new, [*keys, "x", "y"]).join(mask, [*keys, "x", "y"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(0)))
    return all_three.select(*keys, "x", "y", *(blend(F.col(f"new_{c}"), F.col(c), F.col("alpha")).alias(c) for c in channels))


def region_stats(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Counts, skin and edge shares and luma variance of the inclusive box, on a grid of its own step."""
    step = min(4, max(1, int((((x1 - x0 + 1) * (y1 - y0 + 1)) / 20) ** 0.5)))
    keys = frame_keys(pixels)
    b, g, r = (F.col(c) for c in "bgr")
    grid = pixels.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & ((F.col("x") - x0) % step == 0) & ((F.col("y") - y0) % step == 0))
    points = grid.select(*keys, "x", "y", luma(b, g, r).alias("luma"), skin(b, g, r).cast("int").alias("skin"))
    right, below = F.lead("luma").over(Window.partitionBy(*keys, "y").orderBy("x")), F.lead("luma").over(Window.partitionBy(*keys, "x").orderBy("y"))
    edges = points.withColumn("right", right).withColumn("below", below)
    edge = lambda c: (F.abs(F.col("luma") - F.col(c)) > 20).cast("int")
    sums = edges.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.sum("skin").alias("skin"), F.var_samp("luma").alias("variance"),
        (F.coalesce(F.sum(edge("right")), F.lit(0)) + F.coalesce(F.sum(edge("below")), F.lit(0))).alias("edges"),
        (F.count("right") + F.count("below")).alias("edge_samples"),
    )
    passed = (F.col("samples") >= 20) & (F.col("skin") / F.col("samples") >= 0.015) & (F.col("edges") / F.greatest(F.lit(1), "edge_samples") >= 0.02) & (F.col("variance") >= 200)
    return sums.select(*keys, "samples", "skin", "edges", "edge_samples", F.round("variance", 6).alias("variance"), F.coalesce(passed, F.lit(False)).alias("passed"))


#: Steps between sampled points at most, samples at least, and the shares and variance that a face needs.
MOST_STEP, LEAST_SAMPLES, LEAST_SKIN, LEAST_EDGES, LEAST_VARIANCE = 4, 20, 0.015, 0.02, 200.0


def face_stats(pixels: DataFrame, faces: DataFrame, width: int, height: int) -> DataFrame:
    """Samples, skin and edge shares and luma variance of each face (``face keys, passed``), on a grid of the face's own step.

    The box is cut to whole pixels of the frame; a box of a pixel's width or height fails. ``pixels``
    without frame columns are one picture that all frames show. Only sampled points are joined.
    """
    keys = [*frame_keys(faces), "face_idx"]
    low = lambda v, most: clamp(F.floor(v), F.lit(0), F.lit(max(0, most - 1))).cast("int")
    x, y, w, h = (F.col(c) for c in "xywh")
    boxes = faces.select(*keys, low(x, width).alias("x0"), low(y, height).alias("y0"), low(F.ceil(x + w) - 1, width).alias("x1"), low(F.ceil(y + h) - 1, height).alias("y1"))
    area = ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).cast("double")
    step = F.least(F.lit(MOST_STEP), F.greatest(F.lit(1), F.floor(F.sqrt(area / LEAST_SAMPLES)).cast("int")))
    whole = boxes.where("x1 > x0 and y1 > y0").withColumn("step", step)
    points = whole.withColumn("y", F.explode(F.sequence("y0", "y1", "step"))).withColumn("x", F.explode(F.sequence("x0", "x1", "step")))
    b, g, r = (F.col(c) for c in "bgr")
    shades = pixels.select(*frame_keys(pixels), "x", "y", luma(b, g, r).alias("luma"), skin(b, g, r).cast("int").alias("skin"))
    seen = points.join(shades, [*frame_keys(pixels), "x", "y"]).select(*keys, "x", "y", "luma", "skin")
    right, below = F.lead("luma").over(Window.partitionBy(*keys, "y").orderBy("x")), F.lead("luma").over(Window.partitionBy(*keys, "x").orderBy("y"))
    edge = lambda c: (F.abs(F.col("luma") - F.col(c)) > 20).cast("int")
    sums = seen.withColumn("right", right).withColumn("below", below).groupBy(*keys).agg(
        F.count("*").alias("samples"), F.sum("skin").alias("skin"), F.var_samp("luma").alias("variance"),
        (F.coalesce(F.sum(edge("right")), F.lit(0)) + F.coalesce(F.sum(edge("below")), F.lit(0))).alias("edges"),
        (F.count("right") + F.count("below")).alias("edge_samples"),
    )
    enough = (F.col("samples") >= LEAST_SAMPLES) & (F.col("skin") / F.col("samples") >= LEAST_SKIN) & (F.col("edges") / F.greatest(F.lit(1), "edge_samples") >= LEAST_EDGES) & (F.col("variance") >= LEAST_VARIANCE)
    told = sums.select(*keys, "samples", "skin", "edges", F.round("variance", 6).alias("variance"), F.coalesce(enough, F.lit(False)).alias("passed"))
    return boxes.select(*keys).join(told, keys, "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def downscale_nearest(pixels: DataFrame, ratio: float, width: int, height: int) -> DataFrame:
    """Each target pixel takes the source pixel at the truncated position."""
    wide, high = target_size(width, height, ratio)
    at = pixels.sparkSession.range(wide * high).select((F.col("id") % wide).cast("int").alias("tx"), F.floor(F.col("id") / wide).cast("int").alias("ty"))
    source = at.select("tx", "ty", F.least((F.col("tx") * (1 / ratio)).cast("int"), F.lit(width - 1)).alias("x"), F.least((F.col("ty") * (1 / ratio)).cast("int"), F.lit(height - 1)).alias("y"))
    return source.join(pixels, ["x", "y"]).select(*frame_keys(pixels), F.col("tx").alias("x"), F.col("ty").alias("y"), "b", "g", "r")


def target_size(width: int, height: int, ratio: float) -> tuple[int, int]:
    """Sides rounded half to even, one pixel at least; ratios that do not shrink leave the size."""
    return (max(1, round(width * ratio)), max(1, round(height * ratio))) if 0 < ratio < 1 else (width, height)


def downscale_bilinear(pixels: DataFrame, ratio: float, width: int, height: int, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """Each target pixel mixes the four source pixels around its position (counted from the corner), as shares of 255.

    A target pixel names its four corners, which are joined and summed with their weights.
    """
    wide, high = target_size(width, height, ratio)
    at = pixels.sparkSession.range(wide * high).select((F.col("id") % wide).cast("int").alias("tx"), F.floor(F.col("id") / wide).cast("int").alias("ty"))

    def ends(c: str, most: int) -> tuple[Column, Column]:
        """Positions and weights of the two neighbours along one side."""
        place = F.col(c) * (1 / ratio)
        low = F.least(F.floor(place).cast("int"), F.lit(most - 1))
        part = place - low
        near, far = F.struct(low.alias("at"), (1.0 - part).alias("w")), F.struct(F.least(low + 1, F.lit(most - 1)).alias("at"), part.alias("w"))
        return near, far

    corners = at.withColumn("cx", F.explode(F.array(*ends("tx", width)))).withColumn("cy", F.explode(F.array(*ends("ty", height))))
    named = corners.select("tx", "ty", F.col("cx.at").alias("x"), F.col("cy.at").alias("y"), (F.col("cx.w") * F.col("cy.w")).alias("weight"))
    keys = frame_keys(pixels)
    mixed = named.join(pixels, ["x", "y"]).groupBy(*keys, "tx", "ty").agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in channels))
    return mixed.select(*keys, F.col("tx").alias("x"), F.col("ty").alias("y"), *((F.col(c) / 255.0).alias(c) for c in channels))


def mask_in_bounds(mask: DataFrame) -> DataFrame:
    """All pixels of each mask's bounding box, with alpha 0 where the mask is empty: the rows among which a mask fades."""
    keys = frame_keys(mask)
    box = mask_bounds(mask).where("x1 > x0 and y1 > y0")
    pixel = box.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1))).withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).select(*keys, "x", "y")
    # Pixels come from exploded boxes, whose number Spark cannot foresee: never broadcast.
    return pixel.join(mask.hint("merge"), [*keys, "x", "y"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(0)))


def faded_masks(mask: DataFrame) -> DataFrame:
    """Masks of a video's frames with what is left of those before: max(alpha, 3/4 of the value before), pixel by pixel.

    Only frames with a mask, and only pixels within its bounds, take a step.
    """
    rows = mask_in_bounds(mask).withColumn("seq", F.col("frame_index")).drop("frame_index")
    return mask_decay(rows).withColumnRenamed("seq", "frame_index")


#: Three quarters of 255, again and again, come to nothing after so many steps.
DECAY_STEPS = 18


def mask_decay(masks: DataFrame) -> DataFrame:
    """``smooth`` = max(alpha, 3/4 of the value before), pixel by pixel in order of ``seq`` (columns ``x, y, seq, alpha``).

    An alpha has no effect after DECAY_STEPS further rows, so a window of that many holds all that counts.
    """
    keys = frame_keys(masks)
    w = Window.partitionBy(*keys, "x", "y").orderBy("seq")
    smooth = F.lit(0)
    for back in range(DECAY_STEPS, -1, -1):
        alpha = F.coalesce(F.lag("alpha", back).over(w), F.lit(0)) if back else F.col("alpha")
        smooth = F.greatest(alpha, F.floor(smooth * 3 / 4).cast("int"))
    return masks.select(*keys, "x", "y", "seq", smooth.alias("smooth"))


def stamps(strokes: DataFrame) -> DataFrame:
    """The strokes from ``cx, cy`` to ``tx, ty`` as one row a stamp, max(1, radius / 2) apart at most; ``cx, cy`` are the stamp's centre.

    Steps are added up one by one and centres rounded half to even, as the reference does.
    """
    dx, dy = F.col("tx") - F.col("cx"), F.col("ty") - F.col("cy")
    far = F.sqrt((dx * dx + dy * dy).cast("double"))
    sized = strokes.withColumn("far", far).withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("far") / F.greatest(F.lit(1.0), F.col("radius") * 0.5)).cast("int")))
    first = F.struct(F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
    step_x, step_y = dx / F.col("steps"), dy / F.col("steps")

    def step(acc: Column, _: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct((last["x"] + step_x).alias("x"), (last["y"] + step_y).alias("y"))))

    along = F.aggregate(F.sequence(F.lit(1), F.col("steps")), F.array(first), step)
    end = F.array(F.struct(F.col("tx").cast("double").alias("x"), F.col("ty").cast("double").alias("y")))
    at = sized.withColumn("at", F.explode(F.when(F.col("far") < 0.001, end).otherwise(along)))
    rounded = at.withColumn("cx", F.rint("at.x").cast("int")).withColumn("cy", F.rint("at.y").cast("int"))
    return rounded.select(*(c for c in strokes.columns if c not in ("tx", "ty")))


def brush(strokes: DataFrame, width: int, height: int) -> DataFrame:
    """Strokes in order of ``seq``; the last writer of a pixel gives its ``value``.

    A stroke goes from ``cx, cy`` to ``tx, ty`` in discs of ``radius``; without ``tx, ty`` it
    is the one disc. Stamps with their centre outside the picture are left out.
    """
    discs = stamps(strokes) if "tx" in strokes.columns else strokes
    inside = discs.where(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1))
    r = F.col("radius")
    px = _box_rows(inside, F.greatest(F.lit(0), F.col("cx") - r), F.greatest(F.lit(0), F.col("cy") - r), F.least(F.lit(width), F.col("cx") + r + 1), F.least(F.lit(height), F.col("cy") + r + 1))
    disc = px.where((F.col("px") - F.col("cx")) * (F.col("px") - F.col("cx")) + (F.col("py") - F.col("cy")) * (F.col("py") - F.col("cy")) <= r * r)
    return disc.groupBy(*frame_keys(strokes), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.max_by("value", "seq").alias("value"))


def masked_export(pixels: DataFrame, faces: DataFrame, width: int, height: int, base: int, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """The pixels that an export changes: faces blurred by the radius of their size, blended by the fading masks.

    ``pixels`` without frame columns are one picture that all frames show. A pixel outside every face's
    padded box, where only an older mask still fades, takes the largest radius. There are four
    radii at most, so the blurred pictures are as many copies of the pixels.
    """
    keys, shared = frame_keys(faces), [*frame_keys(pixels), "x", "y"]
    faded = faded_masks(mask_raster(faces, width, height)).where("smooth > 0")
    sized = faded.join(radius_map(faces, width, height, base).hint("merge"), [*keys, "x", "y"], "left").withColumn("radius", F.coalesce("radius", F.lit(max(1, base))))
    radii = sorted({max(1, round(base * share)) for share in (0.4, 0.55, 0.7, 1.0)})
    blurred = None
    for radius in radii:
        one = box_mean(pixels, radius, channels).select(*shared, F.lit(radius).alias("radius"), *(F.col(c).alias(f"new_{c}") for c in channels))
        blurred = one if blurred is None else blurred.unionByName(one)
    both = sized.join(blurred, [*shared, "radius"]).join(pixels, shared)
    return both.select(*keys, "x", "y", *(blend(F.col(f"new_{c}"), F.col(c), F.col("smooth")).alias(c) for c in channels))
