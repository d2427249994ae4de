"""Sizes and boxes as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTUM, MAX_WIDTH, MIN_WIDTH, LINE_HEIGHT = 96, 2560, 16, 48
DET_STEP, DET_LIMIT = 32, 960
LETTERBOX = 384
PASTE = 50


def quantize_width(w: Column, most: int = MAX_WIDTH) -> Column:
    """The width rounded up to a multiple of QUANTUM, and at most `most`."""
    return F.least(F.floor((w + (QUANTUM - 1)) / QUANTUM).cast("int") * QUANTUM, F.lit(most))


def effective_width(w: Column, h: Column, base_ratio: float = 320 / 48, least: int = MIN_WIDTH, most: int = MAX_WIDTH) -> Column:
    """Quantized width of a line scaled to LINE_HEIGHT, no narrower than the base ratio."""
    ratio = F.greatest(F.lit(base_ratio), w / h)
    return quantize_width(F.greatest(F.least((LINE_HEIGHT * ratio).cast("int"), F.lit(most)), F.lit(least)), most)


def resized_width(w: Column, h: Column, target: Column, least: int = MIN_WIDTH) -> Column:
    """Width of a line's content inside a target width, the rest being padding."""
    content = F.greatest(F.ceil(LINE_HEIGHT * (w / h)).cast("int"), F.lit(least))
    return F.greatest(F.lit(1), F.least(target, content))


def line_width(w: Column, h: Column) -> Column:
    """Target width of one line by itself."""
    ratio = F.greatest(w / h, F.lit(0.1))
    return F.least(F.greatest(LINE_HEIGHT * ratio, F.lit(float(MIN_WIDTH))), F.lit(float(MAX_WIDTH))).cast("int")


def _det_side(side: Column, longest: Column, limit: int) -> Column:
    shrunk = F.when(longest > limit, (side * (F.lit(limit) / longest)).cast("int")).otherwise(side)
    return F.greatest((F.rint(shrunk / DET_STEP) * DET_STEP).cast("int"), F.lit(DET_STEP))


def det_size(h: Column, w: Column, limit: int = DET_LIMIT) -> Column:
    """Detection size: the longer side limited, both rounded (half to even) to multiples of 32."""
    longest = F.greatest(h, w)
    return F.struct(_det_side(h, longest, limit).alias("h"), _det_side(w, longest, limit).alias("w"))


def shape_list(h: Column, w: Column, size: Column) -> Column:
    """The original size and the scale of each side."""
    return F.array(h.cast("double"), w.cast("double"), size["h"] / h, size["w"] / w)


def fit_profile(h: Column, w: Column, max_h: int = 736, max_w: int = 960) -> Column:
    """A size brought inside the detector's profile: scaled down, in steps of 32, 32 at least."""
    scale = F.least(F.lit(max_h) / h, F.lit(max_w) / w, F.lit(1.0))

    def side(x: Column, most: int) -> Column:
        return F.least(F.greatest((F.rint(x * scale / DET_STEP) * DET_STEP).cast("int"), F.lit(DET_STEP)), F.lit(most // DET_STEP * DET_STEP))

    return F.struct(side(h, max_h).alias("h"), side(w, max_w).alias("w"))


def in_profile(h: Column, w: Column) -> Column:
    """Whether the fast detection engine takes an input of this size."""
    return h.between(96, 736) & w.between(128, 960)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def box_height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def box_area(b: Column) -> Column:
    return box_width(b) * box_height(b)


def box_quad(b: Column) -> Column:
    """Corners clockwise from the upper left."""
    point = lambda x, y: F.struct(b[x].cast("double").alias("x"), b[y].cast("double").alias("y"))
    return F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"))


def clamp_box(b: Column, width: Column | int, height: Column | int) -> Column:
    """Integer box inside the page, null if nothing is left of it."""
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), most))
    new = box(inside(b["x0"], width), inside(b["y0"], height), inside(b["x1"], width), inside(b["y1"], height))
    return F.when((new["x1"] > new["x0"]) & (new["y1"] > new["y0"]), new)


def scale_box(b: Column, scale: float) -> Column:
    return box(*((b[k] / scale).cast("int") for k in ("x0", "y0", "x1", "y1")))


def padded_crop(b: Column, paste: int = PASTE) -> Column:
    """Geometry of a crop with a margin: where it is pasted, the box it is from, its new size."""
    return F.struct(
        F.lit(paste).alias("paste_x"), F.lit(paste).alias("paste_y"), b["x0"].alias("xmin"), b["y0"].alias("ymin"), b["x1"].alias("xmax"), b["y1"].alias("ymax"),
        (box_width(b) + 2 * paste).alias("new_width"), (box_height(b) + 2 * paste).alias("new_height"),
    )


def to_page(quad: Column, crop: Column) -> Column:
    """Points of a crop moved to its page."""
    return F.transform(quad, lambda p: F.struct((p["x"] - crop["paste_x"] + crop["xmin"]).alias("x"), (p["y"] - crop["paste_y"] + crop["ymin"]).alias("y")))


def derotate(quad: Column) -> Column:
    """The upright rectangle about a slanted quad's centre, as wide as its upper left to lower right."""
    p1, p2, p3, p4 = (quad[k] for k in range(4))
    cx, cy = ((p1[k] + p2[k] + p3[k] + p4[k]) / 4 for k in ("x", "y"))
    h, w = ((p4["y"] - p1["y"]) + (p3["y"] - p2["y"])) / 2, p3["x"] - p1["x"]
    corner = lambda a, b: F.struct((cx + a * w / 2).alias("x"), (cy + b * h / 2).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def line_crop_size(quad: Column) -> Column:
    """Size of a text line's crop: the longer of opposite sides, or the rectangle of an upright quad;
    null if a side is below one pixel."""
    p = [quad[k] for k in range(4)]
    side = lambda a, b: F.hypot(p[a]["x"] - p[b]["x"], p[a]["y"] - p[b]["y"])
    xs, ys = F.transform(quad, lambda q: q["x"]), F.transform(quad, lambda q: q["y"])
    upright = (F.size(F.array_distinct(xs)) == 2) & (F.size(F.array_distinct(ys)) == 2)
    extent = lambda v: F.array_max(v).cast("int") - F.array_min(v).cast("int")
    w = F.when(upright, extent(xs)).otherwise(F.greatest(side(0, 1), side(2, 3)).cast("int"))
    h = F.when(upright, extent(ys)).otherwise(F.greatest(side(0, 3), side(1, 2)).cast("int"))
    return F.when((w >= 1) & (h >= 1), F.struct(w.alias("w"), h.alias("h")))


def needs_rotation(w: Column, h: Column, ratio: float = 1.5) -> Column:
    return h / w >= ratio


def letterbox(h: Column, w: Column, side: int = LETTERBOX) -> Column:
    """Size and upper left corner of an image fitted into a square."""
    ratio = F.least(F.lit(side) / h, F.lit(side) / w)
    new_h, new_w = (F.floor(v * ratio + 0.5).cast("int") for v in (h, w))
    return F.struct(new_h.alias("new_h"), new_w.alias("new_w"), F.floor((side - new_h) / 2).cast("int").alias("pad_top"), F.floor((side - new_w) / 2).cast("int").alias("pad_left"))


def luma(c0: Column, c1: Column, c2: Column) -> Column:
    return c0 * 0.114 + c1 * 0.587 + c2 * 0.299


def contains_pixel(b: Column, x: Column, y: Column) -> Column:
    """Half-open containment."""
    return (b["x0"] <= x) & (x < b["x1"]) & (b["y0"] <= y) & (y < b["y1"])


def batch_size(ratio: Column, base: int, most: Column | int | None = None) -> Column:
    """The base times the memory ratio, limited by `most` and 1 at least."""
    wanted = ratio * base
    return F.greatest(F.lit(1), wanted if most is None else F.least(F.lit(most) if isinstance(most, int) else most, wanted))


def rounded(x: Column, places: int) -> Column:
    """A double's exact binary value rounded to decimal places, ties to even, as printing it with that
    many places does: 0.295, which is a little less than that, gives 0.29. The product's own rounding
    error decides where the product looks like a tie, so all stays inside generated code."""
    factor = F.lit(float(10**places))
    product, spread = x * factor, x * F.lit(134217729.0)
    high = spread - (spread - x)
    error = (high * factor - product) + (x - high) * factor
    whole = F.rint(product)
    gap = product - whole
    moved = F.when((gap == 0.5) & (error > 0), whole + 1).when((gap == -0.5) & (error < 0), whole - 1).otherwise(whole)
    # larger ones have no such places; infinite ones and those that aren't numbers stay
    return F.when(F.abs(x) < 1e12, moved / factor).otherwise(x)


def finite_score(text: Column, score: Column) -> Column:
    """Recognised text and score; a score that isn't a number is 0."""
    return F.struct(text.alias("text"), F.nanvl(score, F.lit(0.0)).alias("score"))


def pad_right(values: Column, size: Column, pad: Column) -> Column:
    """The array lengthened to `size` with `pad`; one that is long enough stays."""
    return F.concat(values, F.array_repeat(pad, F.greatest(size - F.size(values), F.lit(0)).cast("int")))


def last_flattened(values: Column) -> Column:
    """Lists of lists of numbers as one list, and its last element."""
    flat = F.flatten(values)
    return F.struct(flat.alias("flat"), F.get(flat, F.size(flat) - 1).alias("last"))


def select_tokens(next_tokens: Column, unfinished: Column, pad: int) -> Column:
    """The next token of rows that go on, `pad` for finished ones."""
    return next_tokens * unfinished + F.lit(pad) * (1 - unfinished)


def pages_per_second(pages: Column, ms: Column) -> Column:
    return F.when(ms > 0, pages / (ms / 1000)).otherwise(F.lit(0.0))
