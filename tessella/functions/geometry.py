"""Sizes, angles and fits as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest side of a flattened image, the wrap's range and default in radians, the camera's distance in bottle radii.
MAX_SIDE = 1600
MIN_WRAP, DEFAULT_WRAP, MAX_WRAP = math.pi / 3, math.radians(140), math.pi
CAMERA_RATIO = 4.5


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def apply_homography(h: Column, x: Column, y: Column) -> Column:
    den = F.get(h, 6) * x + F.get(h, 7) * y + 1
    return F.struct(((F.get(h, 0) * x + F.get(h, 1) * y + F.get(h, 2)) / den).alias("x"), ((F.get(h, 3) * x + F.get(h, 4) * y + F.get(h, 5)) / den).alias("y"))


def ordered_quad(points: Column) -> Column:
    """Four points clockwise from the one nearest the top left."""
    cx, cy = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["x"]) / 4, F.aggregate(points, F.lit(0.0), lambda a, p: a + p["y"]) / 4
    turned = F.transform(F.sort_array(F.transform(points, lambda p, i: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("a"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
    sums = F.transform(turned, lambda p: p["x"] + p["y"])
    start = F.array_position(sums, F.array_min(sums)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(turned, ((start + i) % 4).cast("int")))


def output_size(quad: Column, max_side: int = MAX_SIDE) -> Column:
    """(width, height): the longer of each two opposite edges, scaled down to max_side."""
    p = [F.get(quad, i) for i in range(4)]
    w, h = F.greatest(distance(p[0], p[1]), distance(p[3], p[2])), F.greatest(distance(p[0], p[3]), distance(p[1], p[2]))
    k = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(w, h, F.lit(1e-300)))
    side = lambda x: F.greatest(F.lit(1), half_up(x * k)).cast("int")
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def _outward(p: Column, a: Column, b: Column, side: int) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = F.hypot(dx, dy)
    cross = ((p["x"] - a["x"]) * dy - (p["y"] - a["y"]) * dx) / n
    return F.when(n < 1e-9, F.lit(0.0)).otherwise(cross if side < 0 else -cross)


def wrap_angle(points: Column, ratio: float = CAMERA_RATIO) -> Column:
    """How far the label goes round the bottle, from six handles (TL, TM, TR, BR, BM, BL): the edges' signed bulge over the label's height."""
    tl, tm, tr, br, bm, bl = (F.get(points, i) for i in range(6))
    chord, height = (distance(tl, tr) + distance(bl, br)) / 2, (distance(tl, bl) + distance(tr, br)) / 2
    cos = 1 - (_outward(tm, tl, tr, -1) + _outward(bm, bl, br, 1)) / height * (ratio - 1)
    angle = F.greatest(F.lit(MIN_WRAP), F.least(F.lit(MAX_WRAP), 2 * F.acos(cos)))
    return F.when((chord < 1e-6) | (height < 1e-6), F.lit(DEFAULT_WRAP)).when(cos >= 1, F.lit(MIN_WRAP)).when(cos <= -1, F.lit(MAX_WRAP)).otherwise(angle)


def detector_size(width: Column, height: Column, limit: int = 960) -> Column:
    """Both sides as multiples of 32, the longer at most `limit`."""
    k = F.least(F.lit(1.0), limit / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(32), half_up(v * k / 32) * 32).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def recogniser_width(w: Column, h: Column, height: int = 48, least: int = 16, most: int = 1280) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), half_up(w / F.greatest(F.lit(1), h) * height))).cast("int")


def square_size(width: Column, height: Column, size: int = 1024) -> Column:
    k = size / F.greatest(width, height)
    side = lambda v: F.greatest(F.lit(1), half_up(v * k)).cast("int")
    return F.struct(k.alias("scale"), side(width).alias("width"), side(height).alias("height"), F.lit(size).alias("size"))


def box_prompt(points: Column, scale: Column, size: int = 1024) -> Column:
    """Left, top, right, bottom and the centre of the points' box, in the square's pixels."""
    axis = lambda f: F.transform(points, lambda p: F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), p[f] * scale)))
    left, right, top, bottom = F.array_min(axis("x")), F.array_max(axis("x")), F.array_min(axis("y")), F.array_max(axis("y"))
    return F.array(left, top, right, bottom, (left + right) / 2, (top + bottom) / 2)


def unclipped(w: Column, h: Column, ratio: float = 1.5) -> Column:
    """A box with every side moved out by area * ratio / perimeter."""
    d = F.when(w + h > 0, w * h * ratio / (2 * (w + h))).otherwise(F.lit(0.0))
    return F.struct((w + 2 * d).alias("w"), (h + 2 * d).alias("h"))


def best_of(scores: Column) -> Column:
    """The place of the greatest score, the first of equals, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
