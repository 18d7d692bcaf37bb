"""Boxes are half-open [x1, y1, x2, y2); points lie inside the canvas. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SIDE_STEP, TARGET_AREA


def corner(box: Column, i: int) -> Column:
    return F.element_at(box, i)


def box_valid(box: Column, width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = (corner(box, i) for i in (1, 2, 3, 4))
    return (F.size(box) == 4) & (x1 >= 0) & (x1 < x2) & (x2 <= width) & (y1 >= 0) & (y1 < y2) & (y2 <= height)


def point_inside(point: Column, width: Column, height: Column) -> Column:
    return (F.size(point) == 2) & (corner(point, 1) >= 0) & (corner(point, 1) < width) & (corner(point, 2) >= 0) & (corner(point, 2) < height)


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), (corner(box, 3) - corner(box, 1)).cast("double")) * F.greatest(F.lit(0.0), (corner(box, 4) - corner(box, 2)).cast("double"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; the union is at least 1e-9."""
    wide = F.least(corner(a, 3), corner(b, 3)) - F.greatest(corner(a, 1), corner(b, 1))
    high = F.least(corner(a, 4), corner(b, 4)) - F.greatest(corner(a, 2), corner(b, 2))
    both = F.greatest(F.lit(0.0), wide.cast("double")) * F.greatest(F.lit(0.0), high.cast("double"))
    return both / F.greatest(F.lit(1e-9), area(a) + area(b) - both)


def output_side(own: Column, other: Column, target: int = TARGET_AREA, step: int = SIDE_STEP) -> Column:
    """The side of an output of about `target` pixels with the input's aspect, a multiple of `step`."""
    return F.greatest(F.lit(step), (F.bround(F.sqrt(target * own / other) / step, 0) * step).cast("int"))


def view_scale(width: Column, height: Column, most: int) -> Column:
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (width * height)))


def view_side(side: Column, scale: Column) -> Column:
    """A side of a picture scaled down, one pixel at least."""
    return F.when(scale < 1, F.greatest(F.lit(1), F.bround(side * scale, 0).cast("int"))).otherwise(side)


def marker(short_side: Column, share: float, least: int) -> Column:
    return F.greatest(F.lit(least), F.bround(short_side * share, 0).cast("int"))


#: Share of the short side and least size of a locator's line, of its dot's radius and of the dot's outline.
MARKERS = {"line_width": (0.006, 3), "point_radius": (0.018, 10), "point_outline": (0.005, 3)}


def padded(box: Column, width: Column, height: Column, ratio: float = 0.02) -> Column:
    """The box widened by a share of the canvas's short side, one pixel at least, within the canvas."""
    pad = F.greatest(F.lit(1), F.bround(F.least(width, height) * ratio, 0).cast("int"))
    return F.array(F.greatest(F.lit(0), corner(box, 1) - pad), F.greatest(F.lit(0), corner(box, 2) - pad), F.least(width, corner(box, 3) + pad), F.least(height, corner(box, 4) + pad))


def unwrapped(nested: Column) -> Column:
    """The flat list of a polygon that comes as a list of one list."""
    return F.when(F.size(nested) == 1, F.element_at(nested, 1)).otherwise(F.raise_error(F.lit("not a polygon")).cast("array<double>"))


def polygon_points(flat: Column) -> Column:
    """Pairs of a flat list of at least three points; another length is an error."""
    good = (F.size(flat) >= 6) & (F.size(flat) % 2 == 0)
    pairs = F.transform(F.sequence(F.lit(1), F.size(flat) - 1, F.lit(2)), lambda i: F.struct(F.element_at(flat, i).alias("x"), F.element_at(flat, i + 1).alias("y")))
    return F.when(good, pairs).otherwise(F.raise_error(F.lit("not a polygon")).cast("array<struct<x:double,y:double>>"))


def centroid(points: Column, part: str) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[part]) / F.size(points)


def is_small(region_area: Column, width: Column, height: Column) -> Column:
    return region_area / (width * height) < 0.02


def contiguous(indices: Column) -> Column:
    """Whether indices go up, or down, by one each. Only what is there is looked at: their span may be a whole table's."""
    n = F.size(indices)
    first, last = F.element_at(indices, 1), F.element_at(indices, -1)
    step = F.when(first <= last, 1).otherwise(-1)
    return (F.abs(last - first) + 1 == n) & F.forall(F.sequence(F.lit(1), n), lambda i: F.element_at(indices, i) == first + step * (i - 1))
