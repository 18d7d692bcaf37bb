"""Polygons to runs of pixels, in the JVM: a row of the canvas is filled between pairs of its crossings with the edges.

The rule: points are cut to whole pixels. A row y crosses an edge whose ends lie on different rows from the upper one on
to before the lower one; crossings are sorted and paired, and what lies between the two of a pair, both rounded to
pixels inwards, is set. The outline is set as well: of steep edges the pixel nearest to the edge in each row, of others the one
nearest in each column, halves up. The canvas cuts off what lies beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_points, unwrapped
from . import runs as run


def points(nested: Column) -> Column:
    """Points of a polygon given as a list of one flat list; the wrapped list must have three points at least."""
    return polygon_points(unwrapped(nested))


def edges(polygons: DataFrame) -> DataFrame:
    """(mask, width, height, edge, x0, y0, x1, y1) of polygons (mask, points, width, height): each point with the next, the last with the first, from top to bottom."""
    n = F.size("points")
    whole = F.transform("points", lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("whole", i).alias("a"), F.element_at("whole", i % n + 1).alias("b")))
    rows = polygons.withColumn("whole", whole).select("mask", "width", "height", F.posexplode(pairs).alias("edge", "e"))
    down = F.struct("e.a.y", "e.a.x") <= F.struct("e.b.y", "e.b.x")
    upper, lower = F.when(down, F.col("e.a")).otherwise(F.col("e.b")), F.when(down, F.col("e.b")).otherwise(F.col("e.a"))
    return rows.select("mask", "width", "height", "edge", upper["x"].alias("x0"), upper["y"].alias("y0"), lower["x"].alias("x1"), lower["y"].alias("y1"))


def _within(start: Column, stop: Column, most: Column) -> Column:
    """Whole numbers from start to before stop that lie on the canvas; null where there are none."""
    a, b = F.greatest(start, F.lit(0)), F.least(stop, most.cast("long")) - 1
    return F.when(a <= b, F.sequence(a, b))


def spans(sides: DataFrame) -> DataFrame:
    """(mask, y, x1, x2): runs between paired crossings. A row has no more crossings than its polygon has edges."""
    rows = sides.filter("y0 < y1").select("mask", "width", "x0", "y0", "x1", "y1", F.explode(_within(F.col("y0"), F.col("y1"), F.col("height"))).alias("y"))
    at = rows.select("mask", "width", "y", (F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    listed = at.groupBy("mask", "width", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda i: F.struct(F.element_at("xs", i).alias("a"), F.element_at("xs", i + 1).alias("b"))))
    cut = listed.select("mask", "width", "y", pair.alias("p"))
    return cut.select("mask", "y", F.greatest(F.lit(0), F.floor(F.col("p.a") + 0.5)).alias("x1"), F.least(F.col("width").cast("long"), F.ceil(F.col("p.b") - 0.5) + 1).alias("x2"))


def outlines(sides: DataFrame) -> DataFrame:
    """(mask, y, x1, x2): the pixels of the edges, each a run."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    nearest = lambda a, at, t0, d, n: F.col(a) + F.floor((at - F.col(t0)) * d / n + 0.5)
    steep = sides.filter(dy >= F.abs(dx)).select("*", F.explode(_within(F.col("y0"), F.col("y1") + 1, F.col("height"))).alias("y"))
    tall = steep.select("mask", "width", "y", F.when(dy == 0, F.col("x0")).otherwise(nearest("x0", F.col("y"), "y0", dx, dy)).cast("long").alias("x"))
    flat = sides.filter(dy < F.abs(dx)).select("*", F.explode(_within(F.least("x0", "x1"), F.greatest("x0", "x1") + 1, F.col("width"))).alias("x"))
    wide = flat.select("mask", "width", "height", nearest("y0", F.col("x"), "x0", dy, dx).cast("long").alias("y"), "x").filter("y >= 0 and y < height")
    both = tall.unionByName(wide.select("mask", "width", "y", "x")).filter("x >= 0 and x < width")
    return both.select("mask", "y", F.col("x").alias("x1"), (F.col("x") + 1).alias("x2"))


def rasterised(polygons: DataFrame) -> DataFrame:
    """Runs (mask, y, x1, x2) of polygons (mask, points, width, height); a polygon beyond its canvas has none.

    Rows of edges are made, never pixels of the inside.
    """
    sides = edges(polygons)
    found = run.merged(spans(sides).unionByName(outlines(sides)))
    return found.select("mask", *[F.col(c).cast("int").alias(c) for c in ("y", "x1", "x2")])


def require_all(polygons: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs, where every polygon has some: an empty mask is an error."""
    empty = polygons.select("mask").join(runs.select("mask").distinct(), "mask", "left_anti")
    if (first := empty.first()) is not None:
        raise ValueError(f"empty mask: {first['mask']}")
    return runs
