"""Masks as runs (mask, y, x1, x2): set pixels x1 up to before x2 of a row. A mask of a million pixels is some thousand runs.

All of it is sorting of run ends within a row of one mask, in SQL windows; such a row has no more runs than half its
pixels. Runs of a mask may overlap or touch on input; results are disjoint, apart and as long as can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import masks
from .stack import met, stacked

ROW = ["mask", "y"]


def from_pixels(pixels: DataFrame, *parts: str) -> DataFrame:
    """Runs of a table of pixels (mask, x, y), repeats allowed; parts: further columns that tell a mask's parts apart."""
    row = [*ROW, *parts]
    nth = F.dense_rank().over(Window.partitionBy(*row).orderBy("x"))
    return pixels.select(*row, "x", (F.col("x") - nth).alias("start")).groupBy(*row, "start").agg(F.min("x").alias("x1"), (F.max("x") + 1).alias("x2")).drop("start")


def to_pixels(runs: DataFrame) -> DataFrame:
    """The distinct pixels (mask, x, y); for neighbourhood kernels and small masks."""
    return merged(runs).select("mask", F.explode(F.sequence("x1", F.col("x2") - 1)).alias("x"), "y")


def merged(runs: DataFrame, by_mask: bool = False, *parts: str) -> DataFrame:
    """Runs that overlap or touch made one; empty ones left out. by_mask: they are one table that is dealt by mask already, and stay where they are; parts: as in from_pixels."""
    return _merged(runs if by_mask else stacked([*ROW, *parts], runs), *parts)


def _merged(runs: DataFrame, *parts: str) -> DataFrame:
    """merged, of runs that are dealt by mask, or by mask and row."""
    row = [*ROW, *parts]
    before = Window.partitionBy(*row).orderBy("x1", "x2").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*row).orderBy("x1", "x2").rowsBetween(Window.unboundedPreceding, 0)
    starts = runs.filter("x1 < x2").withColumn("new", (F.col("x1") > F.coalesce(F.max("x2").over(before), F.col("x1") - 1)).cast("int"))
    return starts.withColumn("__nth", F.sum("new").over(upto)).groupBy(*row, "__nth").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("__nth")


def union(parts: DataFrame, whole: str = "whole") -> DataFrame:
    """Runs of any part, under the id of the whole.

    Run ends of all parts are summed by place before they meet, so however many parts a whole has, a row of it comes to
    no more ends than the canvas is wide.
    """
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.lit(step).alias("step")) for x, step in (("x1", 1), ("x2", -1))])).alias("e")
    at = parts.filter("x1 < x2").select(F.col(whole).alias("mask"), "y", ends).groupBy("mask", "y", F.col("e.x").alias("x")).agg(F.sum("e.step").alias("step"))
    row = Window.partitionBy(*ROW).orderBy("x")
    sides = at.withColumn("open", F.sum("step").over(row)).filter((F.col("open") == 0) != (F.col("open") == F.col("step")))
    return sides.select(*ROW, F.col("x").alias("x1"), F.lead("x").over(row).alias("x2"), "open").filter("open > 0").drop("open")


def combined(a: DataFrame, b: DataFrame, keep: Column) -> DataFrame:
    """Runs of the pixels where `keep` holds, a condition on the booleans a and b: whether either table sets a pixel.

    Run ends go by in order of x, with the number of open runs of each table; what lies between two of them is of one kind.
    """
    ends = lambda runs, name: [runs.select(*ROW, F.col(x).alias("x"), *[F.lit(step if n == name else 0).alias(n) for n in ("a", "b")]) for x, step in (("x1", 1), ("x2", -1))]
    events = [*ends(a.filter("x1 < x2"), "a"), *ends(b.filter("x1 < x2"), "b")]
    at = stacked(ROW, *events).groupBy(*ROW, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = Window.partitionBy(*ROW).orderBy("x")
    spans = at.select(*ROW, F.col("x").alias("x1"), F.lead("x").over(row).alias("x2"), *[(F.sum(n).over(row) > 0).alias(n) for n in ("a", "b")])
    return _merged(spans.filter(F.col("x2").isNotNull() & keep).select(*ROW, "x1", "x2"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined(a, b, F.col("a") & F.col("b"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined(a, b, F.col("a") & ~F.col("b"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mask, mismatched): pixels that only one of two tables sets; 0 for equal masks.

    What both tables set together, twice, less what each sets: a run adds what lies beyond the greatest end of those
    before it in order of x1, of either table or of its own. Runs stay what they are, and each table is read once.
    """
    sides = stacked(["mask"], *[t.select(*ROW, "x1", "x2", F.lit(own).alias("own")) for t, own in ((a, True), (b, False))])
    before = Window.partitionBy(*ROW).orderBy("x1").rowsBetween(Window.unboundedPreceding, -1)
    adds = lambda those: F.greatest(F.lit(0), F.col("x2") - F.greatest("x1", F.max(F.when(those, F.col("x2"))).over(before))).cast("long")
    own = F.when(F.col("own"), adds(F.col("own"))).otherwise(adds(~F.col("own")))
    return sides.select("mask", (2 * adds(F.lit(True)) - own).alias("n")).groupBy("mask").agg(F.sum("n").alias("mismatched"))


def boxes(runs: DataFrame) -> DataFrame:
    """Tight half-open box and area of each mask of disjoint runs."""
    area = F.sum(F.col("x2") - F.col("x1")).cast("long").alias("area")
    return runs.groupBy("mask").agg(F.min("x1").alias("x1"), F.min("y").alias("y1"), F.max("x2").alias("x2"), (F.max("y") + 1).alias("y2"), area)


def coverage(runs: DataFrame, boxed: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """Share of each box (mask, bx1, by1, bx2, by2 with fractions, and keys that tell boxes apart) that the mask's disjoint runs set, over the pixels it touches within the canvas; 0 for a box outside it."""
    a, b = (F.greatest(F.lit(0), F.floor(c).cast("int")) for c in ("bx1", "by1"))
    c, d = F.least(F.lit(width), F.ceil("bx2").cast("int")), F.least(F.lit(height), F.ceil("by2").cast("int"))
    area = F.greatest(c - a, F.lit(0)) * F.greatest(d - b, F.lit(0))
    inside = F.when((F.col("y") >= b) & (F.col("y") < d), F.greatest(F.least("x2", c) - F.greatest("x1", a), F.lit(0)))
    joined = boxed.join(met(runs), "mask", "left").withColumns({"inside": inside, "area": area})
    share = F.when(F.first("area") > 0, F.coalesce(F.sum("inside"), F.lit(0)) / F.first("area")).otherwise(0.0)
    return joined.groupBy("mask", "bx1", "by1", "bx2", "by2", *keys).agg(share.alias("coverage"))


def holding(runs: DataFrame, points: DataFrame) -> DataFrame:
    """points (mask, x, y and more) that lie on their mask, each once."""
    row = runs.select(*ROW, "x1", "x2").withColumnRenamed("x1", "from_x").withColumnRenamed("x2", "to_x")
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in ROW] + [F.col("p.x") >= F.col("r.from_x"), F.col("p.x") < F.col("r.to_x")]
    return points.alias("p").join(met(row).alias("r"), same, "left_semi")


def split_parts(runs: DataFrame) -> DataFrame:
    """(mask, region, y, x1, x2): the two parts of each mask of disjoint runs at its best straight cut, in order of their means; masks without one are left out."""
    n = (F.col("x2") - F.col("x1")).cast("long")
    ends = ((0, F.col("x1"), F.lit(1)), (0, F.col("x2"), F.lit(-1)), (1, F.col("y"), n), (1, F.col("y") + 1, -n))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), p.cast("int").alias("place"), s.cast("long").alias("step")) for a, p, s in ends]))
    cut = masks.best_cut(runs.select("mask", steps.alias("s")).select("mask", "s.*")).select("mask", "axis", "place")
    at = runs.join(met(cut), "mask")
    place, across = F.col("place"), F.col("axis") == 0
    left = F.struct(F.lit(1).alias("part"), F.col("x1"), F.when(across, F.least("x2", place)).when(F.col("y") < place, F.col("x2")).otherwise(F.col("x1")).alias("x2"))
    right = F.struct(F.lit(2).alias("part"), F.when(across, F.greatest("x1", place)).when(F.col("y") >= place, F.col("x1")).otherwise(F.col("x2")).alias("x1"), F.col("x2"))
    both = at.select("mask", "y", F.explode(F.array(left, right)).alias("p")).select("mask", "p.part", "y", "p.x1", "p.x2")
    return in_order(both.filter("x1 < x2"), "part")


def in_order(parts: DataFrame, part: str) -> DataFrame:
    """Parts of masks numbered from 1 as `region`, in order of mean x, then mean y; a mask has few."""
    n = F.col("x2") - F.col("x1")
    means = parts.groupBy("mask", part).agg((F.sum(n * (F.col("x1") + F.col("x2") - 1) / 2) / F.sum(n)).alias("mx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("my"))
    nth = F.row_number().over(Window.partitionBy("mask").orderBy("mx", "my", part))
    return parts.join(met(means.select("mask", part, nth.alias("region"))), ["mask", part]).select("mask", "region", "y", "x1", "x2")


def disc_reach(radius: int) -> list[int]:
    """How far a round kernel reaches to both sides in each of its rows, rounded half to even."""
    return [round(radius * ((radius * radius - dy * dy) * (1.0 / max(1, radius * radius))) ** 0.5) for dy in range(-radius, radius + 1)]


def widened(runs: DataFrame, reach: list[int], width: int, height: int, by_mask: bool = False) -> DataFrame:
    """Each run in every row that a symmetric kernel reaches, as much longer to both sides as the kernel is wide there, within the canvas."""
    radius = len(reach) // 2
    rows = F.explode(F.arrays_zip(F.sequence(F.lit(-radius), F.lit(radius)).alias("dy"), F.array(*[F.lit(r) for r in reach]).alias("r")))
    grown = runs.withColumn("k", rows).select("mask", (F.col("y") + F.col("k.dy")).alias("y"), F.greatest(F.lit(0), F.col("x1") - F.col("k.r")).alias("x1"), F.least(F.lit(width), F.col("x2") + F.col("k.r")).alias("x2"))
    return merged(grown.filter((F.col("y") >= 0) & (F.col("y") < height)), by_mask)


def dilated(runs: DataFrame, width: int, height: int, ratio: float = 0.02, by_mask: bool = False) -> DataFrame:
    """Masks widened by a disc of a share of the canvas's short side, one pixel at least. by_mask: as in merged."""
    return widened(runs, disc_reach(max(1, round(min(width, height) * ratio))), width, height, by_mask)


def squared_up(runs: DataFrame, reach: int, width: int, height: int) -> DataFrame:
    """Masks widened by a square: where the greatest value within `reach` to all sides is set."""
    return widened(runs, [reach] * (2 * reach + 1), width, height)


def inverse(runs: DataFrame, masks: DataFrame, width: int, height: int) -> DataFrame:
    """The unset pixels of the canvas; masks: the ids, for those without runs."""
    full = masks.select("mask", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"), F.lit(0).alias("x1"), F.lit(width).alias("x2"))
    return minus(full, runs)


def edges(runs: DataFrame, reach: int, width: int, height: int) -> DataFrame:
    """Runs at a mask's edge: within `reach` of it both to set and to unset pixels; beyond the canvas nothing is seen."""
    near = F.sequence(F.greatest(F.lit(0), F.min("y") - 2 * reach), F.least(F.lit(height - 1), F.max("y") + 2 * reach))  # what lies farther meets no edge
    canvas = runs.groupBy("mask").agg(near.alias("ys")).select("mask", F.explode("ys").alias("y"), F.lit(0).alias("x1"), F.lit(width).alias("x2"))
    outside = minus(canvas, runs)
    return intersection(squared_up(runs, reach, width, height), squared_up(outside, reach, width, height))


def evaluation_masks(parts: DataFrame, width: int, height: int, ratio: float = 0.02) -> DataFrame:
    """Where a case's result is judged: the union of its regions, widened."""
    return dilated(merged(parts.select("mask", "y", "x1", "x2")), width, height, ratio)


def resized(runs: DataFrame, width: Column, height: Column, new_width: Column, new_height: Column, by_mask: bool = False) -> DataFrame:
    """Masks at another size by nearest pixels: an output pixel is set if the one under its centre is.

    Centres (x' + 1/2) w / w' fall into [x1, x2) for x' from the least whole number of at least x1 w' / w - 1/2, so each
    run stays one run; no pixel is made. Sizes may be columns of the runs or literals.
    """
    first = lambda at, old, new: F.ceil((2 * at.cast("long") * new - old) / (2 * old)).cast("long")
    a, b = first(F.col("x1"), width, new_width), first(F.col("x2"), width, new_width)
    top, bottom = first(F.col("y"), height, new_height), first(F.col("y") + 1, height, new_height)
    rows = runs.select("mask", F.when(bottom > top, F.sequence(top, bottom - 1)).alias("rows"), a.alias("x1"), b.alias("x2")).filter("rows is not null and x1 < x2")
    each = rows.select("mask", F.explode("rows").alias("y"), "x1", "x2")
    return merged(each.select("mask", *[F.col(c).cast("int").alias(c) for c in ("y", "x1", "x2")]), by_mask)
