"""Masks as pixel tables (mask, x, y), one row for each pixel set, and numpy kernels where neighbourhoods matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stack import met, stacked


def boxes(pixels: DataFrame) -> DataFrame:
    """Tight half-open box and area of each mask."""
    return pixels.groupBy("mask").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count(F.lit(1)).alias("area"))


def padded_boxes(found: DataFrame, width: int, height: int, ratio: float = 0.02) -> DataFrame:
    from ..functions.geometry import padded

    return found.withColumn("box", padded(F.array("x1", "y1", "x2", "y2"), F.lit(width), F.lit(height), ratio))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that only one of two tables has, counted for each mask; 0 for equal masks."""
    side = stacked(["mask", "x", "y"], a.withColumn("s", F.lit(1)), b.withColumn("s", F.lit(-1))).groupBy("mask", "x", "y").agg(F.sum("s").alias("s"))
    return side.groupBy("mask").agg(F.count_if(F.col("s") != 0).alias("mismatched"))


def union(parts: DataFrame, whole: str = "whole") -> DataFrame:
    """Pixels of any part, under the id of the whole."""
    return parts.select(F.col(whole).alias("mask"), "x", "y").distinct()


def coverage(pixels: DataFrame, boxed: DataFrame, width: int, height: int) -> DataFrame:
    """Share of each box (mask, bx1, by1, bx2, by2 with fractions) that the mask sets, over the pixels it touches within the canvas; 0 for a box outside it."""
    a, b = (F.greatest(F.lit(0), F.floor(c).cast("int")) for c in ("bx1", "by1"))
    c, d = F.least(F.lit(width), F.ceil("bx2").cast("int")), F.least(F.lit(height), F.ceil("by2").cast("int"))
    inside = (F.col("x") >= a) & (F.col("x") < c) & (F.col("y") >= b) & (F.col("y") < d)
    area = F.greatest(c - a, F.lit(0)) * F.greatest(d - b, F.lit(0))
    joined = boxed.join(met(pixels), "mask", "left").withColumns({"inside": inside, "area": area})
    share = F.when(F.first("area") > 0, F.count_if("inside") / F.first("area")).otherwise(0.0)
    return joined.groupBy("mask", "bx1", "by1", "bx2", "by2").agg(share.alias("coverage"))


def split_scan(pixels: DataFrame, low: float = 0.15, high: float = 0.85, least: float = 0.12, balance: float = 0.18) -> DataFrame:
    """The best straight cut of each mask in two: axis (0 for x), place, score; masks without one are left out.

    Along x and y every line is tried from the whole part of 15 percent of the span to before that of 85 percent, empty
    ones too, where the span has four lines at least; neither side may have less than 12 percent of the area. The score
    is the pixels on the line over the most on any line of that axis, plus 0.18 times the imbalance; the first of the
    least wins, x before y. What lies before the line is one part, the line and what follows the other.
    """
    lines = pixels.select("mask", F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("place")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("place")))).alias("l"))
    counts = lines.groupBy("mask", "l.axis", "l.place").agg(F.count(F.lit(1)).alias("n"))
    steps = counts.select("mask", "axis", F.explode(F.array(F.struct("place", "n"), F.struct((F.col("place") + 1).alias("place"), (-F.col("n")).alias("n")))).alias("s"))
    return best_cut(steps.select("mask", "axis", "s.place", F.col("s.n").alias("step")), low, high, least, balance)


def best_cut(steps: DataFrame, low: float = 0.15, high: float = 0.85, least: float = 0.12, balance: float = 0.18) -> DataFrame:
    """split_scan from (mask, axis, place, step): by how much the number of set pixels on a line is more than on the line before.

    All of it is windows over the lines of one mask and axis, empty ones too, which are no more than the canvas has.
    """
    axis = Window.partitionBy("mask", "axis")
    by_place = axis.orderBy("place")
    changes = steps.groupBy("mask", "axis", "place").agg(F.sum("step").alias("step"))
    spans = changes.select("mask", "axis", "place", F.lead("place").over(by_place).alias("until"), F.sum("step").over(by_place).alias("n")).filter("until is not null")
    lines = spans.select("mask", "axis", F.explode(F.sequence("place", F.col("until") - 1)).alias("place"), "n")
    before = F.coalesce(F.sum("n").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first, span = F.min("place").over(axis), F.max("place").over(axis) - F.min("place").over(axis) + 1
    tried = lines.select("mask", "axis", "place", "n", before.alias("left"), (F.col("place") - first).alias("o"), span.alias("span"), F.max("n").over(axis).alias("most"), F.sum("n").over(axis).alias("area"))
    begin = F.greatest(F.lit(1), F.floor(F.col("span") * low).cast("int"))
    stop = F.least(F.col("span") - 1, F.floor(F.col("span") * high).cast("int"))
    fair = F.least(F.col("left"), F.col("area") - F.col("left")) >= F.col("area") * least
    score = F.col("n") / F.greatest(F.lit(1.0), F.col("most").cast("double")) + balance * (F.abs(2 * F.col("left") - F.col("area")) / F.col("area"))
    kept = tried.filter((F.col("span") >= 4) & (F.col("o") >= begin) & (F.col("o") < stop) & fair)
    return kept.groupBy("mask").agg(F.min(F.struct(score.alias("score"), "axis", "place")).alias("s")).select("mask", "s.axis", "s.place", "s.score")


def in_order(regions: DataFrame) -> DataFrame:
    """Regions (mask, region, x, y) numbered anew from 1 in order of mean x, then mean y; a mask has few."""
    means = regions.groupBy("mask", "region").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    ranked = means.select("mask", "region", F.row_number().over(Window.partitionBy("mask").orderBy("mx", "my", "region")).alias("nth"))
    return regions.join(met(ranked), ["mask", "region"]).select("mask", F.col("nth").alias("region"), "x", "y")


def split_parts(pixels: DataFrame) -> DataFrame:
    """(mask, region, x, y): the two parts of each mask at its best cut, in order of their means."""
    cut = split_scan(pixels).select("mask", "axis", "place")
    side = F.when(F.when(F.col("axis") == 0, F.col("x")).otherwise(F.col("y")) < F.col("place"), 1).otherwise(2)
    return in_order(pixels.join(met(cut), "mask").select("mask", side.alias("region"), "x", "y"))


def whole_parts(parts: DataFrame, union: DataFrame, least: int = 16) -> DataFrame:
    """Regions (mask, region, x, y) where every one has `least` pixels; the masks of others are split at their best cut instead."""
    small = parts.groupBy("mask", "region").agg(F.count(F.lit(1)).alias("n")).groupBy("mask").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter((F.col("n") < least) | (F.col("parts") < 2)).select("mask")
    return parts.join(met(small), "mask", "left_anti").unionByName(split_parts(union.join(met(small), "mask", "left_semi")))


def difference_free(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """Masks whose parts overlap or don't make up the whole, with the pixels in question."""
    own = parts.groupBy("mask", "x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("whole", F.lit(0))
    n = stacked(["mask", "x", "y"], own, whole.select("mask", "x", "y", F.lit(0).cast("long").alias("n"), F.lit(1).alias("whole")))
    wrong = n.groupBy("mask", "x", "y").agg(F.sum("n").alias("n"), F.sum("whole").alias("w")).filter("n <> 1 or w <> 1")
    return wrong.groupBy("mask").agg(F.count(F.lit(1)).alias("pixels"))


# --- kernels on one mask ------------------------------------------------------------------------------------------


def disc(radius: int) -> np.ndarray:
    """Offsets of a round kernel: each row of it reaches as far to both sides as the circle does there, rounded half to even."""
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    reach = np.rint(radius * np.sqrt((radius * radius - y * y) * (1.0 / max(1, radius * radius))))
    return np.abs(x) <= reach


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """A mask, or each of a stack, widened by a disc."""
    out = np.zeros_like(mask)
    h, w = mask.shape[-2:]
    for dy, dx in np.argwhere(disc(radius)) - radius:
        out[..., max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] |= mask[..., max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def label_components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected components, 0 outside, numbered by their first pixel in reading order: runs of each row, joined by the runs they touch in the row before."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    up = np.arange(len(row))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    of_row = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, n, j, m = of_row[y - 1], of_row[y], of_row[y], of_row[y + 1]
        while i < n and j < m:
            if start[i] <= stop[j] and start[j] <= stop[i]:  # they touch, at a corner too
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    names = np.array([root(i) for i in range(len(row))], int)
    number = np.searchsorted(np.unique(names), names) + 1
    out = np.zeros((h, w), int)
    out[mask] = np.repeat(number, stop - start)
    return out


def squared_distance(outside: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distance of each pixel to the nearest one of `outside`: along columns first, then the lower envelope of parabolas along each row."""
    h, w = outside.shape
    far = h + w
    column = np.full((h, w), far, float)
    last = np.full(w, -far, float)
    for y in range(h):
        last = np.where(outside[y], y, last)
        column[y] = y - last
    last = np.full(w, h - 1 + far, float)
    for y in range(h - 1, -1, -1):
        last = np.where(outside[y], y, last)
        column[y] = np.minimum(column[y], last - y)
    # the lowest of parabolas (x - place)^2 + g(place), all rows at a time: which places are lowest somewhere, and from where
    g = column**2
    if w <= 128:  # few places: all of a row are tried at once
        apart = (np.arange(w)[:, None] - np.arange(w)) ** 2
        return np.stack([(apart + row).min(axis=1) for row in g])
    rows = np.arange(h)
    top, place, begin = np.zeros(h, int), np.zeros((h, w), int), np.full((h, w + 1), np.inf)
    begin[:, 0] = -np.inf
    for x in range(1, w):
        open_ = rows
        cross = np.empty(h)
        while len(open_):
            p = place[open_, top[open_]]
            cross[open_] = (g[open_, x] + x * x - g[open_, p] - p * p) / (2.0 * (x - p))
            open_ = open_[cross[open_] <= begin[open_, top[open_]]]
            top[open_] -= 1
        top += 1
        place[rows, top], begin[rows, top], begin[rows, top + 1] = x, cross, np.inf
    out = np.empty((h, w))
    at = np.zeros(h, int)
    for x in range(w):
        while (late := begin[rows, at + 1] < x).any():
            at[late] += 1
        p = place[rows, at]
        out[:, x] = (x - p) ** 2 + g[rows, p]
    return out


def innermost(mask: np.ndarray) -> tuple[int, int]:
    """(x, y) of the pixel farthest from the outside by exact Euclidean distance, the first in reading order; all around the canvas is outside."""
    inside = np.where(mask, squared_distance(~np.pad(mask, 1))[1:-1, 1:-1], -1)
    y, x = np.unravel_index(int(inside.argmax()), mask.shape)
    return int(x), int(y)


def significant(area: int, pixels: int) -> bool:
    """Whether a component counts: 16 pixels, or 0.005 percent of the canvas where that is more."""
    return area >= max(16, int(np.ceil(5e-5 * pixels)))


def significant_components(mask: np.ndarray) -> list[np.ndarray]:
    """The components that count, in bands of about 15 percent of the height, then by mean x and mean y."""
    label = label_components(mask)
    found = []
    for k in range(1, label.max() + 1):
        own = label == k
        if significant(int(own.sum()), mask.size):
            ys, xs = np.nonzero(own)
            found.append((round(ys.mean() / max(1, mask.shape[0] * 0.15)), xs.mean(), ys.mean(), own))
    return [f[3] for f in sorted(found, key=lambda f: f[:3])]


def regions_of(mask: np.ndarray, several: bool) -> list[np.ndarray]:
    """A mask's regions in order: itself, or where several objects are meant its two components that count, with every other pixel at the nearer one.

    One component stays whole, since nothing tells where its objects part; another number of them is an error.
    """
    if not several:
        return [mask]
    parts = significant_components(mask)
    if len(parts) == 1:
        return [mask]
    if len(parts) != 2:
        raise ValueError(f"{len(parts)} components, one or two are expected")
    parts.sort(key=lambda p: (np.nonzero(p)[1].mean(), np.nonzero(p)[0].mean()))
    left = mask & ~(parts[0] | parts[1])
    first = squared_distance(parts[0]) <= squared_distance(parts[1])
    return [parts[0] | left & first, parts[1] | left & ~first]


def raster(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels whose centre lies in a polygon, by crossings of each pixel row, and those its outline passes."""
    y, x = np.mgrid[:height, :width]
    inside, outline = np.zeros((height, width), bool), np.zeros((height, width), bool)
    a, b = points, np.roll(points, -1, axis=0)
    for (x1, y1), (x2, y2) in zip(a, b, strict=True):
        if y1 != y2:
            crosses = (y1 > y) != (y2 > y)
            inside ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        n = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
        px, py = np.rint(np.linspace(x1, x2, n + 1)).astype(int), np.rint(np.linspace(y1, y2, n + 1)).astype(int)
        ok = (px >= 0) & (px < width) & (py >= 0) & (py < height)
        outline[py[ok], px[ok]] = True
    return inside | outline


#: Pixels of the canvases that a kernel works on at a time; canvases from which distances go by envelopes, one mask at a time.
CELLS, WIDE = 1 << 22, 1 << 14
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _words(pixels: DataFrame, width: int, height: int, plane: Column | int = 0) -> DataFrame:
    """(mask, word, bits): a mask's pixels, repeats allowed, 64 at a time as the bits of a number; planes of one mask lie one after the other. A pixel beyond the canvas is an error."""
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    at = F.when(inside, F.col("y").cast("long") * width + F.col("x")).otherwise(F.raise_error(F.lit("a pixel beyond the canvas")).cast("long"))
    word = F.shiftright(at, 6) + (F.lit(plane) if isinstance(plane, int) else plane) * -(-width * height // 64)
    placed = pixels.select("mask", word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    return placed.groupBy("mask", "word").agg(F.bit_or("bit").alias("bits"))


def _over_stacks(gathered: DataFrame, width: int, height: int, planes: int, fn: Callable[[np.ndarray, pa.RecordBatch], tuple], schema: str) -> DataFrame:
    """fn over rows (mask, words and others), of which it gets booleans (masks, planes, height, width) and the rows themselves."""
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    each = -(-width * height // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // (width * height * planes))
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                listed = part.column("words")
                word, bits = (c.to_numpy() for c in listed.flatten().flatten())
                cells = np.zeros((part.num_rows, planes * each), np.int64)
                cells[np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy())), word] = bits
                bit = np.unpackbits(cells.reshape(-1, each).view(np.uint8), axis=1, count=width * height, bitorder="little")
                found, *columns = fn(bit.reshape(-1, planes, height, width).astype(bool), part)
                yield pa.RecordBatch.from_arrays([part.column("mask").take(pa.array(found)), *[pa.array(c).cast(KINDS[t]) for c, t in zip(columns, kinds, strict=True)]], names=["mask", *names])

    return gathered.mapInArrow(run, f"mask {gathered.schema['mask'].dataType.simpleString()}, {schema}")


def _gathered(words: DataFrame) -> DataFrame:
    return words.groupBy("mask").agg(F.collect_list(F.struct("word", "bits")).alias("words"))


def per_stack(pixels: DataFrame, width: int, height: int, fn: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """Apply a kernel to masks by the stack: it gets booleans (masks, height, width) and gives the place in the stack of each row of its result, then the result's columns."""
    return _over_stacks(_gathered(_words(pixels, width, height)), width, height, 1, lambda stack, _: fn(stack[:, 0]), schema)


def stack_runs(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of a stack in reading order: mask, y, x1, x2, and the first run of their 8-connected component.

    Runs that touch pass the least name on to each other and to the run they are named after, until nothing changes.
    """
    _, h, w = stack.shape
    edge = np.diff(np.pad(stack, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
    mask, y, x1 = np.nonzero(edge == 1)
    x2 = np.nonzero(edge == -1)[2]
    row = (mask * (h + 1) + y + 1) * (w + 2)  # a row apart from the mask before
    low = np.searchsorted(row + x2, row - (w + 2) + x1)
    n = np.maximum(np.searchsorted(row + x1, row - (w + 2) + x2, side="right") - low, 0)
    b = np.repeat(np.arange(len(mask)), n)
    a = np.arange(len(b)) + np.repeat(low - np.cumsum(n) + n, n)
    name = np.arange(len(mask))
    while (apart := np.flatnonzero(name[a] != name[b])).size:
        a, b = a[apart], b[apart]
        least = np.minimum(name[a], name[b])
        for end in (a, b):
            np.minimum.at(name, name[end], least)
        while not np.array_equal(up := name[name], name):
            name = up
    return mask, y, x1, x2, name


def stack_components(stack: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, tuple[np.ndarray, ...]]:
    """The runs of a stack, the component of each, and the components: mask, area, mean x, mean y and whether they count."""
    runs = stack_runs(stack)
    mask, y, x1, x2, name = runs
    first, of = np.unique(name, return_inverse=True)
    n = x2 - x1
    area = np.bincount(of, n, len(first)).astype(np.int64)
    cx, cy = (np.bincount(of, n * v, len(first)) / area for v in ((x1 + x2 - 1) / 2, y))
    return runs, of, (mask[first], area, cx, cy, area >= max(16, int(np.ceil(5e-5 * stack[0].size))))


def nth_of(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 within equal values, which lie together."""
    return np.arange(len(mask)) - np.searchsorted(mask, mask) + 1


def stack_regions(stack: np.ndarray, several: bool, strict: bool) -> np.ndarray:
    """regions_of for a stack: the number of each pixel's region, 0 outside and, unless strict, in masks of another number of components than one or two."""
    if not several:
        return stack.astype(np.int8)
    (mask, y, x1, x2, _), of, (own, _, cx, cy, counts) = stack_components(stack)
    number = np.bincount(own[counts], minlength=len(stack))
    if strict and len(wrong := number[(number != 1) & (number != 2)]):
        raise ValueError(f"{wrong[0]} components, one or two are expected")
    order = np.lexsort((cy, cx, own))
    order = order[counts[order] & (number[own[order]] == 2)]
    region = np.zeros(len(own), np.int8)
    region[order] = nth_of(own[order])
    region = np.where(number[mask] == 1, 1, region[of])
    n = x2 - x1
    out = np.zeros(stack.shape, np.int8)
    out[stack] = np.repeat(region, n)
    two = number[mask] == 2
    loose, held = np.flatnonzero(two & (region == 0)), np.flatnonzero(two & (region > 0))
    pm, py = np.repeat(mask[loose], n[loose]), np.repeat(y[loose], n[loose])
    px = np.arange(len(pm)) + np.repeat(x1[loose] - np.cumsum(n[loose]) + n[loose], n[loose])
    begin = np.searchsorted(mask[held], pm)
    size = np.searchsorted(mask[held], pm, side="right") - begin
    total, at = np.cumsum(size), 0
    while at < len(pm):  # stray pixels against their mask's runs, in blocks of bounded size
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CELLS, side="right")))
        m, start = size[at:to], np.cumsum(size[at:to]) - size[at:to]
        r = held[np.arange(m.sum()) + np.repeat(begin[at:to] - start, m)]
        x = np.repeat(px[at:to], m)
        far = (y[r] - np.repeat(py[at:to], m)) ** 2 + np.maximum(np.maximum(x1[r] - x, x - x2[r] + 1), 0) ** 2
        first, second = (np.minimum.reduceat(np.where(region[r] == k, far, 1 << 60), start) for k in (1, 2))
        out[pm[at:to], py[at:to], px[at:to]] = np.where(first <= second, 1, 2)
        at = to
    return out


def stack_innermost(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """innermost for a stack: x and y. Distances go along columns, then along rows, as far to both sides as any is still above the square of the step."""
    n, h, w = stack.shape
    if h * w > WIDE:
        x, y = zip(*map(innermost, stack), strict=True)
        return np.array(x), np.array(y)
    most = (h + w + 4) ** 2
    far = np.where(np.pad(stack, ((0, 0), (1, 1), (1, 1))), most, 0).astype(np.int16 if 2 * most < 1 << 15 else np.int32)
    for axis in (1, 2):
        given, far = np.moveaxis(far, axis, 0), far.copy()
        out, k = np.moveaxis(far, axis, 0), 1
        while k < len(given) and k * k < out.max():
            np.minimum(out[k:], given[:-k] + k * k, out=out[k:])
            np.minimum(out[:-k], given[k:] + k * k, out=out[:-k])
            k += 1
    at = np.where(stack, far[:, 1:-1, 1:-1], -1).reshape(n, -1).argmax(axis=1)
    return at % w, at // w


def stack_cut(stack: np.ndarray, low: float = 0.15, high: float = 0.85, least: float = 0.12, balance: float = 0.18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """split_scan for a stack: axis (-1 where there is no cut), place and score."""
    axis, place, score = np.full(len(stack), -1), np.zeros(len(stack), int), np.full(len(stack), np.inf)
    for a, n in enumerate((stack.sum(axis=1), stack.sum(axis=2))):
        there = n > 0
        first = there.argmax(axis=1)[:, None]
        span = np.where(there.any(axis=1), n.shape[1] - there[:, ::-1].argmax(axis=1), 0)[:, None] - first
        area, left, o = n.sum(axis=1)[:, None], np.cumsum(n, axis=1) - n, np.arange(n.shape[1]) - first
        kept = (span >= 4) & (o >= np.maximum(1, np.floor(span * low))) & (o < np.minimum(span - 1, np.floor(span * high))) & (np.minimum(left, area - left) >= area * least)
        of = np.where(kept, n / np.maximum(1.0, n.max(axis=1))[:, None] + balance * (np.abs(2 * left - area) / np.maximum(area, 1)), np.inf)
        best = of.argmin(axis=1)
        value = of[np.arange(len(stack)), best]
        better = value < score
        axis[better], place[better], score[better] = a, best[better], value[better]
    return axis, place, score


def stack_halves(stack: np.ndarray) -> np.ndarray:
    """split_parts for a stack: each pixel's part, 1 or 2 in order of their means; 0 outside and in masks without a cut."""
    _, h, w = stack.shape
    axis, place, _ = (v[:, None, None] for v in stack_cut(stack))
    part = np.where(stack & (axis >= 0), np.where(np.where(axis == 0, np.arange(w), np.arange(h)[:, None]) < place, 1, 2), 0).astype(np.int8)
    (x1, y1), (x2, y2) = ([own.sum(axis=a) @ np.arange(size) / np.maximum(1, own.sum(axis=(1, 2))) for a, size in ((1, w), (2, h))] for own in (part == 1, part == 2))
    late = (x1 > x2) | (x1 == x2) & (y1 > y2)
    part[late] = np.where(part[late] > 0, 3 - part[late], 0)
    return part


def stack_partition(union: np.ndarray, instances: np.ndarray, boxes: np.ndarray, least: int = 16) -> np.ndarray:
    """joins.partition and whole_parts for a stack: each pixel's region, 0 outside. instances (masks, regions, height, width); boxes (masks, regions, 4), NaN for none."""
    _, h, w = union.shape
    alone, own = instances.sum(axis=1, dtype=np.int8) == 1, instances.argmax(axis=1) + 1
    nearest, far = np.zeros(union.shape, np.int8), np.full(union.shape, np.inf)
    for r in range(boxes.shape[1]):
        x1, y1, x2, y2 = (boxes[:, r, i, None, None] for i in range(4))
        away = ((np.arange(w) - (x1 + x2) / 2) / np.maximum(1.0, x2 - x1)) ** 2 + ((np.arange(h)[:, None] - (y1 + y2) / 2) / np.maximum(1.0, y2 - y1)) ** 2
        nearest[away < far], far = r + 1, np.fmin(far, away)
    region = np.where(union & (nearest > 0), np.where(alone, own, nearest), 0).astype(np.int8)
    sizes = np.stack([(region == r + 1).sum(axis=(1, 2)) for r in range(boxes.shape[1])], axis=1)
    there = sizes > 0
    small = there.any(axis=1) & ((there.sum(axis=1) < 2) | (there & (sizes < least)).any(axis=1))
    region[small] = stack_halves(union[small])
    return region


def value_runs(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of equal values other than 0 along the rows of a stack: mask, value, y, x1, x2."""
    seen = np.pad(values, ((0, 0), (0, 0), (1, 1)))
    before, after = seen[:, :, :-1], seen[:, :, 1:]
    begin, end = (before != after) & (after != 0), (before != after) & (before != 0)
    mask, y, x1 = np.nonzero(begin)
    return mask, after[begin], y, x1, np.nonzero(end)[2]


def stack_squared_up(stack: np.ndarray, reach: int) -> np.ndarray:
    for axis in (1, 2):
        given, stack = np.moveaxis(stack, axis, 0), stack.copy()
        out = np.moveaxis(stack, axis, 0)
        for k in range(1, min(reach, len(given) - 1) + 1):
            out[k:] |= given[:-k]
            out[:-k] |= given[k:]
    return stack


def components(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(mask, component, area, cx, cy) of the 8-connected components that count, numbered from 1 in bands of rows, then by mean x and mean y."""

    def fn(stack: np.ndarray) -> tuple:
        _, _, (mask, area, cx, cy, counts) = stack_components(stack)
        order = np.lexsort((cy, cx, np.rint(cy / max(1, height * 0.15)), mask))
        order = order[counts[order]]
        return mask[order], nth_of(mask[order]), area[order], cx[order], cy[order]

    return per_stack(pixels, width, height, fn, "component long, area long, cx double, cy double")


def splits(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """split_scan of masks on one canvas, whose lines are counted in the stack."""

    def fn(stack: np.ndarray) -> tuple:
        axis, place, score = stack_cut(stack)
        found = np.flatnonzero(axis >= 0)
        return found, axis[found], place[found], score[found]

    return per_stack(pixels, width, height, fn, "axis int, place int, score double")


def partitioned(union: DataFrame, instances: DataFrame, boxes: DataFrame, width: int, height: int, regions: int = 2, least: int = 16) -> DataFrame:
    """(mask, region, y, x1, x2): joins.partition of masks on one canvas, then whole_parts, in one pass over all pixels of a mask; regions of instances and boxes are numbered from 1.

    Pixels meet as words of 64; boxes (mask, region, x1, y1, x2, y2) come beside them.
    """
    known = lambda r: F.when(r.between(1, regions), r).otherwise(F.raise_error(F.lit("no such region")).cast("int"))
    words = stacked(["mask"], _words(union, width, height), _words(instances, width, height, known(F.col("region"))))
    listed = boxes.groupBy("mask").agg(F.collect_list(F.struct(known(F.col("region")).cast("int").alias("region"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("boxes"))

    def fn(stack: np.ndarray, rows: pa.RecordBatch) -> tuple:
        given = rows.column("boxes")
        region, *corners = (c.to_numpy() for c in given.flatten().flatten())
        own = np.full((len(stack), regions, 4), np.nan)
        own[np.repeat(np.arange(len(stack)), np.diff(given.offsets.to_numpy())), region - 1] = np.stack(corners, axis=1)
        return value_runs(stack_partition(stack[:, 0], stack[:, 1:], own, least))

    return _over_stacks(_gathered(words).join(met(listed), "mask"), width, height, regions + 1, fn, "region int, y int, x1 int, x2 int")


def _pixel_rows(stack: np.ndarray) -> tuple:
    mask, y, x = np.nonzero(stack)
    return mask, x, y


def regions(pixels: DataFrame, width: int, height: int, several: bool = True, strict: bool = True) -> DataFrame:
    """(mask, region, x, y): regions of masks, numbered from 1. A mask of another number of objects than one or two is an error, or is left out unless strict."""

    def fn(stack: np.ndarray) -> tuple:
        of = stack_regions(stack, several, strict)
        mask, x, y = _pixel_rows(of)
        return mask, of[mask, y, x], x, y

    return per_stack(pixels, width, height, fn, "region int, x int, y int")


def region_shapes(pixels: DataFrame, width: int, height: int, several: bool = True, strict: bool = True) -> DataFrame:
    """(mask, region, x1, y1, x2, y2, area, px, py): tight half-open box, area and innermost point of each region, in one pass."""

    def fn(stack: np.ndarray) -> tuple:
        of = stack_regions(stack, several, strict)
        each = np.stack([of == 1, of == 2], axis=1).reshape(-1, height, width)
        of_each = np.flatnonzero(each.any(axis=(1, 2)))
        each = each[of_each]
        boxes = []
        for size, axis in ((width, 1), (height, 2)):
            line = each.any(axis=axis)
            boxes += [line.argmax(axis=1), size - line[:, ::-1].argmax(axis=1)]
        return of_each // 2, of_each % 2 + 1, boxes[0], boxes[2], boxes[1], boxes[3], each.sum(axis=(1, 2)), *(stack_innermost(each) if len(each) else (of_each, of_each))

    return per_stack(pixels, width, height, fn, "region int, x1 int, y1 int, x2 int, y2 int, area long, px int, py int")


def evaluation_masks(parts: DataFrame, width: int, height: int, ratio: float = 0.02) -> DataFrame:
    """Pixels (mask, x, y) where a case's result is judged: the union of its regions, widened."""
    return dilated(parts.select("mask", "x", "y"), width, height, ratio)


def edges(pixels: DataFrame, width: int, height: int, reach: int = 1) -> DataFrame:
    """Pixels (mask, x, y) at a mask's edge: where the greatest value within `reach` to all sides is above the least one."""
    # beyond the canvas nothing is seen: its own edge makes no edge
    return per_stack(pixels, width, height, lambda m: _pixel_rows(stack_squared_up(m, reach) & stack_squared_up(~m, reach)), "x int, y int")


def dilated(pixels: DataFrame, width: int, height: int, ratio: float = 0.02) -> DataFrame:
    """Pixels of each mask widened by a disc of a share of the canvas's short side, one pixel at least."""
    radius = max(1, round(min(width, height) * ratio))
    return per_stack(pixels, width, height, lambda m: _pixel_rows(dilate(m, radius)), "x int, y int")


def innermost_points(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(mask, x, y): the innermost pixel of each mask."""
    return per_stack(pixels, width, height, lambda m: (np.arange(len(m)), *stack_innermost(m)), "x int, y int")
