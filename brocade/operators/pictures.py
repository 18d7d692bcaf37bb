"""Pictures and masks between bytes, pixels and runs; locators and outlines.

A picture is a column of the struct that functions/png.py describes. Pixels take a hundred times the room of the bytes
they come from: where a table of pictures is worked on, PNG bytes and regions are what goes between tasks and to Python,
and pixels are only there for some pictures of one size at a time, within a function (marked, mask_png, png_colours).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FILL_OPACITY, HALO, REGION_COLORS, RING
from ..functions import png
from ..functions.geometry import MARKERS
from ..functions.png import PICTURE, array_of, picture_frame, picture_row
from ..functions.resampling import over
from . import runs as run
from .masks import stack_squared_up

RUNS = "array<struct<y:int,x1:int,x2:int>>"


def bands(mask: np.ndarray) -> np.ndarray:
    """(n, 3): y, x1, x2 of the runs of a raster, in reading order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x1 = np.nonzero(edge == 1)
    return np.column_stack([y, x1, np.nonzero(edge == -1)[1]])


def parts_of(listed: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each list of structs begins and the last ends, and the structs' fields; null is an empty list. No object is made for a struct."""
    n = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(n)), [c.to_numpy(zero_copy_only=False) for c in listed.flatten().flatten()]


def lists(rows: list[np.ndarray | None], **kinds: pa.DataType) -> pa.Array:
    """Arrays (n, fields) as lists of structs; None is null."""
    ends = np.append(0, np.cumsum([0 if r is None else len(r) for r in rows]))
    flat = np.concatenate([r for r in rows if r is not None] or [np.zeros((0, len(kinds)), np.int64)])
    fields = pa.StructArray.from_arrays([pa.array(flat[:, i]).cast(t) for i, t in enumerate(kinds.values())], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields, mask=pa.array([r is None for r in rows]))


def picture_array(rows: list[tuple]) -> pa.Array:
    """Rows of PICTURE."""
    kinds = {"width": pa.int32(), "height": pa.int32(), "mode": pa.string(), "pixels": pa.binary(), "error": pa.string()}
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def _fields(shown: pa.Array, *names: str) -> list[list]:
    """Columns of pictures, null where the picture is."""
    return [pc.struct_field(shown, n).to_pylist() for n in names]


def _runs_where(test: Callable[[np.ndarray], np.ndarray]):
    def fn(shown: pa.Array) -> pa.Array:
        found = [None if p is None else bands(test(array_of(w, h, m, p))) for w, h, m, p in zip(*_fields(shown, "width", "height", "mode", "pixels"), strict=True)]
        return lists(found, y=pa.int32(), x1=pa.int32(), x2=pa.int32())

    return fn


def light_runs(picture: Column, least: int = 128) -> Column:
    """Runs of the pixels of a grey picture that have at least that value; null for what is no picture."""
    return F.arrow_udf(_runs_where(lambda p: p[:, :, 0] >= least), RUNS)(picture)


def clear_runs(picture: Column, below: int = 128) -> Column:
    """Runs of the pixels of a picture with opacity whose opacity is below that value."""
    return F.arrow_udf(_runs_where(lambda p: p[:, :, -1] < below), RUNS)(picture)


def run_rows(rows: DataFrame, found: str = "runs", key: str = "mask") -> DataFrame:
    """The run table of a column of runs."""
    return rows.select(F.col(key).alias("mask"), F.explode(found).alias("r")).select("mask", "r.y", "r.x1", "r.x2")


def gathered(runs: DataFrame) -> DataFrame:
    """(mask, runs): a mask's runs as one column; bounded by its canvas."""
    return runs.groupBy("mask").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("y", "x1", "x2")]))).alias("runs"))


def mask_picture(runs: Column, width: Column, height: Column) -> Column:
    """A grey picture of 255 on the runs and 0 elsewhere; runs beyond the canvas are an error of the picture."""

    def fn(found: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        at, (y, x1, x2) = parts_of(found)
        rows = []
        for i, (wide, high) in enumerate(zip(w.to_pylist(), h.to_pylist(), strict=True)):
            own = slice(at[i], at[i + 1])
            a, b, c = y[own], x1[own], x2[own]
            if len(a) and (a.min() < 0 or a.max() >= high or b.min() < 0 or (b > c).any() or c.max() > wide):
                rows.append(picture_row(None, None, "beyond the canvas"))
                continue
            steps = np.zeros((high, wide + 1), np.int32)
            np.add.at(steps, (a, b), 1)
            np.add.at(steps, (a, c), -1)
            rows.append(picture_row(((np.cumsum(steps, axis=1)[:, :wide] > 0) * np.uint8(255))[:, :, None], "L"))
        return picture_array(rows)

    return F.arrow_udf(fn, PICTURE)(runs, width, height)


def mask_png(runs: Column, width: Column, height: Column) -> Column:
    """PNG bytes of mask_picture; null for runs beyond the canvas."""

    def fn(found: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        at, columns = parts_of(found)
        sizes, out = list(zip(w.to_pylist(), h.to_pylist(), strict=True)), [None] * len(found)
        for begin, end in png.blocks(wide * high for wide, high in sizes):
            alike: dict[tuple[int, int], list[int]] = {}
            for i in range(begin, end):
                alike.setdefault(sizes[i], []).append(i)
            for (wide, high), listed in alike.items():
                own = np.array(listed)
                n = at[own + 1] - at[own]
                of = np.repeat(np.arange(len(own)), n)
                y, x1, x2 = (c[np.arange(n.sum()) + np.repeat(at[own] - np.cumsum(n) + n, n)] for c in columns)
                beyond = np.unique(of[(y < 0) | (y >= high) | (x1 < 0) | (x1 > x2) | (x2 > wide)])
                done = png.encoded(run_raster(high, wide, len(own), of, y, x1, x2)[..., None] * np.uint8(255))
                for k in np.setdiff1d(np.arange(len(own)), beyond).tolist():
                    out[listed[k]] = done[k]
        return pa.array(out, pa.binary())

    return F.arrow_udf(fn, "binary")(runs, width, height)


def png_runs(data: Column, least: int = 128) -> Column:
    """light_runs of the grey picture that PNG bytes hold, as a struct of error and runs; one of them is null."""

    def fn(given: pa.Array) -> pa.Array:
        found: list[np.ndarray | None] = [None] * len(given)
        wrong: list[str | None] = [None] * len(given)
        for places, shown in png.decoded(given.to_pylist(), "L"):
            if isinstance(shown, str):
                wrong[places[0]] = shown
                continue
            edge = np.diff(np.pad(shown[:, :, :, 0] >= least, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
            of, y, x1 = np.nonzero(edge == 1)
            listed = np.column_stack([y, x1, np.nonzero(edge == -1)[2]])
            for place, own in zip(places, np.split(listed, np.searchsorted(of, np.arange(1, len(places)))), strict=True):
                found[place] = own
        return pa.StructArray.from_arrays([pa.array(wrong, pa.string()), lists(found, y=pa.int32(), x1=pa.int32(), x2=pa.int32())], names=["error", "runs"])

    return F.arrow_udf(fn, f"error string, runs {RUNS}")(data)


def flat_picture(width: Column, height: Column, colour: Column) -> Column:
    """A picture of one colour, an array of red, green and blue."""

    def fn(w: pd.Series, h: pd.Series, c: pd.Series) -> pd.DataFrame:
        return picture_frame([picture_row(np.full((int(b), int(a), 3), np.array(v, np.uint8)), "RGB") for a, b, v in zip(w, h, c, strict=True)])

    return F.pandas_udf(fn, PICTURE)(width, height, colour)


def statistics(picture: Column) -> Column:
    """least, greatest, sum and number of a picture's values over all channels, and how many are neither 0 nor 255."""

    def fn(shown: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for p in shown["pixels"]:
            v = None if p is None else np.frombuffer(p, np.uint8)
            rows.append((None,) * 5 if v is None else (int(v.min()), int(v.max()), int(v.sum(dtype=np.int64)), len(v), int(((v != 0) & (v != 255)).sum())))
        return pd.DataFrame(rows, columns=["least", "greatest", "total", "n", "between"], dtype=object).astype("Int64")

    return F.pandas_udf(fn, "least long, greatest long, total long, n long, between long")(picture)


def png_colours(data: Column) -> Column:
    """How many pixels each colour has in the picture that PNG bytes hold, as an array of (red, green, blue, n) in order of colour; null for bytes that hold none."""

    def fn(given: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = [None] * len(given)
        for places, shown in png.decoded(given.to_pylist(), "RGB"):
            if isinstance(shown, str):
                continue
            codes = shown.reshape(len(places), -1, 3).astype(np.int32) @ np.array([65536, 256, 1], np.int32)
            new = np.ones(codes.shape, bool)  # stretches of one colour are counted, not their pixels
            np.not_equal(codes[:, 1:], codes[:, :-1], out=new[:, 1:])
            start = np.flatnonzero(new)
            both, of = np.unique((start // codes.shape[1] << 24) + codes.reshape(-1)[start], return_inverse=True)
            n = np.bincount(of, np.diff(np.append(start, codes.size))).astype(np.int64)
            c = both & 0xFFFFFF
            listed = np.column_stack([c >> 16, c >> 8 & 255, c & 255, n])
            for place, own in zip(places, np.split(listed, np.searchsorted(both >> 24, np.arange(1, len(places)))), strict=True):
                out[place] = own
        return lists(out, red=pa.int32(), green=pa.int32(), blue=pa.int32(), n=pa.int64())

    return F.arrow_udf(fn, "array<struct<red:int,green:int,blue:int,n:long>>")(data)


FACTS = {"error": pa.string(), "width": pa.int32(), "height": pa.int32(), "between": pa.int64(), "greatest": pa.int64(), "on": pa.bool_()}


def _facts(shown: Iterator[tuple[list[int], np.ndarray | str]], px: pa.Array, py: pa.Array) -> pa.Array:
    """FACTS of grey pictures, given as by png.decoded: how many values are neither 0 nor 255, the greatest, and whether the point lies on a 255."""
    out: list[tuple] = [()] * len(px)
    at = list(zip(px.to_pylist(), py.to_pylist(), strict=True))
    for places, stack in shown:
        if isinstance(stack, str):
            out[places[0]] = (stack, None, None, None, None, False)
            continue
        h, w = stack.shape[1:3]
        values = stack.reshape(len(places), -1)
        between, greatest = ((values != 0) & (values != 255)).sum(axis=1).tolist(), values.max(axis=1).tolist()
        for k, place in enumerate(places):
            x, y = at[place]
            on = x is not None and y is not None and 0 <= x < w and 0 <= y < h and bool(stack[k, int(y), int(x), 0] == 255)
            out[place] = (None, w, h, between[k], greatest[k], on)
    return pa.StructArray.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(FACTS.values())], names=list(FACTS))


def asset_errors(assets: DataFrame) -> DataFrame:
    """(mask, rule) of mask pictures (mask, data or picture, source_width, source_height, px, py) that break a rule; data: PNG bytes.

    undecodable: no picture; not_binary: a value that is neither 0 nor 255; empty: nothing set; size: another size than the source; point: the
    region's point doesn't lie on it.
    """
    def of_pictures(shown: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
        rows = enumerate(zip(*_fields(shown, "width", "height", "mode", "pixels", "error"), strict=True))
        return _facts((([i], e or "no picture" if p is None else array_of(w, h, m, p)[None]) for i, (w, h, m, p, e) in rows), px, py)

    def of_bytes(data: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
        return _facts(png.decoded(data.to_pylist(), "L"), px, py)

    given = "data" if "data" in assets.columns else "picture"
    facts = F.arrow_udf(of_bytes if given == "data" else of_pictures, "error string, width int, height int, between long, greatest long, on boolean")(given, "px", "py")
    s = assets.withColumn("s", facts)
    there = F.col("s.error").isNull()
    size = (F.col("s.width") != F.col("source_width")) | (F.col("s.height") != F.col("source_height"))
    rules = {"undecodable": ~there, "not_binary": there & (F.col("s.between") > 0), "empty": there & (F.col("s.greatest") < 255), "size": there & size, "point": there & ~F.col("s.on")}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return s.select("mask", F.explode(broken).alias("rule"))


# --- drawing ------------------------------------------------------------------------------------------------------


Steps = Iterator[tuple[np.ndarray, tuple[int, int, int] | None, int]]


def marked(data: Column, regions: Column, mark: Callable[..., Steps]) -> Column:
    """PNG bytes of the pictures that PNG bytes hold, with regions drawn on; null for bytes that hold none.

    regions: an array of structs, of which `region` numbers a picture's regions and the other fields go to mark. That gets the
    height and width of some pictures, the place of each struct's picture among them and its fields, and gives what is laid on in turn, as
    booleans (pictures, height, width), a colour (none: the region's) and an opacity. Regions come in order of their number.
    """
    def fn(given: pa.Array, found: pa.Array) -> pa.Array:
        at, columns = parts_of(found)
        fields = dict(zip((f.name for f in found.type.value_type), columns, strict=True))
        values, out = given.to_pylist(), [None] * len(given)
        for begin, end in png.blocks(map(png.size, values)):
            alike: dict[bytes | None, list[int]] = {}
            for i in range(begin, end):
                alike.setdefault(values[i], []).append(i)
            for places, shown in png.decoded(list(alike), "RGB"):  # equal bytes are read once
                if isinstance(shown, str):
                    continue
                keys = list(alike)
                rows = [keys[p] for p in places]
                of = np.repeat(np.arange(len(rows)), [len(alike[r]) for r in rows])
                own = np.array([i for r in rows for i in alike[r]])
                stack, n = shown[of], at[own + 1] - at[own]
                each = np.arange(n.sum()) + np.repeat(at[own] - np.cumsum(n) + n, n)
                draw(stack, np.repeat(np.arange(len(own)), n), {k: v[each] for k, v in fields.items()}, mark)
                for i, done in zip(own.tolist(), png.encoded(stack), strict=True):
                    out[i] = done
        return pa.array(out, pa.binary())

    return F.arrow_udf(fn, "binary")(data, regions)


def draw(stack: np.ndarray, of: np.ndarray, fields: dict[str, np.ndarray], mark: Callable[..., Steps]) -> None:
    """Lay regions on a stack of pictures (n, height, width, 3), all steps of a region before those of the next; of: the picture of each of the regions' structs."""
    for number in np.unique(fields["region"]):
        own = fields["region"] == number
        pictures, nth = np.unique(of[own], return_inverse=True)
        for where, colour, opacity in mark(*stack.shape[1:3], len(pictures), nth, **{k: v[own].astype(np.int64) for k, v in fields.items() if k != "region"}):
            picture, y, x = np.nonzero(where)
            at = (pictures[picture], y, x)
            top = np.array(colour or REGION_COLORS[(number - 1) % len(REGION_COLORS)], np.uint8)
            stack[at] = top if opacity == 255 else over(top, np.array(opacity), stack[at])


def run_raster(height: int, width: int, n: int, of: np.ndarray, y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Booleans (n, height, width) of runs; what lies beyond the canvas is left out."""
    steps = np.zeros((n, height, width + 1), np.int32)
    x1, x2 = np.clip(x1, 0, width), np.clip(x2, 0, width)
    own = (y >= 0) & (y < height) & (x1 < x2)
    np.add.at(steps, (of[own], y[own], x1[own]), 1)
    np.add.at(steps, (of[own], y[own], x2[own]), -1)
    return np.cumsum(steps, axis=2)[:, :, :width] > 0


def together(where: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    """What is set in any of the booleans of one picture."""
    if len(of) == n:
        return where[np.argsort(of)]
    out = np.zeros((n, *where.shape[1:]), bool)
    np.logical_or.at(out, of, where)
    return out


def paint(out: np.ndarray, layers: np.ndarray) -> None:
    """Lay layers (rows of nth, y, x1, x2, red, green, blue, opacity in order of nth) on a picture, those of one step and colour at a time."""
    flat, wide = out.reshape(-1, 3), out.shape[1]
    if not len(layers):
        return
    step = layers[:, [0, 4, 5, 6, 7]]
    first = np.flatnonzero(np.append(True, (step[1:] != step[:-1]).any(axis=1)))
    for own in np.split(layers, first[1:]):
        y, a, b = own[:, 1], np.maximum(own[:, 2], 0), np.minimum(own[:, 3], wide)
        n = np.maximum(b - a, 0)
        at = np.arange(n.sum()) + np.repeat(y * wide + a - np.cumsum(n) + n, n)
        colour, opacity = own[0, 4:7], own[0, 7]
        if opacity == 255:
            flat[at] = colour
        elif len(np.unique(at)) == len(at):
            flat[at] = over(colour, opacity, flat[at])
        else:  # a pixel that is laid on twice takes the colour twice
            for k, m in zip(np.cumsum(n) - n, n, strict=True):
                flat[at[k : k + m]] = over(colour, opacity, flat[at[k : k + m]])


def line_width(width: int, height: int) -> int:
    share, least = MARKERS["line_width"]
    return max(least, round(min(width, height) * share))


def mask_marks(height: int, width: int, n: int, of: np.ndarray, y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> Steps:
    """Regions of runs filled in their colour with some opacity, their edge within a line's width to both sides in full."""
    own, reach = run_raster(height, width, n, of, y, x1, x2), line_width(width, height)
    yield own, None, FILL_OPACITY
    yield stack_squared_up(own, reach) & stack_squared_up(~own, reach), None, 255  # beyond the canvas nothing is seen


def box_marks(height: int, width: int, n: int, of: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> Steps:
    """A frame of a line's width within each box."""
    wide = line_width(width, height)

    def within(pad: int) -> np.ndarray:
        (a, b), (c, d) = [(lo[:, None] + pad, hi[:, None] - pad) for lo, hi in ((x1, x2), (y1, y2))]
        x, y = np.arange(width), np.arange(height)
        return ((y >= c) & (y < d))[:, :, None] & ((x >= a) & (x < b))[:, None]

    yield together(within(0) & ~within(wide), n, of), None, 255


def point_marks(height: int, width: int, n: int, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> Steps:
    """A dot of the region's colour at each point, within a white ring."""
    radius, ring = (max(MARKERS[name][1], round(min(width, height) * MARKERS[name][0])) for name in ("point_radius", "point_outline"))
    for r, colour in ((radius, RING), (radius - ring, None)):
        dy = np.arange(height) - y[:, None]
        reach = np.where(abs(dy) <= r, np.array(run.disc_reach(r))[np.clip(dy, -r, r) + r], -1)
        yield together(abs(np.arange(width) - x[:, None])[:, None] <= reach[:, :, None], n, of), colour, 255


def outline_width(width: int, height: int) -> int:
    return max(2, round(max(width, height) / 400))


def outline_marks(height: int, width: int, n: int, of: np.ndarray, y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> Steps:
    """For a judge's view: around each region of runs a contour in its colour, outside the region, with a dark pixel beyond."""
    own, reach = run_raster(height, width, n, of, y, x1, x2), outline_width(width, height)
    for r, colour in ((reach + 1, HALO), (reach, None)):
        yield stack_squared_up(own, r) & ~own, colour, 255
