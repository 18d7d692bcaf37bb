"""Regions drawn on pictures of PNG bytes, and masks read from them: pixels stay within a function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brocade.constants import FILL_OPACITY, HALO, REGION_COLORS, RING
from brocade.functions import png
from brocade.functions.resampling import over
from brocade.operators import pictures, runs
from brocade.operators.masks import disc
from brocade.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def near(mask, reach):
    """What has a set pixel within a square about it."""
    h, w = mask.shape
    return np.array([[mask[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1].any() for x in range(w)] for y in range(h)])


def drawn(spark, shown, regions, kind, mark):
    rows = [(i, None if p is None else bytearray(png.encode(p) if isinstance(p, np.ndarray) else p), r) for i, (p, r) in enumerate(zip(shown, regions, strict=True))]
    got = spark.createDataFrame(rows, f"i int, d binary, r array<struct<{kind}>>").coalesce(1).select("i", pictures.marked(F.col("d"), F.col("r"), mark).alias("d")).collect()
    return [None if r["d"] is None else png.decode(bytes(r["d"]), "RGB") for r in sorted(got)]


def sample(seed):
    rng = np.random.default_rng(seed)
    one = rng.integers(0, 256, (20, 25, 3)).astype(np.uint8)
    return [one, one, rng.integers(0, 256, (30, 16, 3)).astype(np.uint8), None, b"no picture", one[:, ::-1].copy(), one]


def run_regions():
    a = [(2, y, 3 + y % 4, 9 + y % 5) for y in range(4, 12)] + [(2, y, 6, 11) for y in range(8, 14)]  # runs overlap; the second region comes first
    b = [(1, y, 8, 30) for y in range(10, 16)] + [(1, -2, 0, 4), (1, 40, 0, 4), (1, 3, 5, 5)]  # some reaches beyond the canvas
    return [a + b, b, a + [(4, 0, 0, 3)], a, a, None, []]


def raster(found, number, shape):
    out = np.zeros(shape[:2], bool)
    for r, y, x1, x2 in found or []:
        if r == number and 0 <= y < shape[0]:
            out[y, max(0, x1) : x2] = True
    return out


def test_runs_are_marked(spark):
    shown, regions = sample(1), run_regions()
    filled, around = (drawn(spark, shown, regions, "region:int,y:int,x1:int,x2:int", m) for m in (pictures.mask_marks, pictures.outline_marks))
    for p, found, got, view in zip(shown, regions, filled, around, strict=True):
        if not isinstance(p, np.ndarray):
            assert got is None and view is None
            continue
        want, seen = p.copy(), p.copy()
        for number in (1, 2, 4):
            own, colour = raster(found, number, p.shape), REGION_COLORS[(number - 1) % 3]
            want[own] = over(np.array(colour), np.array(FILL_OPACITY), want[own])
            want[near(own, 3) & near(~own, 3)] = colour
            seen[near(own, 3) & ~own] = HALO
            seen[near(own, 2) & ~own] = colour
        assert (got == want).all() and (view == seen).all()


def test_boxes_and_points_are_marked(spark):
    shown = sample(2)
    boxes = [[(1, 2, 3, 20, 15), (2, 10, 8, 40, 18)], [(2, -3, 1, 4, 9), (1, 5, 5, 5, 9)], [(1, 1, 1, 6, 6), (1, 4, 4, 15, 20)], [], None, [(5, 0, 0, 25, 20)], None]
    for p, found, got in zip(shown, boxes, drawn(spark, shown, boxes, "region:int,x1:int,y1:int,x2:int,y2:int", pictures.box_marks), strict=True):
        if isinstance(p, np.ndarray):
            want = p.copy()
            y, x = np.mgrid[: p.shape[0], : p.shape[1]]
            for n, x1, y1, x2, y2 in sorted(found or []):
                inside = lambda k, x1=x1, y1=y1, x2=x2, y2=y2: (x >= x1 + k) & (x < x2 - k) & (y >= y1 + k) & (y < y2 - k)
                want[inside(0) & ~inside(3)] = REGION_COLORS[(n - 1) % 3]
            assert (got == want).all()
    points = [[(1, 12, 10), (2, 14, 10)], [(2, -4, 3), (2, 24, 19)], [(3, 0, 0)], [], None, None, [(1, 60, 60)]]
    for p, found, got in zip(shown, points, drawn(spark, shown, points, "region:int,x:int,y:int", pictures.point_marks), strict=True):
        if isinstance(p, np.ndarray):
            want = np.pad(p, ((80, 80), (80, 80), (0, 0)))
            for n in sorted({r[0] for r in found or []}):
                for r, colour in ((10, RING), (7, REGION_COLORS[n - 1])):
                    for _, x, y in [f for f in found if f[0] == n]:
                        want[80 + y - r : 81 + y + r, 80 + x - r : 81 + x + r][disc(r)] = colour
            assert (got == want[80:-80, 80:-80]).all()


def test_stacks_of_bytes(monkeypatch):
    rng = np.random.default_rng(4)
    shown = [rng.integers(0, 256, (int(h), int(w), c)).astype(np.uint8) // rng.choice([1, 200]) for h, w, c in zip(rng.integers(1, 4, 40), rng.integers(1, 4, 40), rng.choice([1, 3, 4], 40), strict=True)]
    data = [png.encode(p) for p in shown] + [None, b"", png.encode(shown[0])[:-20]]
    for cells in (1, 7, 1 << 18):
        monkeypatch.setattr(png.blocks, "__defaults__", (cells,))
        for mode in png.CHANNELS:
            got = {}
            for places, found in png.decoded(data, mode):
                got |= {i: found if isinstance(found, str) else p for i, p in zip(places, found if isinstance(found, np.ndarray) else [None], strict=True)}
            assert all((got[i] == png.decode(d, mode)).all() for i, d in enumerate(data[:40]))
            assert [got[i] for i in (40, 41, 42)] == ["no bytes", "not a PNG", "truncated"]


def test_colours_of_bytes(spark):
    rng = np.random.default_rng(6)
    shown = [rng.integers(0, 2, (5, 4, 3)).astype(np.uint8) * 255, np.full((2, 3, 3), 9, np.uint8), None]
    df = spark.createDataFrame([(i, None if p is None else bytearray(png.encode(p))) for i, p in enumerate(shown)], "i int, d binary")
    for i, found in df.select("i", pictures.png_colours(F.col("d")).alias("c")).collect():
        if shown[i] is None:
            assert found is None
        else:
            c, n = np.unique(shown[i].reshape(-1, 3), axis=0, return_counts=True)
            assert [tuple(r) for r in found] == [(*a, b) for a, b in zip(c.tolist(), n.tolist(), strict=True)]


@pytest.mark.parametrize("name", ["mask_locators", "box_locators", "point_locators", "outlined_views"])
def test_pixels_stay_in_one_function(spark, name):
    made = plan(QUERIES[name](spark, SF))
    assert made.count("EvalPython") == 1 and "Window" not in made
    assert made.count("Exchange") == 2  # the pictures' ids and the regions


def test_masks_through_bytes(spark):
    rows = [(1, [(3, 0, 5), (3, 4, 9), (0, 2, 2)], 17, 14), (2, [(3, 0, 99)], 17, 14), (3, [(-1, 0, 1)], 17, 14), (4, None, 3, 2), (5, [(1, 0, 3)], 3, 2), (6, [(2, 0, 3)], 3, 2), (7, [(13, 16, 17)], 17, 14)]
    df = spark.createDataFrame(rows, f"mask long, runs {pictures.RUNS}, w int, h int").coalesce(1)
    made = df.select("mask", pictures.mask_png(F.col("runs"), F.col("w"), F.col("h")).alias("data"), pictures.mask_picture(F.col("runs"), F.col("w"), F.col("h")).alias("picture"))
    for _, data, shown in made.collect():
        assert data == (None if shown.error else png.encode(png.array_of(shown.width, shown.height, shown.mode, shown.pixels)))
    seen = {r["mask"]: r["s"] for r in made.select("mask", pictures.png_runs(F.col("data")).alias("s")).collect()}
    assert {m: s.error for m, s in seen.items() if s.error} == dict.fromkeys((2, 3, 6), "no bytes")
    assert {m: [tuple(r) for r in s.runs] for m, s in seen.items() if not s.error} == {1: [(3, 0, 9)], 4: [], 5: [(1, 0, 3)], 7: [(13, 16, 17)]}


def test_assets_of_bytes(spark):
    grey = np.zeros((4, 5, 1), np.uint8)
    part, whole = grey.copy(), grey + np.uint8(255)
    part[2, 3] = 99
    rows = [(1, png.encode(whole), 5, 4, 4, 3), (2, png.encode(whole), 4, 5, 5, 3), (3, png.encode(part), 5, 4, 3, 2), (4, None, 9, 9, 0, 0), (5, b"x", 5, 4, None, None), (6, png.encode(whole), 5, 4, None, 1)]
    df = spark.createDataFrame([(m, None if d is None else bytearray(d), *rest) for m, d, *rest in rows], "mask long, data binary, source_width int, source_height int, px int, py int")
    want = [(2, "point"), (2, "size"), (3, "empty"), (3, "not_binary"), (3, "point"), (4, "undecodable"), (5, "undecodable"), (6, "point")]
    assert sorted(map(tuple, pictures.asset_errors(df).collect())) == want
    assert sorted(map(tuple, pictures.asset_errors(df.withColumn("picture", png.picture(F.col("data"), "L")).drop("data")).collect())) == want


@pytest.mark.parametrize("name", ["decoded_masks", "mask_asset_errors"])
def test_masks_go_as_bytes(spark, name):
    made = plan(QUERIES[name](spark, SF))
    assert made.count("EvalPython") == 2 and "Window" not in made and "Join" not in made
    assert made.count("Exchange") == 1
