"""Masks as runs, polygons, PNG bytes, resampling, reads by row group, published sets and listings against plain versions."""

import hashlib
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brocade.functions import png, resampling
from brocade.operators import masks, pictures, polygons, runs
from brocade.sources import listing, ordinals, publication

RUN = "mask long, y int, x1 int, x2 int"


# --- PNG ----------------------------------------------------------------------------------------------------------


def plain_png(values, depth, colour, filters, laced=False, extra=()):
    """A file of (height, width, samples) values, written by the book: every byte by itself, lines with the stated filters in turn."""
    h, w, each = values.shape
    turn = itertools.cycle(filters)

    def lines(part):
        out, above = b"", None
        for row in part:
            flat = row.ravel()
            if depth == 16:
                raw = b"".join(struct.pack(">H", v) for v in flat)
            else:
                bits = "".join(format(v, f"0{depth}b") for v in flat)
                raw = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
            step, kind = max(1, each * depth // 8), next(turn)
            above = above or bytes(len(raw))
            line = []
            for i, v in enumerate(raw):
                a, b, c = raw[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
            out += bytes([kind, *line])
            above = raw
        return out

    data = b"".join(lines(values[y::dy, x::dx]) for x, y, dx, dy in png.PASSES if w > x and h > y) if laced else lines(values)
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    packed = zlib.compress(data)
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced)) + b"".join(chunk(n, b) for n, b in extra) + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,depth", [(c, d) for c, ds in png.DEPTHS.items() for d in ds])
def test_png_forms(colour, depth):
    rng = np.random.default_rng(colour * 20 + depth)
    for (h, w), filters, laced in itertools.product([(1, 1), (5, 3), (9, 13)], [(0,), (0, 1, 2), (4, 3, 2, 1, 0), (3,)], [False, True]):
        each = png.SAMPLES[colour]
        values = rng.integers(0, 1 << depth, (h, w, each))
        table = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        extra = [(b"PLTE", table.tobytes()), (b"tRNS", bytes([7, 200]))] if colour == 3 else []
        got = png.decode(plain_png(values, depth, colour, filters, laced, extra), "RGBA")
        if colour == 3:
            want = np.dstack([table[values[:, :, 0]], np.array([7, 200] + [255] * 254)[values[:, :, 0]]])
        else:
            eight = values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1)
            rgb = np.repeat(eight[:, :, :1], 3, axis=2) if colour in (0, 4) else eight[:, :, :3]
            want = np.dstack([rgb, eight[:, :, -1] if colour in (4, 6) else np.full((h, w), 255)])
        assert (got == want).all()
        assert (png.decode(plain_png(values, depth, colour, filters, laced, extra), "RGB") == want[:, :, :3]).all()


def test_png_grey_and_one_clear_colour():
    values = np.array([[[10, 20, 30], [200, 100, 0]]])
    data = plain_png(values, 8, 2, (0,), extra=[(b"tRNS", struct.pack(">HHH", 10, 20, 30))])
    assert png.decode(data, "RGBA")[0, :, 3].tolist() == [0, 255]
    assert png.decode(data, "L")[0, :, 0].tolist() == [round((299 * r + 587 * g + 114 * b) / 1000) for r, g, b in values[0].tolist()]


def test_png_round_trip_and_bad_bytes(spark):
    rng = np.random.default_rng(1)
    for mode, each in png.CHANNELS.items():
        for h, w in ((1, 1), (3, 200), (64, 48)):
            pixels = rng.integers(0, 256, (h, w, each)).astype(np.uint8)
            pixels[: h // 2] = 9
            assert (png.decode(png.encode(pixels), mode) == pixels).all()
    good = png.encode(rng.integers(0, 256, (6, 5, 3)).astype(np.uint8))
    flipped = bytearray(good)
    flipped[45] ^= 1
    huge = png.SIGNATURE + struct.pack(">I4s", 13, b"IHDR") + (b := struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 2, 0, 0, 0)) + struct.pack(">I", zlib.crc32(b"IHDR" + b)) + good[-12:]
    cases = [(good, None), (None, "no bytes"), (b"", "not a PNG"), (b"GIF89a", "not a PNG"), (good[:60], "truncated"), (bytes(flipped), "wrong checksum"), (huge, "unknown header"), (png.SIGNATURE + good[-12:], "no header")]
    df = spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, (d, _) in enumerate(cases)], "i int, data binary")
    got = {r["i"]: r["p"] for r in df.select("i", png.picture(F.col("data"), "RGB").alias("p")).collect()}
    assert [got[i]["error"] for i in range(len(cases))] == [e for _, e in cases]
    assert (got[0]["width"], got[0]["height"], got[0]["mode"], len(got[0]["pixels"])) == (5, 6, "RGB", 90)
    again = df.select("i", png.png(png.picture(F.col("data"), "RGBA")).alias("d")).collect()
    assert [r["d"] is not None for r in again] == [e is None for _, e in cases]
    cell = spark.createDataFrame([((bytearray(good),),), ((None,),), (None,)], "cell struct<bytes:binary>").select(png.embedded(F.col("cell")).alias("p")).collect()
    assert [r["p"]["error"] for r in cell] == [None, "no bytes", "no bytes"]


# --- runs ---------------------------------------------------------------------------------------------------------


def rasters(seed, n=6, h=14, w=17, share=0.5):
    rng = np.random.default_rng(seed)
    out = [rng.random((h, w)) < share for _ in range(n)]
    out[0][:], out[1][:] = False, True
    out[2][:] = False
    out[2][0, 0] = out[2][-1, -1] = True
    return out


def as_pixels(spark, arrays):
    return spark.createDataFrame([(m, int(x), int(y)) for m, a in enumerate(arrays) for y, x in np.argwhere(a)], "mask long, x int, y int")


def as_arrays(df, n=6, h=14, w=17):
    out = [np.zeros((h, w), bool) for _ in range(n)]
    for r in df.collect():
        assert not out[r["mask"]][r["y"], r["x1"] : r["x2"]].any() and r["x1"] < r["x2"]
        out[r["mask"]][r["y"], r["x1"] : r["x2"]] = True
    return out


def equal(df, want, **size):
    got = as_arrays(df, len(want), **size)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    assert df.count() == sum(len(pictures.bands(a)) for a in want)  # runs are as long as can be


def test_runs_against_rasters(spark):
    a, b = rasters(1), rasters(2, share=0.3)
    b[1] = ~b[1]
    ra, rb = runs.from_pixels(as_pixels(spark, a)), runs.from_pixels(as_pixels(spark, b).unionByName(as_pixels(spark, b)))
    equal(ra, a)
    equal(runs.intersection(ra, rb), [x & y for x, y in zip(a, b, strict=True)])
    equal(runs.minus(ra, rb), [x & ~y for x, y in zip(a, b, strict=True)])
    equal(runs.union(ra.unionByName(rb).withColumn("whole", F.lit(0))), [np.logical_or.reduce([*a, *b])])
    equal(runs.merged(ra.unionByName(rb)), [x | y for x, y in zip(a, b, strict=True)])
    # runs that overlap within a table count once
    piled = ra.unionByName(ra.withColumn("x2", F.col("x1") + 1))
    equal(runs.combined(piled, rb, F.col("a") != F.col("b")), [x ^ y for x, y in zip(a, b, strict=True)])
    apart = {r["mask"]: r["mismatched"] for r in runs.difference(ra, rb).collect()}
    assert apart == {m: int((x ^ y).sum()) for m, (x, y) in enumerate(zip(a, b, strict=True)) if x.any() or y.any()}
    boxes = {r["mask"]: tuple(r)[1:] for r in runs.boxes(ra).collect()}
    assert boxes == {r["mask"]: tuple(r)[1:] for r in masks.boxes(as_pixels(spark, a)).collect()}
    assert sorted(map(tuple, runs.to_pixels(ra).collect())) == sorted(map(tuple, as_pixels(spark, a).collect()))
    points = spark.createDataFrame([(m, x, y, "p") for m in range(6) for x, y in ((0, 0), (16, 13), (5, 5))], "mask long, x int, y int, note string")
    assert {(r["mask"], r["x"], r["y"]) for r in runs.holding(ra, points).collect()} == {(m, x, y) for m in range(6) for x, y in ((0, 0), (16, 13), (5, 5)) if a[m][y, x]}
    assert runs.holding(ra, points).columns == points.columns


def test_run_neighbourhoods(spark):
    a = rasters(3, share=0.08)
    r = runs.from_pixels(as_pixels(spark, a))
    for radius in (1, 2, 5):
        equal(runs.widened(r, runs.disc_reach(radius), 17, 14), [masks.dilate(x, radius) for x in a])
    want = {m: set() for m in range(6)}
    for p in masks.edges(as_pixels(spark, a), 17, 14, 2).collect():
        want[p["mask"]].add((p["x"], p["y"]))
    got = as_arrays(runs.edges(r, 2, 17, 14))
    assert all({(int(x), int(y)) for y, x in np.argwhere(g)} == want[m] for m, g in enumerate(got))
    equal(runs.inverse(r, spark.range(6).withColumnRenamed("id", "mask"), 17, 14), [~x for x in a])
    equal(runs.dilated(r, 17, 14), [masks.dilate(x, 1) for x in a])


def test_run_resizing(spark):
    a = rasters(4, share=0.4)
    r = runs.from_pixels(as_pixels(spark, a))
    for w, h in ((17, 14), (34, 42), (5, 4), (23, 9), (1, 1), (8, 31)):
        want = [x[(2 * np.arange(h)[:, None] + 1) * 14 // (2 * h), (2 * np.arange(w)[None] + 1) * 17 // (2 * w)] for x in a]
        equal(runs.resized(r, F.lit(17), F.lit(14), F.lit(w), F.lit(h)), want, h=h, w=w)


def test_run_plans_make_no_pixels(spark):
    """A mask of a million pixels goes through union and difference as its thousand runs."""
    tall = spark.range(1000).select(F.lit(1).cast("long").alias("mask"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x1"), F.lit(1000).alias("x2"))
    holes = tall.withColumns({"x1": F.lit(400), "x2": F.lit(500)})
    assert runs.boxes(runs.minus(tall, holes)).first()["area"] == 900_000
    assert runs.difference(tall, holes).first()["mismatched"] == 900_000
    plan = runs.difference(tall, holes)._jdf.queryExecution().toString()
    assert "Generate" not in plan


# --- polygons -----------------------------------------------------------------------------------------------------


def plain_polygon(points, width, height):
    """The rule as it is written, pixel by pixel."""
    p = [(int(x), int(y)) for x, y in points]
    out = np.zeros((height, width), bool)
    sides = [sorted((a, b), key=lambda q: (q[1], q[0])) for a, b in zip(p, p[1:] + p[:1], strict=True)]
    for y in range(height):
        at = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in sides if y0 <= y < y1)
        for a, b in zip(at[::2], at[1::2], strict=True):
            for x in range(width):
                out[y, x] |= np.floor(a + 0.5) <= x <= np.ceil(b - 0.5)
    for (x0, y0), (x1, y1) in sides:
        if y1 - y0 >= abs(x1 - x0):
            drawn = [(int(np.floor(x0 + (y - y0) * (x1 - x0) / (y1 - y0) + 0.5)) if y1 > y0 else x0, y) for y in range(y0, y1 + 1)]
        else:
            drawn = [(x, int(np.floor(y0 + (x - x0) * (y1 - y0) / (x1 - x0) + 0.5))) for x in range(min(x0, x1), max(x0, x1) + 1)]
        for x, y in drawn:
            if 0 <= x < width and 0 <= y < height:
                out[y, x] = True
    return out


def test_polygons(spark):
    rng = np.random.default_rng(8)
    shapes = [rng.uniform(-5, 30, (n, 2)).round(1).tolist() for n in (3, 3, 4, 5, 7, 9, 12, 30)]
    shapes += [[(2, 2), (9, 2), (9, 8), (2, 8)], [(1, 1), (1, 1), (1, 1)], [(0, 5), (16, 5), (8, 5)], [(-30, -30), (-20, -25), (-28, -9)], [(-50, -50), (80, -50), (80, 80), (-50, 80)]]
    df = spark.createDataFrame([(m, [[float(v) for p in s for v in p]], 17, 14) for m, s in enumerate(shapes)], "mask long, nested array<array<double>>, width int, height int")
    given = df.select("mask", polygons.points(F.col("nested")).alias("points"), "width", "height")
    got = polygons.rasterised(given)
    equal(got, [plain_polygon(s, 17, 14) for s in shapes])
    with pytest.raises(ValueError, match="empty mask"):
        polygons.require_all(given, got)
    assert polygons.require_all(given.filter("mask = 8"), got.filter("mask = 8")).count()
    for bad in ([[1.0, 2.0, 3.0, 4.0]], [[1.0] * 7], [[1.0] * 6, [2.0] * 6]):
        wrong = spark.createDataFrame([(1, bad, 17, 14)], df.schema)
        with pytest.raises(Exception, match="not a polygon"):
            wrong.select(polygons.points(F.col("nested"))).collect()


# --- resampling ---------------------------------------------------------------------------------------------------


def plain_row(row, out, kind, start=0.0, stop=None):
    """One row of one channel with real weights, each tap by itself."""
    kernel, reach = resampling.KERNELS[kind]
    stop = len(row) if stop is None else stop
    scale = (stop - start) / out
    wide = max(1.0, scale)
    made = []
    for i in range(out):
        centre = start + (i + 0.5) * scale
        a, b = max(0, int(centre - reach * wide + 0.5)), min(len(row), int(centre + reach * wide + 0.5))
        w = np.array([float(kernel(np.array((x + 0.5 - centre) / wide))) for x in range(a, b)])
        made.append(float((w * row[a:b]).sum() / w.sum()))
    return np.clip(made, 0, 255)


@pytest.mark.parametrize("kind", ["bicubic", "lanczos"])
def test_resampling(kind):
    rng = np.random.default_rng(2)
    row = rng.integers(0, 256, (1, 23, 1)).astype(np.uint8)
    for out in (1, 5, 22, 23, 24, 60):
        assert np.abs(resampling.resize(row, out, 1, kind)[0, :, 0] - plain_row(row[0, :, 0].astype(float), out, kind)).max() <= 0.51
    part = resampling.resize(row, 7, 1, kind, (2.25, 0, 19.5, 1))
    assert np.abs(part[0, :, 0] - plain_row(row[0, :, 0].astype(float), 7, kind, 2.25, 19.5)).max() <= 0.51
    flat = np.full((9, 11, 3), 77, np.uint8)
    assert (resampling.resize(flat, 30, 4, kind) == 77).all()
    picture = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    assert (resampling.resize(picture, 11, 9, kind) == picture).all()
    turned = resampling.resize(picture.transpose(1, 0, 2), 9, 20, kind).transpose(1, 0, 2)
    assert np.abs(turned.astype(int) - resampling.resize(picture, 20, 9, kind)).max() <= 1
    clear = np.dstack([np.full((4, 4, 3), 200, np.uint8), np.zeros((4, 4), np.uint8)])
    clear[:, 2:, 3] = 255
    clear[:, :2, :3] = 0  # colours that can't be seen don't bleed
    big = resampling.resize(clear, 16, 16, kind)
    assert (big[:, :, :3][big[:, :, 3] > 40] >= 194).all()


def test_alignment():
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 256, (10, 40, 3)).astype(np.uint8)
    assert resampling.middle(40, 10, 20, 20) == (15.0, 0.0, 25.0, 10.0) and resampling.middle(10, 40, 20, 10) == (0.0, 17.5, 10.0, 22.5)
    assert resampling.inner_size(40, 10, 20, 20) == (20, 5) and resampling.inner_size(10, 40, 20, 20) == (5, 20) and resampling.inner_size(8, 8, 20, 20) == (20, 20)
    inside = resampling.align(wide, 20, 20, "contain")
    assert inside.shape == (20, 20, 3) and not inside[:7].any() and not inside[12:].any() and (inside[7:12] == resampling.resize(wide, 20, 5)).all()
    assert (resampling.align(wide, 10, 10, "cover") == wide[:, 15:25]).all()
    assert (resampling.align(wide, 13, 29, "stretch") == resampling.resize(wide, 13, 29)).all()
    assert resampling.resize(wide, 80, 20, "nearest")[::2, ::2].tolist() == wide.tolist()


def test_on_white_and_views(spark):
    rng = np.random.default_rng(4)
    pixels = rng.integers(0, 256, (6, 7, 4)).astype(np.uint8)
    pixels[0, :, 3], pixels[1, :, 3] = 0, 255
    want = np.rint((pixels[:, :, :3] * (a := pixels[:, :, 3:].astype(float)) + 255 * (255 - a)) / 255)
    assert np.abs(resampling.over_white(pixels) - want).max() <= 1 and (resampling.over_white(pixels)[0] == 255).all() and (resampling.over_white(pixels)[1] == pixels[1, :, :3]).all()
    df = spark.createDataFrame([(1, bytearray(png.encode(pixels))), (2, None)], "i int, d binary").select("i", png.picture(F.col("d"), "RGBA").alias("p"))
    row, gone = df.orderBy("i").select(resampling.on_white(F.col("p")).alias("w"), resampling.resized(F.col("p"), F.lit(3), F.lit(2)).alias("r"), resampling.in_view(F.col("p"), 12).alias("v"), resampling.aligned(F.col("p"), F.lit(4), F.lit(4), F.lit("contain")).alias("a")).collect()
    assert row["w"]["mode"] == "RGB" and bytes(row["w"]["pixels"]) == resampling.over_white(pixels).tobytes()
    assert (row["r"]["width"], row["r"]["height"]) == (3, 2) and bytes(row["r"]["pixels"]) == resampling.resize(pixels, 3, 2).tobytes()
    assert (row["v"]["width"], row["v"]["height"]) == (round(7 * (12 / 42) ** 0.5), round(6 * (12 / 42) ** 0.5)) and (row["a"]["width"], row["a"]["height"]) == (4, 4)
    assert {gone[c]["error"] for c in ("w", "r", "v", "a")} == {"no bytes"}


def test_masks_and_assets(spark):
    a = rasters(5)
    shown = pictures.gathered(runs.from_pixels(as_pixels(spark, a))).select("mask", pictures.mask_picture(F.col("runs"), F.lit(17), F.lit(14)).alias("picture"))
    equal(pictures.run_rows(shown.select("mask", pictures.light_runs(F.col("picture")).alias("runs"))), a)
    beyond = spark.createDataFrame([(1, [(3, 0, 99)]), (2, [(99, 0, 1)]), (3, None)], f"mask long, runs {pictures.RUNS}").select(pictures.mask_picture(F.col("runs"), F.lit(17), F.lit(14)).alias("p")).collect()
    assert [r["p"]["error"] for r in beyond] == ["beyond the canvas", "beyond the canvas", None]
    rgba = np.zeros((2, 3, 4), np.uint8)
    rgba[0, :, 3], rgba[1, 1, 3] = [0, 127, 128], 255
    holes = spark.createDataFrame([(1, bytearray(png.encode(rgba)))], "mask long, d binary").select("mask", pictures.clear_runs(png.picture(F.col("d"), "RGBA")).alias("runs"))
    assert sorted(tuple(r)[1:] for r in pictures.run_rows(holes).collect()) == [(0, 0, 2), (1, 0, 1), (1, 2, 3)]
    grey = np.array([[[0], [128], [255]]], np.uint8)
    rows = [(1, grey, 3, 1, 2, 0), (2, np.array([[[0], [255]]], np.uint8), 2, 1, 1, 0), (3, np.array([[[0], [255]]], np.uint8), 2, 2, 0, 0), (4, np.zeros((1, 2, 1), np.uint8), 2, 1, 5, 5), (5, None, 2, 1, 0, 0), (6, np.array([[[255]]], np.uint8), 1, 1, None, None)]
    df = spark.createDataFrame([(m, bytearray(png.encode(p)) if p is not None else None, *rest) for m, p, *rest in rows], "mask long, d binary, source_width int, source_height int, px int, py int")
    got = pictures.asset_errors(df.withColumn("picture", png.picture(F.col("d"), "L")))
    assert sorted(map(tuple, got.collect())) == [(1, "not_binary"), (3, "point"), (3, "size"), (4, "empty"), (4, "point"), (5, "undecodable"), (6, "point")]


# --- files --------------------------------------------------------------------------------------------------------


def test_only_wanted_row_groups_are_read(spark, tmp_path):
    """The bytes of all other row groups are destroyed, and the file beside can't even be opened: places are found all the same."""
    shards = tmp_path / "shards"
    shards.mkdir()
    for name in ("a", "b"):
        table = pa.table({"k": pa.array(range(1000)), "v": [f"{name}{i}" for i in range(1000)], "big": ["x" * 50 + str(i) for i in range(1000)]})
        pq.write_table(table, shards / f"{name}.parquet", row_group_size=100, compression="none", use_dictionary=False)
    (shards / "c.parquet").write_bytes(b"no parquet")
    meta = pq.ParquetFile(shards / "a.parquet").metadata
    data = bytearray((shards / "a.parquet").read_bytes())
    wanted_rows = [5, 305, 399, 305]
    for g in range(meta.num_row_groups):
        for c in range(3):
            at = meta.row_group(g).column(c)
            if g not in (0, 3) or at.path_in_schema == "big":
                data[at.data_page_offset : at.data_page_offset + at.total_compressed_size] = b"\xff" * at.total_compressed_size
    (shards / "a.parquet").write_bytes(bytes(data))
    paths = [str(shards / f"{n}.parquet") for n in "ab"]
    wanted = spark.createDataFrame([(f"c{i}", "a.parquet", r) for i, r in enumerate(wanted_rows)], "case string, file string, row int")
    got = ordinals.by_row_group(spark, paths, wanted, "v", "k")
    assert got.columns == ["file", "row", "case", "v", "k"] and sorted((r["case"], r["v"], r["k"]) for r in got.collect()) == [(f"c{i}", f"a{r}", r) for i, r in enumerate(wanted_rows)]
    assert sorted((r["row_group"], r["first"], r["n"]) for r in ordinals.row_groups(ordinals.listed(spark, paths[:1])).collect()) == [(g, 100 * g, 100) for g in range(10)]
    for file, row in (("a.parquet", 1000), ("z.parquet", 0), ("a.parquet", -1)):
        with pytest.raises(Exception, match="no such row"):
            ordinals.by_row_group(spark, paths, spark.createDataFrame([(file, row)], "file string, row int"), "k").collect()
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "b.parquet").write_bytes((shards / "b.parquet").read_bytes())
    with pytest.raises(ValueError, match="two files"):
        ordinals.by_row_group(spark, [*paths, str(tmp_path / "more" / "b.parquet")], spark.createDataFrame([("b.parquet", 1)], "file string, row int"), "k")


def contents(spark, root):
    return {r["name"]: bytes(r["content"]) for r in publication.contents(spark, root).collect()}


def test_publication(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "site")
    make = lambda rows: spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary").repartition(3)
    old = {f"a/{i}.txt": f"old {i}".encode() for i in range(9)} | {"top.json": b"{}"}
    with pytest.raises(ValueError, match="nothing is published"):
        publication.manifest(spark, root)
    first = publication.publish(make(old.items()), root)
    assert contents(spark, root) == old and publication.broken(spark, root).isEmpty()
    assert {(r["name"], r["size"], r["sha256"]) for r in publication.manifest(spark, root).collect()} == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in old.items()}
    # written but not switched: the old set is whole
    new = {"a/1.txt": b"new", "b/2.txt": b"two", "empty": b"", "deep/er/3.txt": b"\x00\xff"}
    second = publication.stage(make(new.items()), root)
    assert publication.current(spark, root) == first and contents(spark, root) == old
    # switched but not cleared: the new one is, and what it doesn't name isn't seen
    publication.switch(spark, root, second)
    assert contents(spark, root) == new and (tmp_path / "site" / "sets" / first).exists()
    assert publication.clear(spark, root) == [first] and not (tmp_path / "site" / "sets" / first).exists()
    # a task fails while it writes: nothing that is read changes
    with pytest.raises(Exception, match="not a file"):
        publication.publish(make([("good.txt", b"1"), ("../bad.txt", b"2")]), root)
    assert contents(spark, root) == new
    publication.clear(spark, root)  # tasks that still ran may have left files of their own
    assert [p.name for p in (tmp_path / "site" / "sets").iterdir() if not p.name.endswith(".crc")] == [second]
    for wrong in ("", "/x", "a//b", "_x", ".x", None):
        assert not publication.good_name(wrong)
    with pytest.raises(ValueError, match="two files"):
        publication.publish(make([("x", b"1"), ("x", b"2")]), root)
    with pytest.raises(ValueError, match="isn't complete"):
        publication.switch(spark, root, "nothing")
    (tmp_path / "site" / "sets" / second / "files" / "a" / "1.txt").write_bytes(b"other")
    (tmp_path / "site" / "sets" / second / "files" / "b" / "2.txt").unlink()
    assert sorted(map(tuple, publication.broken(spark, root).collect())) == [("a/1.txt", "changed"), ("b/2.txt", "missing")]
    publication.publish(make([]), root)
    assert contents(spark, root) == {}


def test_text_files(spark, tmp_path):
    path = str(tmp_path / "deep" / "summary.json")
    assert publication.read_text(spark, path) is None
    for text in ("one", "zwei ñ\n", ""):
        publication.write_text(spark, path, text)
        assert (tmp_path / "deep" / "summary.json").read_text() == text
    assert {p.name.lstrip(".").removesuffix(".crc") for p in (tmp_path / "deep").iterdir()} == {"summary.json"}


def test_listing(spark, tmp_path):
    import os

    for i, (name, when) in enumerate({"m1/text/0001.json": 100, "m1/text/0001.png": 100, "m1/text/12.json": 300, "m1/box/0003.json": 300, "m1/box/0004.png": 50, "m1/box/x5.json": 900, "m2/text/0001.json": 200, "m2/text/0001.old.json": 950, "m2/text/note": 990}.items()):
        p = tmp_path / "run" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f'{{"case": {i}}}')
        os.utime(p, (when, when))
    found = listing.by_folders(listing.files(spark, str(tmp_path / "run")), "model", "setting")
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    done = listing.numeric(found)
    assert sorted((r["model"], r["setting"], r["stem"]) for r in done.collect()) == [("m1", "box", "0003"), ("m1", "text", "0001"), ("m1", "text", "12"), ("m2", "text", "0001")]
    assert {r["stem"] for r in listing.numeric(found, pattern=listing.FOUR_DIGITS).collect()} == {"0001", "0003"}
    assert [(r["model"], r["setting"], r["stem"], r["kind"]) for r in listing.paired(found).collect()] == [("m1", "text", "0001", "png")]
    grid = spark.createDataFrame([(m, s) for m in ("m1", "m2") for s in ("text", "box")], "model string, setting string")
    rows = {(r["model"], r["setting"]): r for r in listing.progress(done, grid, "model", "setting", per_key=3).collect()}
    assert {k: (r["done"], r["percent"]) for k, r in rows.items()} == {("m1", "text"): (2, 66.67), ("m1", "box"): (1, 33.33), ("m2", "text"): (1, 33.33), ("m2", "box"): (0, 0.0), (None, None): (4, 33.33)}
    assert rows["m1", "text"]["latest"].timestamp() == 300 and rows["m2", "box"]["latest"] is None
    last = listing.latest(done, "model", "setting", "stem")
    assert (last.first()["setting"], last.first()["stem"]) == ("box", "0003")
    assert listing.record_of(spark, last, "case long") == {"case": 3}
    assert listing.latest(done.filter("false")).isEmpty() and listing.record_of(spark, done.filter("false"), "case long") is None
    assert listing.progress_line(rows["m1", "text"].asDict(), "model", "setting").startswith("m1/text 2 done (66.67 %), latest 1970-01-01 00:05")
    assert listing.progress_line(rows[None, None].asDict(), "model", "setting").startswith("all 4 done")
