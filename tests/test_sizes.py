"""Mask operators on large tables: how often rows are dealt, and the same results as by pixel tables."""

import numpy as np
from pyspark.sql import functions as F

from brocade.operators import joins, masks, runs
from brocade.sources.derived import polygons, shape_runs

SF = "/root/testdata/sf0.001"
RUN = "mask long, y int, x1 int, x2 int"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def made(spark, seed=3):
    rng = np.random.default_rng(seed)
    stack = rng.random((12, 20, 30)) < rng.choice([0.02, 0.2, 0.7], 12)[:, None, None]
    stack[0] = False
    stack[0, 2:5, 3] = True  # too narrow for one axis
    stack[1] = False
    stack[1, 1, 1] = True
    pixels = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(stack)], "mask long, y int, x int")
    return stack, pixels.select("mask", "x", "y")


def test_runs_that_are_dealt_by_mask_stay(spark):
    own = runs.merged(shape_runs(spark, SF), by_mask=True)
    assert plan(own).count("Exchange") == 1
    for one, other in ((own, runs.merged(shape_runs(spark, SF))), (runs.dilated(own, 64, 48, 0.0625, by_mask=True), runs.dilated(own, 64, 48, 0.0625))):
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    size = (F.lit(64), F.lit(48), F.lit(20), F.lit(90))
    for grown in (runs.dilated(own, 64, 48, 0.0625, by_mask=True), runs.resized(own, *size, by_mask=True), runs.boxes(own)):
        assert plan(grown).count("Exchange") == 1


def test_ends_of_a_union_are_summed_before_they_meet(spark):
    rows = [(k, y, x, x + 1 + k % 4) for k in range(40) for y in (0, 1) for x in range(k % 3, 30, 3)] + [(1, 5, 4, 4), (2, 6, 3, 5), (9, 6, 5, 8), (4, 7, 1, 2)]
    parts = spark.createDataFrame(rows, RUN).withColumn("whole", F.col("mask") % 7)
    got = runs.union(parts)
    want = runs.merged(parts.select(F.col("whole").alias("mask"), "y", "x1", "x2"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    text = plan(got)
    assert "partial_sum" in text and text.index("Exchange") < text.index("partial_sum")  # plans go from the end: summed below the exchange


def test_difference_reads_each_table_once(spark):
    a = spark.createDataFrame([(1, 0, 2, 5), (1, 0, 4, 9), (2, 1, 3, 3), (3, 0, 0, 4), (4, 2, 1, 2), (5, 1, 6, 2)], RUN)
    b = spark.createDataFrame([(1, 0, 3, 8), (3, 0, 0, 2), (3, 0, 2, 4), (6, 0, 1, 4)], RUN)
    assert sorted(map(tuple, runs.difference(a, b).collect())) == [(1, 2), (2, 0), (3, 0), (4, 1), (5, 0), (6, 3)]
    text = plan(runs.difference(a, b))
    assert "Join" not in text and text.count("Exchange") == 1


def test_polygons_are_dealt_before_they_become_edges(spark):
    assert polygons(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cuts_in_the_stack(spark):
    _, pixels = made(spark)
    got, want = masks.splits(pixels, 30, 20), masks.split_scan(pixels).select("mask", "axis", "place", "score")
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in plan(got)


def test_partition_in_the_stack(spark):
    _, pixels = made(spark, 8)
    rng = np.random.default_rng(2)
    seen = [(m, r, int(x), int(y)) for m in range(12) for r in (1, 2) for y, x in rng.integers(0, (20, 30), (150, 2))]
    instances = spark.createDataFrame(sorted(set(seen)), "mask long, region int, x int, y int")
    rows = [(m, 1, 0, 0, 2 + m, 20) for m in range(12)] + [(m, 2, 14 - m, 1, 30, 7) for m in range(10)]  # two masks have one box
    boxes = spark.createDataFrame(rows, "mask long, region int, x1 int, y1 int, x2 int, y2 int")
    got = runs.to_pixels(masks.partitioned(pixels, instances, boxes, 30, 20).select(F.struct("mask", "region").alias("mask"), "y", "x1", "x2")).select("mask.mask", "mask.region", "x", "y")
    want = masks.whole_parts(joins.partition(pixels, instances, boxes), pixels).select("mask", "region", "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pictures_are_dealt_before_they_are_made(spark):
    from brocade.queries import QUERIES

    assert "REPARTITION_BY_NUM" in plan(QUERIES["aligned_sources"](spark, SF))


def test_masks_of_cases_are_never_broadcast(spark):
    from brocade.queries import QUERIES

    for name in ("run_coverage", "instance_boxes", "instance_regions", "instance_partition"):
        assert "Broadcast" not in plan(QUERIES[name](spark, SF)), name


def test_cases_are_dealt_as_numbers(spark):
    from brocade.queries import QUERIES

    made = plan(QUERIES["job_keys"](spark, SF))
    assert made.count("Exchange") == 1 and "case-" not in made[made.index("Exchange") :]  # plans go from the end: texts are made above the exchange


def test_difference_of_runs_that_overlap(spark):
    rng = np.random.default_rng(7)
    sides = [[(int(m), int(y), int(x), int(x + n)) for m, y, x, n in zip(rng.integers(0, 9, 150), rng.integers(0, 3, 150), rng.integers(0, 40, 150), rng.integers(-2, 12, 150), strict=True)] for _ in range(2)]
    pixels = [{(m, y, x) for m, y, x1, x2 in side for x in range(x1, x2)} for side in sides]
    got = runs.difference(*[spark.createDataFrame(side, RUN) for side in sides])
    assert {r["mask"]: r["mismatched"] for r in got.collect()} == {m: sum(p[0] == m for p in pixels[0] ^ pixels[1]) for m in range(9)}
    dealt = [runs.merged(shape_runs(spark, SF), by_mask=True).filter(c) for c in ("x1 > 3", "y > 5")]
    text = plan(runs.difference(*dealt))
    assert text.count("Exchange") == 2 and "Generate explode(array" not in text  # both tables are dealt by mask, and stay where they are
