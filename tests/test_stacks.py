"""Kernels on stacks of masks against the same on one mask; what large tables of masks need."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brocade.functions import geometry
from brocade.operators import masks, runs
from brocade.sources.derived import shape_runs, shapes

SF = "/root/testdata/sf0.001"


def test_stacks():
    rng = np.random.default_rng(5)
    for h, w, share in ((12, 15, 0.45), (9, 20, 0.2), (30, 40, 0.6), (130, 130, 0.55), (1, 7, 0.5)):
        stack = rng.random((8, h, w)) < share
        stack[0] = False
        stack[1] = True
        stack[2] = False
        stack[2, : h // 2, : w // 3] = stack[2, : h // 2, w - w // 3 :] = stack[2, h - 1, w // 2] = True  # two objects and a stray pixel
        mask, y, x1, x2, name = masks.stack_runs(stack)
        for n, own in enumerate(stack):
            label, here = masks.label_components(own), mask == n
            assert label[y[here], x1[here]].tolist() == (np.unique(name[here], return_inverse=True)[1] + 1).tolist()
            assert (x2 - x1)[here].sum() == own.sum()
        x, y = masks.stack_innermost(stack)
        assert list(zip(x.tolist(), y.tolist(), strict=True)) == [masks.innermost(m) for m in stack]
        got = masks.stack_regions(stack, True, False)
        for m, of in zip(stack, got, strict=True):
            try:
                want = masks.regions_of(m, True)
            except ValueError:
                want = []
            assert of.max() == len(want) and all(((of == k) == p).all() for k, p in enumerate(want, 1))
        assert (masks.dilate(stack, 2) == np.stack([masks.dilate(m, 2) for m in stack])).all()
    with pytest.raises(ValueError, match="components"):
        masks.stack_regions(stack & False, True, True)


def test_pixels_beyond_the_canvas(spark):
    given = spark.createDataFrame([(1, 3, 2), (1, 9, 1)], "mask long, x int, y int")
    with pytest.raises(Exception, match="beyond the canvas"):
        masks.components(given, 8, 8).collect()


def test_shapes_are_not_shuffled(spark):
    # a pixel comes from one rectangle only, so the pixels themselves needn't meet
    plan = shapes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    pixels = shapes(spark, SF)
    assert pixels.count() == pixels.distinct().count()
    other = runs.to_pixels(shape_runs(spark, SF)).select("mask", "x", "y")
    assert pixels.exceptAll(other).isEmpty() and other.exceptAll(pixels).isEmpty()


def test_masks_are_never_broadcast(spark):
    boxed = shapes(spark, SF).select("mask").distinct().select("mask", *[F.lit(v).alias(c) for c, v in (("bx1", 1.0), ("by1", 1.0), ("bx2", 9.0), ("by2", 9.0))])
    plan = runs.coverage(runs.merged(shape_runs(spark, SF)), boxed, 64, 48)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_contiguous_over_a_wide_span(spark):
    rows = [(1, [4, 5, 6]), (2, [0, 10**15]), (3, [7]), (4, [1, 2, 4]), (5, [1, 3, 2, 4]), (6, [3, 2, 1])]
    got = spark.createDataFrame(rows, "k int, i array<long>").select("k", geometry.contiguous(F.col("i")).alias("c"))
    assert {r["k"]: r["c"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_jobs_meet_their_outputs_by_case(spark):
    from brocade.plans import judge

    cases = spark.createDataFrame([(i, f"case-{i}") for i in range(3)], "eval_index long, case_id string")
    outputs = spark.createDataFrame([(1, "alpha", "text_only"), (1, "alpha", "text_only"), (2, None, "text_only"), (9, "beta", "text_only")], "eval_index long, method string, setting string")
    got = judge.jobs(cases, outputs, "run", conflicts=cases.filter("eval_index = 2"))
    assert got.count() == 60 and [tuple(r) for r in got.filter("status is null").select("eval_index", "method", "setting").collect()] == [(1, "alpha", "text_only")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # jobs are made above the joins


def test_stems_of_more_than_four_digits(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1000, "a"), (10000, "b"), (3, "c"), (10001, "d")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    found = entry.queries()["finished_pairs"](spark, str(tmp_path)).collect()
    assert sorted(r["stem"] for r in found) == ["1000", "1000", "1000"]
    assert entry.queries()["published_records"](spark, str(tmp_path)).count() == 3
    assert entry.queries()["progress_by_files"](spark, str(tmp_path)).filter("method is null").first()["done"] == 3


def test_pairs_read_the_listing_once(spark, tmp_path):
    from brocade.sources import listing

    (tmp_path / "a").mkdir()
    for name in ("a/1.png", "a/1.json", "a/2.png", "a/3.json", "1.json", "2.png"):
        (tmp_path / name).write_text("x")
    got = listing.paired(listing.files(spark, str(tmp_path)))
    assert [(r["path"].rsplit("/", 2)[1], r["stem"], r["kind"]) for r in got.collect()] == [("a", "1", "png")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1


def test_sets_are_written_by_all_tasks(spark, tmp_path):
    from brocade.sources import publication

    root = str(tmp_path / "set")
    rows = spark.range(200, numPartitions=1).selectExpr("concat('f', id) AS name", "cast(id AS string) AS content")
    version = publication.publish(rows, root)
    done = publication.json.loads(publication.read_text(spark, f"{root}/sets/{version}/committed.json"))
    assert done["files"] == 200 == publication.manifest(spark, root).count() and len(done["parts"]) == 4
    assert publication.broken(spark, root).isEmpty()


def test_prepared_names_hold_the_whole_number(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(p, f"name {p}", "Brand#1") for p in (7, 12, 1206, 12066)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    found = {r["images"].split(",")[0] for r in entry.queries()["prepared_inputs"](spark, str(tmp_path)).collect()}
    assert "source/12066.png" in found and "source/0012.png" in found
    assert "greatest(4, length(mask::VARCHAR))" in entry.oracle_sql()["prepared_inputs"]


def test_layers_painted_by_step():
    from brocade.functions.resampling import over
    from brocade.operators.pictures import paint

    rng = np.random.default_rng(1)
    for n in range(20):
        a, b = np.sort(rng.integers(0, 12, (2, 30)), axis=0)
        layers = np.column_stack([np.sort(rng.integers(0, 4, 30)), rng.integers(0, 9, 30), a, b, rng.integers(0, 2, (30, 3)) * 200, np.where(rng.random(30) < 0.5, 255, 90)])
        out = np.full((9, 11, 3), 120, np.uint8)
        want = out.copy()
        for _, y, x1, x2, *colour, opacity in layers.tolist():
            want[y, x1:x2] = over(np.array(colour), np.array(opacity), want[y, x1:x2])
        paint(out, layers)
        assert (out == want).all(), n
