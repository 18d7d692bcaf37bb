"""Selection and generation on invented rows."""

import pytest
from pyspark.sql import functions as F

from brocade.operators import audit
from brocade.plans import generate, select


def test_selection(spark):
    rows = spark.createDataFrame([("c1", "i1", "move the cat, and lift it, and turn it, and paint it, and stop")], "case_id string, image string, instruction string")
    crops = spark.createDataFrame([("i1", k, f"Add {k}.") for k in (3, 1, 2, 5, 4)], "image string, place int, edit string")
    joined = select.with_crops(rows, crops)
    picks = spark.createDataFrame([("c1", [1, 4])], "case_id string, picks array<int>")
    r = select.selected(joined, picks).first()
    assert r["located"] == "Move the cat, and paint it." and r["regional"] == "For {region_1}, add 1. For {region_2}, add 4."
    assert r["operation"] == "add" and r["region_count"] == 2
    with pytest.raises(Exception, match="4 crops"):
        select.with_crops(rows, crops.filter("place < 5")).collect()
    with pytest.raises(Exception, match="different picks"):
        select.selected(joined, spark.createDataFrame([("c1", [2, 2])], "case_id string, picks array<int>")).collect()
    assert select.unmatched(rows, picks.withColumn("case_id", F.lit("c2"))).count() == 2
    with pytest.raises(Exception, match="repeated case"):
        select.unified(rows, rows).collect()


def test_generation(spark):
    todo = spark.createDataFrame([(i, f"c{i}", "text_only", "p", ["a"], "m", 4, 4) for i in range(3)], "eval_index long, case_id string, setting string, prompt string, images array<string>, manifest_hash string, width int, height int")

    def edit(row):
        if row["eval_index"] == 1:
            raise RuntimeError("no memory")
        return b"png", 4, 4 if row["eval_index"] == 0 else 5

    got = generate.generated(todo, edit)
    errors = {r["eval_index"]: r["error"] for r in got.collect()}
    assert errors == {0: None, 1: "RuntimeError: no memory", 2: "size 4x5"}
    assert sorted(r["eval_index"] for r in generate.remaining(todo, got).collect()) == [1, 2]
    assert generate.remaining(todo.withColumn("prompt", F.lit("q")), got).count() == 3
    assert {tuple(r) for r in generate.mismatches(got.filter("eval_index = 0"), todo.withColumn("prompt", F.lit("q"))).collect()} == {(0, "text_only", "prompt"), (1, "text_only", "missing"), (2, "text_only", "missing")}
    config = generate.run_settings([3, 4, 5], {"seed": 0})
    assert config["contiguous"] and not generate.run_settings([3, 5], {})["contiguous"]
    with pytest.raises(ValueError):
        generate.same_run(config, config | {"seed": 1})
    generate.same_run(config, config | {"seed": 1}, but=["seed"])


def test_planning(spark):
    todo = spark.createDataFrame([(i, f"c{i}", "text_only", f"p{i}", ["a"]) for i in range(4)], "eval_index long, case_id string, setting string, prompt string, images array<string>")

    def plan(row):
        if row["eval_index"] == 1:
            raise RuntimeError("no memory")
        return {"reply": "<gen>" if row["eval_index"] != 2 else " ", "regions": [{"box": [0.0, 0.0, 2.0, 2.0], "hint": "h"}] if row["eval_index"] != 3 else [{"box": [0.0, 0.0, 0.0, 2.0], "hint": "h"}], "guidance": "g"}

    got = generate.planned(todo, plan)
    assert {r["eval_index"]: r["error"] for r in got.collect()} == {0: None, 1: "RuntimeError: no memory", 2: None, 3: None}
    found = {(r["eval_index"], r["rule"]) for r in generate.unsound_plans(got.filter("eval_index < 4"), todo.union(todo.limit(1).selectExpr("9", "'c9'", "setting", "prompt", "images"))).collect()}
    assert found == {(1, "error"), (1, "reply"), (1, "regions"), (2, "reply"), (3, "regions"), (9, "missing")}


def test_settings_and_dry_run(spark):
    from brocade.plans import judge, prepare

    assert [s["prompt"] for s in prepare.settings_for("alpha", "text_only,box_annotation")] == ["with_location_reference", "region_only"]
    with pytest.raises(ValueError, match="unknown method"):
        prepare.settings_for("nobody")
    jobs = spark.createDataFrame([("a", None, "judge this", "s", "o"), ("b", "missing_output", None, None, None)], "key string, status string, prompt string, source_image string, output_image string")
    assert [(r["key"], r["characters"], len(r["messages"])) for r in judge.dry_run(jobs).collect()] == [("a", 10, 5)]
    with pytest.raises(Exception, match="without prompt"):
        judge.dry_run(jobs.withColumn("status", F.lit(None).cast("string"))).collect()


def test_appending_twice(spark, tmp_path):
    from brocade.sources import writers
    from brocade.streaming import ingest

    rows = spark.createDataFrame([("a", "r"), ("b", "r"), ("a", "r")], "key string, run_id string")
    path = str(tmp_path / "records")
    for _ in range(2):
        writers.append_new(rows, path)
    assert spark.read.parquet(path).count() == 2
    writers.append_new(rows.withColumn("key", F.lit("c")), path)
    assert sorted(r["key"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    good, bad = writers.split_errors(rows.withColumn("error", F.when(F.col("key") == "b", "x")))
    assert (good.count(), bad.count()) == (2, 1)
    assert writers.markdown_table([{"a": 0.12345, "b": None}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 0.123 |  |\n"
    assert {(r["method"], r["done"]) for r in ingest.running_counts(rows.selectExpr("key as method", "run_id as setting")).collect()} == {("a", 2), ("b", 1)}


def test_publication_gate(spark):
    from brocade.plans import compare

    records = spark.createDataFrame([(m, i, s, "ok" if i else "annotation_conflict", "p1") for m in ("alpha", "beta") for i in range(3) for s in ("t", "b")], "method string, eval_index int, setting string, status string, protocol string")
    compare.complete(records, 2, 3, 2)
    compare.one_protocol(records, "p1")
    for wrong in (records.filter("eval_index < 2 or method = 'beta'"), records.withColumn("status", F.lit("pending")), records.union(records.limit(1))):
        with pytest.raises(ValueError):
            compare.complete(wrong, 2, 3, 2)
    with pytest.raises(ValueError):
        compare.one_protocol(records.withColumn("protocol", F.when(F.col("eval_index") == 1, None).otherwise("p1")), "p1")


def test_audit(spark):
    rows = spark.createDataFrame([(1, "s", [([10.0, 150.0, 150.0, 210.0], "a"), ([1.0, float("nan"), 2.0, 3.0], "b"), ([5.0, 5.0, 4.0, 9.0], "c"), ([0.0, 0.0, 1.0, 1.0], " ")])], "eval_index long, setting string, regions array<struct<box:array<double>,hint:string>>")
    r = audit.planner_audit(rows, [(10, 150, 150, 210)]).first()
    assert (r["scanned"], r["records"], r["cases"], r["case_settings"], r["usable_regions"]) == (1, 1, 1, 1, 1)
    assert audit.index_gaps(spark.createDataFrame([(0,), (2,)], "eval_index long")).first()["gap_free"] is False
