"""Instances of touching objects, case boards, grids, judging as a stream and publishing results, against plain versions."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brocade.constants import METHODS, SETTINGS
from brocade.operators import boards, joins, masks, runs
from brocade.operators.order import held
from brocade.plans import compare, instances
from brocade.queries import QUERIES
from brocade.sources import publication, writers
from brocade.streaming import judging


def as_runs(spark, arrays):
    return runs.from_pixels(spark.createDataFrame([(m, int(x), int(y)) for m, a in enumerate(arrays) for y, x in np.argwhere(a)], "mask long, x int, y int"))


def test_cuts_of_runs_and_pixels(spark):
    """The window version on runs and on pixels gives the cut that trying every line gives."""
    rng = np.random.default_rng(2)
    shapes = [rng.random((20, 24)) < 0.3 for _ in range(4)]
    shapes[0][:, 9:14] = False
    shapes[1][6:9] = False
    shapes.append(np.ones((3, 3), bool))
    want = {}
    for m, a in enumerate(shapes):
        tried = []
        for axis, place in ((0, np.nonzero(a)[1]), (1, np.nonzero(a)[0])):
            low, span = place.min(), place.max() - place.min() + 1
            n = np.bincount(place - low, minlength=span)
            for o in range(max(1, int(span * 0.15)), min(span - 1, int(span * 0.85))) if span >= 4 else ():
                left = n[:o].sum()
                if min(left, n.sum() - left) >= 0.12 * n.sum():
                    tried.append((n[o] / max(1.0, n.max()) + 0.18 * (abs(2 * left - n.sum()) / n.sum()), axis, low + o))
        if tried:
            want[m] = min(tried)[1:]
    r = as_runs(spark, shapes)
    assert {x["mask"]: (x["axis"], x["place"]) for x in masks.split_scan(runs.to_pixels(r)).collect()} == want and len(want) == 4
    parts = {(x["mask"], x["region"]): x["n"] for x in runs.split_parts(r).groupBy("mask", "region").agg(F.sum(F.col("x2") - F.col("x1")).alias("n")).collect()}
    pixels = {(x["mask"], x["region"]): x["count"] for x in masks.split_parts(runs.to_pixels(r)).groupBy("mask", "region").count().collect()}
    assert parts == pixels and len(parts) == 8


def test_instances_by_models(spark):
    """Detector and segmenter as functions: what they see and give, and all ways that regions come about."""
    shapes = [np.zeros((20, 30), bool) for _ in range(5)]
    for a in shapes[:4]:
        a[2:12, 1:10] = a[4:14, 10:25] = True
    shapes[4][3:7, 3:7] = True
    union = held(as_runs(spark, shapes))
    texts = [["a cup", "a dog"], ["a cup", " A CUP "], ["a cup", "a dog"], ["a cup", "a dog"], ["a cup", "a dog"]]
    cases = spark.createDataFrame([(m, q, "picture") for m, q in enumerate(texts)], "mask long, queries array<string>, picture string")
    left, right = [1.0, 2.0, 10.0, 12.0], [10.0, 4.0, 25.0, 14.0]

    def detector(rows):
        assert {"mask", "query", "text", "picture"} <= set(rows.columns)
        out = []
        for mask, query, text in zip(rows["mask"], rows["query"], rows["text"], strict=True):
            cup = text.strip().lower() == "a cup"
            own = [(0.5, left), (0.4, [1.5, 2.0, 10.0, 12.0]), (0.3, right)] if cup else [(0.6, right), (0.2, left), (0.9, [26.0, 15.0, 30.0, 20.0])]
            out.append([] if mask == 2 and query == 1 else own)
        return out

    def segmenter(rows):
        out = []
        for mask, boxes in zip(rows["mask"], rows["boxes"], strict=True):
            own = []
            for k, (x1, y1, x2, y2) in enumerate(boxes):
                a = np.zeros((20, 30), bool)
                if not (mask == 3 and k == 0):
                    a[int(y1) : int(y2), int(x1) : int(x2) + (2 if k == 0 else 0)] = True
                    if mask == 3:
                        a[:] = True
                own.append(([np.zeros((20, 30), bool), a], [0.1, 0.9]))
            out.append(own)
        return out

    found = instances.candidates(instances.detected(cases, detector), union, 30, 20)
    assert found.filter("place = 2 and query = 1 and mask in (0, 3)").isEmpty()  # a box beside the mask is no candidate
    boxes = held(instances.chosen(found, cases))
    picked = {r["mask"]: [b["box"] for b in r["boxes"]] for r in boxes.collect()}
    assert picked[0] == [left, right] and picked[1] == [left, right] and picked[2] == [] and picked[3] == [left, right]
    made = held(instances.segmented(cases, boxes, segmenter))
    assert {r["selected"] for r in made.collect()} == {1}
    regions, ways = instances.regions(union, boxes, made.select("mask", "region", F.explode("runs").alias("r")).select("mask", "region", "r.y", "r.x1", "r.x2"))
    how = {r["mask"]: r["method"] for r in ways.collect()}
    assert how == {0: instances.BY_MODELS, 1: instances.BY_MODELS, 2: instances.BY_CUT, 3: instances.BY_CUT_AFTER, 4: how.get(4)}
    got = {}
    for r in regions.collect():
        a = got.setdefault(r["mask"], {}).setdefault(r["region"], np.zeros((20, 30), bool))
        assert not a[r["y"], r["x1"] : r["x2"]].any()
        a[r["y"], r["x1"] : r["x2"]] = True
    for m, own in got.items():
        assert set(own) == {1, 2} and not (own[1] & own[2]).any() and ((own[1] | own[2]) == shapes[m]).all()
    for m in (0, 1):
        assert got[m][1][2:12, 1:10].all() and got[m][2][4:14, 12:25].all()
    with pytest.raises(Exception, match="two queries"):
        instances.asked(spark.createDataFrame([(1, ["one"])], "mask long, queries array<string>")).collect()
    with pytest.raises(Exception, match="must answer every row"):
        instances.detected(cases, lambda rows: []).collect()


def test_masks_are_divided_in_one_sweep(spark):
    rng = np.random.default_rng(3)
    whole, seen = rng.random((6, 9, 14)) < 0.7, rng.random((6, 2, 9, 14)) < 0.4
    seen[0, 1], seen[1] = False, True
    boxes = {m: [sorted(rng.integers(0, 14, 2).tolist()) + sorted(rng.integers(0, 9, 2).tolist()) for _ in range(2)] for m in range(5)}  # the last mask has none
    pixel_runs = lambda a, *at: [(*at, int(y), int(x), int(x) + 1) for y, x in zip(*np.nonzero(a), strict=True)]
    union = spark.createDataFrame([r for m in range(5) for r in pixel_runs(whole[m], m)], "mask long, y int, x1 int, x2 int")
    made = spark.createDataFrame([r for m in range(6) for k in range(2) for r in pixel_runs(seen[m, k], m, k + 1)], "mask long, region int, y int, x1 int, x2 int")
    both = spark.createDataFrame([(m, [([float(a), float(c), float(b), float(d)],) for a, b, c, d in own]) for m, own in boxes.items()], "mask long, boxes array<struct<box:array<double>>>")
    rows = instances.divided(union, made, both)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2  # run ends by mask, boxes by mask
    got = np.zeros((6, 9, 14), int)
    for r in rows.collect():
        assert not got[r["mask"], r["y"], r["x1"] : r["x2"]].any() and r["x1"] < r["x2"]
        got[r["mask"], r["y"], r["x1"] : r["x2"]] = r["region"]
    for m, own in boxes.items():
        for y, x in zip(*np.nonzero(whole[m]), strict=True):
            far = [((x - (a + b) / 2) / max(1, b - a)) ** 2 + ((y - (c + d) / 2) / max(1, d - c)) ** 2 for a, b, c, d in own]
            alone = seen[m, :, y, x].sum() == 1
            assert got[m, y, x] == (seen[m, :, y, x].argmax() if alone else int(far[1] < far[0])) + 1
    assert ((got > 0) == whole * (np.arange(6) < 5)[:, None, None]).all()


def test_all_ways_occur(spark):
    ways = {r["method"] for r in QUERIES["instance_regions"](spark, "/root/testdata/sf0.001").select("method").distinct().collect()}
    assert ways == {instances.BY_MODELS, instances.BY_CUT, instances.BY_CUT_AFTER}


def record_rows(spark, rows):
    return spark.createDataFrame(rows, "eval_index long, method string, setting string, line long, status string, edit int, preservation int, quality int")


def test_boards(spark, tmp_path):
    cases = spark.createDataFrame([(i, f"case {i}") for i in range(45)], "eval_index long, case_id string")
    rows = [(i, m, s, 10 * j + k, "ok", j % 5, 3, 3) for i in range(0, 45, 2) for j, m in enumerate(METHODS) for k, s in enumerate(SETTINGS) if (i + j) % 3] + [(0, "beta", "text_only", 1, "late", None, None, None), (99, "alpha", "text_only", 0, "ok", 1, 1, 1), (1, "nobody", "text_only", 0, "ok", 1, 1, 1)]
    shown = boards.boards(cases, record_rows(spark, rows), per_page=20)
    got = {r["eval_index"]: r for r in shown.collect()}
    assert set(got) == set(range(45)) and got[44]["page"] == 2 and got[3]["case"]["case_id"] == "case 3"
    first = {}
    for i, m, s, line, status, *_ in rows:
        if (i, m, s) not in first or line < first[i, m, s][0]:
            first[i, m, s] = (line, status)
    for i, r in got.items():
        want = [first.get((i, m, s), (None, "pending"))[1] for m in METHODS for s in SETTINGS]
        assert [c["status"] for c in r["cells"]] == want and r["absent"] == want.count("pending")
        assert [(c["method"], c["setting"]) for c in r["cells"]] == [(m, s) for m in METHODS for s in SETTINGS]
    assert got[0]["cells"][4]["status"] == "late"
    assert sorted(map(tuple, boards.pages(shown).select("page", "first", "last", "cases").collect())) == [(0, 0, 19, 20), (1, 20, 39, 20), (2, 40, 44, 5)]
    plan = shown._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    boards.write_pages(shown, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages/page=1")).count() == 20
    assert {(r["rank"], r["rows"]) for r in boards.shard_balance(cases.filter("eval_index < 2"), 4, 1).collect()} == {(0, 0), (1, 1), (2, 1), (3, 0)}


def test_grids(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "eval_index long")
    rows = [(1, "a", "x", 2, "ok", 1, 1, 1), (1, "a", "x", 1, "late", 1, 1, 1), (2, "b", "y", 1, "ok", 1, 1, 1), (2, "c", "x", 1, "ok", 1, 1, 1), (9, "a", "x", 1, "ok", 1, 1, 1), (9, "a", "x", 2, "ok", 1, 1, 1)]
    r = record_rows(spark, rows)
    full = joins.filled_grid(cases, r, F.min_by("status", "line"), "status", F.lit("pending"), ("a", "b"), ("x", "y"))
    assert {tuple(x) for x in full.collect()} == {(i, m, s, {(1, "a", "x"): "late", (2, "b", "y"): "ok"}.get((i, m, s), "pending")) for i in (1, 2, 3) for m in "ab" for s in "xy"}
    wrong = {tuple(x) for x in joins.grid_errors(cases, r, ("a", "b"), ("x", "y")).collect()}
    missing = {(i, m, s, "missing") for i in (1, 2, 3) for m in "ab" for s in "xy"} - {(1, "a", "x", "missing"), (2, "b", "y", "missing")}
    assert wrong == missing | {(1, "a", "x", "duplicate"), (2, "c", "x", "unexpected"), (9, "a", "x", "unexpected")}
    assert wrong == {tuple(x) for x in joins.coverage_errors(joins.expected_jobs(cases, ("a", "b"), ("x", "y")), r, "eval_index", "method", "setting").collect()}


GOOD = json.dumps({a: 3 for a in ("edit", "preservation", "quality")} | {f"{a}_evidence": "seen" for a in ("edit", "preservation", "quality")})


def put(spark, folder, rows):
    at = dt.datetime(2026, 1, 1)
    data = [(k, at + dt.timedelta(minutes=m), i, t, r) for i, (k, m, t, r) in enumerate(rows)]
    spark.createDataFrame(data, judging.REPLY).coalesce(1).write.mode("append").parquet(folder)


def told(spark, path):
    return sorted((r["key"], r["event"], r["status"], r["attempts"], r["edit"]) for r in spark.read.schema(judging.OUTCOME).parquet(path).collect())


@pytest.mark.filterwarnings("ignore")
def test_judging_restarts(spark, tmp_path):
    """Whether replies come at once or with stops between: the same final rows, each key once."""
    early = [("a", 0, GOOD, "stop"), ("b", 0, "nothing", "stop"), ("c", 0, GOOD, "length"), ("d", 0, "{}", "stop"), ("d", 1, "[]", "stop"), ("d", 2, GOOD, "stop"), ("e", 0, "bad", "stop")]
    late = [("a", 5, GOOD, "stop"), ("b", 5, "```json\n" + GOOD + "\n```", "stop"), ("c", 5, "still not", "stop"), ("f", 6, GOOD, "stop")]
    want = {("a", "ok", 1), ("b", "ok", 2), ("c", "judge_parse_error", 2), ("d", "judge_parse_error", 2), ("f", "ok", 1)}
    one = str(tmp_path / "one")
    put(spark, f"{one}/in", early)
    judging.run_available(spark, f"{one}/in", f"{one}/out", f"{one}/check")
    first = told(spark, f"{one}/out")
    assert [(k, e) for k, e, *_ in first] == [("a", "final"), ("b", "retry"), ("c", "retry"), ("d", "final"), ("d", "retry"), ("e", "retry")]
    judging.run_available(spark, f"{one}/in", f"{one}/out", f"{one}/check")  # nothing new: nothing more
    assert told(spark, f"{one}/out") == first
    put(spark, f"{one}/in", late)
    judging.run_available(spark, f"{one}/in", f"{one}/out", f"{one}/check")
    assert {(r["key"], r["status"], r["attempts"]) for r in judging.finals(spark, f"{one}/out").collect()} == want
    two = str(tmp_path / "two")
    put(spark, f"{two}/in", early + late)
    judging.run_available(spark, f"{two}/in", f"{two}/out", f"{two}/check")
    assert told(spark, f"{two}/out") == told(spark, f"{one}/out")
    # hours later the key that never got its second reply is given up
    put(spark, f"{one}/in", [("z", 600, GOOD, "stop")])
    judging.run_available(spark, f"{one}/in", f"{one}/out", f"{one}/check")
    put(spark, f"{one}/in", [("y", 1200, GOOD, "stop")])
    judging.run_available(spark, f"{one}/in", f"{one}/out", f"{one}/check")
    finals = [(r["key"], r["status"], r["error"]) for r in judging.finals(spark, f"{one}/out").collect()]
    assert ("e", "judge_runtime_error", "no reply") in finals and len({k for k, *_ in finals}) == len(finals)


def test_published_comparison(spark, tmp_path):
    root = str(tmp_path / "site")
    rows = [(i, m, s, "v", i, "ok", 4, 4, 4, True, True) for i in range(3) for m in ("alpha", "beta") for s in ("t", "b")]
    records = spark.createDataFrame(rows, "eval_index long, method string, setting string, variant string, line long, status string, edit int, preservation int, quality int, all_edits_success boolean, strict_success boolean")
    figure = spark.createDataFrame([("figures/a.png", bytearray(b"1"))], publication.FILE)
    compare.publish(records, root, 2, 3, 2, figure)
    got = {r["name"]: bytes(r["content"]).decode() for r in publication.contents(spark, root).collect()}
    assert set(got) == {"summary.json", "summary.md", "figures/a.png"} and json.loads(got["summary.json"])["beta"]["n"] == 6 and got["summary.md"].startswith("| method |")
    with pytest.raises(ValueError, match="not complete"):
        compare.publish(records.filter("eval_index > 0"), root, 2, 3, 2)
    assert set(r["name"] for r in publication.manifest(spark, root).collect()) == set(got)
    compare.publish(records, root, 2, 3, 2)
    assert {r["name"] for r in publication.manifest(spark, root).collect()} == {"summary.json", "summary.md"}
    source = tmp_path / "three"
    source.mkdir()
    for n in "abc":
        (source / f"{n}.json").write_text(n)
    publication.copy_files(spark, [str(source / f"{n}.json") for n in "abc"], str(tmp_path / "copy"))
    assert {r["name"] for r in publication.manifest(spark, str(tmp_path / "copy")).collect()} == {"a.json", "b.json", "c.json"}


def test_error_log(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    for run in ("r1", "r2"):
        writers.append_outcomes(spark.createDataFrame([(run, i, "broke" if i % 3 == 0 else None) for i in range(6)], "run_id string, i int, error string"), path)
    log = writers.error_log(spark, path, "r2")
    assert sorted(r["i"] for r in log.collect()) == [0, 3] and writers.error_log(spark, path).count() == 4
    assert all("failed=true" in f for f in log.inputFiles()) or "PartitionFilters: [isnotnull(failed" in log._jdf.queryExecution().executedPlan().toString()
