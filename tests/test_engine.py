"""Success logic, texts, geometry, records, summaries and plans on small invented rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brocade.functions import geometry, logic, records, text
from brocade.operators import joins, masks, order, summary, validate
from brocade.plans import compare, judge, prepare
from brocade.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit_scores(e, p, q):
    return [F.lit(x).cast("int") for x in (e, p, q)]


@pytest.mark.parametrize("scores,all_edits,strict", [((4, 2, 4), True, False), ((None, 4, 4), None, None), ((4, None, 4), True, None), ((0, None, 4), False, False), ((4, 3, 3), True, True)])
def test_success(spark, scores, all_edits, strict):
    s = lit_scores(*scores)
    assert one(spark, logic.all_edits(s[0])) is all_edits
    assert one(spark, logic.strict(*s)) is strict
    assert one(spark, logic.strict_or_false(*s)) is bool(strict)


def test_conjunction(spark):
    arr = lambda *v: F.array(*[F.lit(x).cast("boolean") for x in v]) if v else F.array().cast("array<boolean>")
    assert one(spark, logic.conjunction(arr(True, None))) is None
    assert one(spark, logic.conjunction(arr(None, False))) is False
    assert one(spark, logic.conjunction(arr())) is True


def rows(spark, values):
    df = spark.createDataFrame(values, "eval_index long, method string, setting string, variant string, line long, status string, edit int, preservation int, quality int")
    axes = [F.col(a) for a in ("edit", "preservation", "quality")]
    return df.withColumn("all_edits_success", logic.all_edits(axes[0])).withColumn("strict_success", logic.strict(*axes))


def test_bounds(spark):
    data = [(1, "alpha", "text_only", "a", i, s, *v) for i, (s, v) in enumerate([("missing_output", (None,) * 3), ("judge_parse_error", (None,) * 3), ("pending", (None,) * 3), ("ok", (4, 4, 4))])]
    r = summary.summarize(rows(spark, data), "method").first()
    assert (r["all_edits_success_success"], r["all_edits_success_failure"], r["all_edits_success_unknown"]) == (1, 1, 2)
    assert (r["all_edits_success_lower"], r["all_edits_success_upper"]) == (0.25, 0.75)
    assert r["edit_mean"] == 4.0 and r["edit_unknown"] == 3


def test_cohort_and_intervals(spark):
    data = [(i, m, s, "a", 1, "ok", 4, 4, 4) for i, m, s in ((1, "alpha", "text_only"), (1, "beta", "text_only"), (2, "alpha", "text_only"))]
    assert set(compare.cohorts(rows(spark, data))) == {"all", "common"}
    assert compare.cohorts(rows(spark, data))["common"].count() == 2
    single = [(1, "alpha", s, "a", 1, "ok", 4, 4, 4) for s in ("text_only", "mask_annotation")]
    r = summary.bootstrap(rows(spark, single), "method").filter("axis = 'edit'").first()
    assert (r["low"], r["high"], r["cases"]) == (4.0, 4.0, 1)
    many = [(i, "alpha", "text_only", "a", 1, "ok", i % 5, 3, 3) for i in range(100)]
    four = [(i, "alpha", s, "a", 1, "ok", i % 5, 3, 3) for i in range(100) for s in ("text_only", "mask_annotation", "box_annotation", "point_annotation")]
    low = [summary.bootstrap(rows(spark, d), "method").filter("axis = 'edit'").select("low", "high").first() for d in (many, four)]
    assert low[0] == low[1]


def test_tiers(spark):
    def case(i, score):
        return [(i, m, s, "a", 1, "ok", *score(m, s)) for m in ("alpha", "beta") for s in ("text_only", "mask_annotation")]

    data = case(1, lambda m, s: (1, 4, 4)) + case(2, lambda m, s: (4, 4, 4) if m == "alpha" else (0, 4, 4)) + case(3, lambda m, s: (None, 4, 4))
    found = summary.failure_tiers(summary.case_summary(rows(spark, data)), complete=4, many=2)
    got = {}
    for r in found.collect():
        got.setdefault(r["tier"], set()).add(r["eval_index"])
    assert got["edit_at_most_1"] == {1} and got["no_strict_success"] == {1} and got["strict_in_few_methods"] == {2} and "strict_in_one_setting" not in got and got["concentrated"] == {2}
    assert 3 not in set().union(*got.values())


def test_coverage_and_resume(spark):
    want = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    have = spark.createDataFrame([(2,), (2,), (4,), (1,)], "k long")
    assert {tuple(r) for r in joins.coverage_errors(want, have, "k").collect()} == {(3, "missing"), (4, "unexpected"), (2, "duplicate")}
    assert [r["k"] for r in joins.unfinished(want, have, "k").collect()] == [3]
    with pytest.raises(ValueError):
        joins.pick_positions(want.withColumnRenamed("k", "eval_index"), [1, 1])


def test_texts(spark):
    assert one(spark, text.clean(F.lit(" a  b\n"))) == "a b"
    assert one(spark, text.clean(F.lit(" \t"))) is None
    joined = [one(spark, text.english_join(F.array(*[F.lit(x) for x in "abc"[:n]]))) for n in (1, 2, 3)]
    assert joined == ["a", "a and b", "a, b, and c"]
    assert one(spark, text.replacement_target(F.lit("Please REPLACE the cat with a red dog."))) == "a red dog"
    assert one(spark, text.replacement_target(F.lit("paint it"))) is None
    assert one(spark, text.sentence(F.lit("  move  it.. "))) == "Move it."
    assert one(spark, text.operation(F.lit(" Make it blue"))) == "replace"
    assert one(spark, text.placeholders_ordered(F.lit("{region_2} {region_1}"), F.lit(2))) is False
    assert one(spark, text.placeholders_complete(F.lit("{region_2} {region_1}"), F.lit(2))) is True
    box = one(spark, text.locator_prompt(F.lit("Move {region_1} to {region_2}"), F.lit(2), "box"))
    assert box == "Edit Image 1. Move R1 (red box) in Image 2 to R2 (green box) in Image 2 Keep everything else unchanged. Return only the edited Image 1 without any markers from Image 2."
    assert "the region marked by the red mask in Image 2" in one(spark, text.locator_prompt(F.lit("Remove {region_1}."), F.lit(1), "mask"))
    with pytest.raises(Exception, match="placeholder left"):
        one(spark, text.locator_prompt(F.lit("{region_3}"), F.lit(2), "box"))
    assert one(spark, text.html_escape(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert prepare.settings_of(" box_annotation, text_only,box_annotation ") == ["box_annotation", "text_only"]
    with pytest.raises(ValueError):
        prepare.settings_of("nope")


def only(spark, kind, count, original="Add a cat.", caption="a cat", rewrite=None, reference=False):
    return one(spark, text.region_only_instruction(F.lit(kind), F.lit(count), F.lit(original), F.lit(caption), F.lit(rewrite).cast("string"), F.lit(reference)))


def test_region_only_instructions(spark):
    assert only(spark, "counting", 1) is None and only(spark, "remove", 1, reference=True) is None
    assert only(spark, "multi_object_remove", 2) == "Remove {region_1} and {region_2}."
    assert only(spark, "add", 1, "  add a  cat..") == "Use {region_1} as the exact placement region. Add a cat."
    assert only(spark, "add", 1, rewrite="Put it in {region_1}.") == "Put it in {region_1}."
    assert only(spark, "multi_object_add", 2, caption=" a cat | | a dog ") == "Add a cat in {region_1} and a dog in {region_2}."
    assert only(spark, "multi_object_add", 2, caption="a cat") == "Add a cat in {region_1} and a cat in {region_2}."
    assert only(spark, "replace", 1, "Swap the cat for a dog!") == "Replace {region_1} with a dog."
    assert only(spark, "replace", 1, "Better.", " a  dog|x ") == "Edit {region_1} to match this expected result: a dog|x."
    for bad, wanted in ((("mixed", 1), "no region-only"), (("add", 1, " "), "missing add"), (("multi_object_add", 2, "x", "a|b|c"), "captions and regions"), (("multi_object_add", 1, "x", " | "), "missing add target"), (("paint", 1), "unknown edit type")):
        with pytest.raises(Exception, match=wanted):
            only(spark, *bad)
    assert one(spark, text.local_content(F.lit("multi_object_add"), F.lit(" a | b "))) == "a; b" and one(spark, text.local_content(F.lit("add"), F.lit("a|b"))) == "a; b"
    rows = spark.createDataFrame([(1, True), (2, False)], "case_id long, needed boolean")
    table = spark.createDataFrame([(1, "x")], "case_id long, rewrite string")
    assert {(r["case_id"], r["rewrite"]) for r in text.rewritten_instruction(rows, table, F.col("needed")).collect()} == {(1, "x"), (2, None)}
    with pytest.raises(Exception, match="missing rewrite"):
        text.rewritten_instruction(rows, table, F.lit(True)).collect()


def test_paths(spark):
    assert one(spark, text.resolved(F.lit("a/b"), "/r/")) == "/r/a/b" and one(spark, text.resolved(F.lit("/x"), "/r")) == "/x"
    assert one(spark, text.relative(F.lit("/r/a/b"), "/r")) == "a/b"
    for outside in ("/q/a", "/r/../q", "/rr/a", "/r/a/.."):
        with pytest.raises(Exception, match="not below"):
            one(spark, text.relative(F.lit(outside), "/r"))
    r = one(spark, text.output_paths("/r", F.lit("alpha"), F.lit("text_only"), F.lit(7)))
    assert (r["image"], r["record"]) == ("/r/inference/alpha/text_only/0007.png", "/r/inference/alpha/text_only/0007.json")


def test_judge_prompt(spark):
    got = one(spark, text.judge_prompt("Rules.", F.lit('say "hi"\n'), F.lit(None).cast("string"), F.lit(2)))
    assert got == "Rules.\nTASK:\n" + json.dumps({"instruction": 'say "hi"\n', "region_instruction": None, "target_contours": ["R1 = red contour", "R2 = green contour"]}, ensure_ascii=False)


def test_geometry(spark):
    w, h = (one(spark, geometry.output_side(F.lit(a), F.lit(b))) for a, b in ((640, 480), (480, 640)))
    assert w % 32 == h % 32 == 0 and abs(w * h / 2**20 - 1) < 0.06 and abs(w / h - 4 / 3) < 0.05
    box = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, geometry.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, geometry.box_valid(box(0, 0, 5, 5), F.lit(5), F.lit(4))) is False
    assert one(spark, geometry.padded(box(1, 1, 9, 9), F.lit(9), F.lit(20))) == [0, 0, 9, 10]
    assert one(spark, geometry.padded(box(50, 60, 54, 400), F.lit(640), F.lit(480))) == [40, 50, 64, 410]  # by the canvas's short side
    assert one(spark, geometry.view_side(F.lit(100), F.lit(0.001))) == 1 and one(spark, geometry.view_side(F.lit(100), F.lit(1.0))) == 100
    assert one(spark, geometry.unwrapped(F.array(box(0.0, 1.0)))) == [0.0, 1.0]
    points = one(spark, geometry.polygon_points(F.array(*[F.lit(float(x)) for x in (0, 0, 2, 0, 2, 2)])))
    assert len(points) == 3 and points[1]["x"] == 2.0


def test_replies():
    good = {"edit": 4, "preservation": None, "quality": 3, "edit_evidence": "a", "preservation_evidence": "b", "quality_evidence": "c"}
    assert records.parse_reply("<think>x</think>\n```json\n" + json.dumps(good) + "\n```") == ({"edit": 4, "preservation": None, "quality": 3}, None)
    for change in ({"edit": "4"}, {"edit": True}, {"edit": 5}, {"edit": -1}, {"edit_evidence": " "}):
        assert records.parse_reply(json.dumps(good | change))[0] is None
    assert records.parse_reply(json.dumps({k: v for k, v in good.items() if k != "quality"}))[0] is None
    assert records.parse_reply(json.dumps(good) + " more")[0] is None and records.parse_reply(None)[0] is None


def small_jobs(spark):
    cases = spark.createDataFrame([(0, "c0"), (1, "c1"), (2, "c2")], "eval_index long, case_id string")
    made = cases.select("eval_index", F.lit("alpha").alias("method"), F.lit("text_only").alias("setting"))
    conflicts = spark.createDataFrame([(1,), (1,)], "eval_index long")
    return judge.jobs(cases, made, "r", conflicts=conflicts).withColumns({"prompt": F.lit("p"), "source_image": F.lit("s"), "output_image": F.lit("o")})


def test_job_digests(spark):
    import hashlib

    def digest(value):
        return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    for r in small_jobs(spark).limit(5).collect():
        given = digest({"case_id": r["case_id"], "eval_index": r["eval_index"], "method": r["method"], "setting": r["setting"]})
        assert r["input_digest"] == given and r["key"] == digest({"input": given, "run_id": "r", "variant": "first"})
    odd = spark.createDataFrame([('quo"te \\ é\n\t', None, True)], "b string, a long, c boolean")
    made = odd.select(records.canonical({f.name: f.dataType for f in odd.schema}).alias("v")).first()["v"]
    assert made == json.dumps({"a": None, "b": 'quo"te \\ é\n\t', "c": True}, sort_keys=True, ensure_ascii=False)


GOOD = json.dumps({"edit": 4, "preservation": None, "quality": 3, "edit_evidence": "a", "preservation_evidence": "b", "quality_evidence": "c"})


def test_judging_asks_once_more(spark):
    jobs = small_jobs(spark)
    assert jobs.count() == 60 and jobs.select("key").distinct().count() == 60

    def backend(talks):
        return [{"text": "bad" if len(t) == 1 else "worse", "finish_reason": "stop", "prompt_tokens": len(t), "output_tokens": 1} for t in talks]

    got = {(r["eval_index"], r["method"], r["setting"]): r for r in judge.judged(jobs, backend).collect()}
    r = got[0, "alpha", "text_only"]
    assert len(got) == 60 and r["status"] == "judge_parse_error" and [a["text"] for a in r["attempts"]] == ["bad", "worse"]
    assert [a["prompt_tokens"] for a in r["attempts"]] == [1, 3] and not any(a["parse_ok"] for a in r["attempts"]) and r["error"] == r["attempts"][1]["error"]
    assert got[1, "alpha", "text_only"]["status"] == "annotation_conflict" and got[1, "beta", "text_only"]["status"] == "missing_output" and got[1, "beta", "text_only"]["attempts"] == []
    assert judge.resumed(jobs, judge.judged(jobs, backend)).count() == 2


def test_assessing():
    job = {"key": "k", "eval_index": 0, "method": "alpha", "setting": "text_only", "prompt": "p", "source_image": "s", "output_image": "o"}
    asked = []

    def cut_then_good(talks):
        asked.append(talks)
        return [{"text": GOOD, "finish_reason": "length" if len(t) == 1 else "stop"} for t in talks]

    r = judge.assess([job], cut_then_good)[0]
    assert r["status"] == "ok" and r["edit"] == 4 and [a["error"] for a in r["attempts"]] == ["truncated model response", None]
    first, again = asked[0][0], asked[1][0]
    assert [p["type"] for p in first[0]["content"]] == ["text", "image", "text", "image", "text"] and first[0]["content"][-1]["text"] == "p"
    assert again[:1] == first and again[1]["role"] == "assistant" and again[2]["content"].startswith("Schema error: truncated model response. Return")
    assert judge.assess([job], lambda talks: [])[0]["status"] == "judge_runtime_error"

    def fails_later(talks):
        if len(talks[0]) > 1:
            raise RuntimeError("no memory")
        return [{"text": GOOD, "finish_reason": "stop"}, {"text": "", "finish_reason": "stop"}]

    a, b = judge.assess([job, job], fails_later)
    assert a["status"] == "ok" and b["status"] == "judge_runtime_error" and b["error"] == "RuntimeError: no memory" and len(b["attempts"]) == 1


def test_masks():
    m = np.zeros((12, 14), bool)
    m[2:6, 2:6] = m[6, 6] = m[9:11, 10:13] = True
    label = masks.label_components(m)
    assert label.max() == 2 and label[6, 6] == label[2, 2] and (label > 0).sum() == m.sum()
    rng = np.random.default_rng(0)
    for n in range(32):  # against flooding from each pixel
        x = rng.random((rng.integers(1, 14), rng.integers(1, 14) if n < 30 else 150)) < (0.45 if n < 30 else 0.01)
        want, n = np.zeros(x.shape, int), 0
        for y0, x0 in np.argwhere(x):
            if not want[y0, x0]:
                n += 1
                stack = [(y0, x0)]
                while stack:
                    b, a = stack.pop()
                    if 0 <= b < x.shape[0] and 0 <= a < x.shape[1] and x[b, a] and not want[b, a]:
                        want[b, a] = n
                        stack += [(b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (masks.label_components(x) == want).all()
        far = masks.squared_distance(x)
        if x.any():
            ys, xs = np.nonzero(x)
            gy, gx = np.mgrid[: x.shape[0], : x.shape[1]]
            assert (far == ((gy[..., None] - ys) ** 2 + (gx[..., None] - xs) ** 2).min(axis=2)).all()
    assert masks.dilate(m, 1).sum() > m.sum() and masks.dilate(m, 1)[1, 2]
    assert masks.disc(1).tolist() == [[False, True, False], [True, True, True], [False, True, False]]
    assert masks.disc(2).sum(axis=1).tolist() == [1, 5, 5, 5, 1] and masks.disc(3).sum(axis=1).tolist() == [1, 5, 7, 7, 7, 5, 1]
    big = np.zeros((11, 11), bool)
    big[1:10, 1:10] = True
    assert masks.innermost(big) == (5, 5)
    full = np.ones((6, 9), bool)
    assert masks.innermost(full) == (2, 2) and masks.innermost(np.eye(4, dtype=bool)) == (0, 0)
    assert masks.raster(np.array([[1, 1], [5, 1], [5, 4], [1, 4]], float), 8, 8).sum() == 20
    assert masks.raster(np.array([[1, 1], [5, 1], [5, 4], [1, 4]], float), 8, 8)[1:5, 1:6].all()
    assert masks.raster(np.array([[-3, -3], [20, -3], [20, 20], [-3, 20]], float), 8, 8).all()


def test_regions():
    m = np.zeros((40, 60), bool)
    m[2:8, 40:50] = m[20:30, 3:12] = True
    m[10, 20] = m[5, 55] = True  # stray pixels
    left, right = masks.regions_of(m, True)
    assert left[20:30, 3:12].all() and left[10, 20] and right[5, 55] and not (left & right).any() and ((left | right) == m).all()
    assert (masks.regions_of(m, False)[0] == m).all()
    m[20:30, 3:12] = False
    assert (masks.regions_of(m, True)[0] == m).all()
    with pytest.raises(ValueError, match="0 components"):
        masks.regions_of(np.eye(5, dtype=bool)[:, :3] & False, True)
    top = np.zeros((100, 100), bool)
    top[10:20, 60:70] = top[14:24, 5:15] = top[70:80, 30:40] = True  # two in one band, one below
    assert [int(np.nonzero(p)[1].min()) for p in masks.significant_components(top)] == [5, 60, 30]


def pixels(spark, mask, name=1):
    return spark.createDataFrame([(name, int(x), int(y)) for y, x in np.argwhere(mask)], "mask int, x int, y int")


def test_splits(spark):
    m = np.zeros((30, 40), bool)
    m[5:15, 2:12] = m[5:15, 20:30] = True  # parted by empty lines: the first of them in the range wins
    span = 28
    r = masks.split_scan(pixels(spark, m)).first()
    assert r["axis"] == 0 and r["place"] == 12 and r["score"] == 0.0 and int(0.15 * span) <= r["place"] - 2 < int(0.85 * span)
    small = np.zeros((5, 5), bool)
    small[1:4, 1:4] = True
    assert masks.split_scan(pixels(spark, small)).count() == 0
    parts = masks.split_parts(pixels(spark, m.T))
    assert {(r["region"], r["y"] < 12) for r in parts.collect()} == {(1, True), (2, False)}
    cov = spark.createDataFrame([(1, -5.5, 4.2, 4.0, 7.9), (1, 50.0, 0.0, 60.0, 5.0)], "mask int, bx1 double, by1 double, bx2 double, by2 double")
    assert {r["coverage"] for r in masks.coverage(pixels(spark, m), cov, 40, 30).collect()} == {m[4:8, 0:4].mean(), 0.0}


def test_pairs_and_partition(spark):
    rows = lambda *v: spark.createDataFrame([(1, i, s, b) for i, (s, b) in enumerate(v)], "mask int, rank int, score double, box array<int>")
    first, second = rows((0.9, [0, 0, 10, 10]), (0.5, [20, 0, 30, 10])), rows((0.9, [0, 0, 10, 9]), (0.85, [2, 0, 12, 10]), (0.6, [40, 0, 50, 10]))
    r = joins.box_pairs(first, second).first()
    assert (r["first"], r["second"]) == (0, 1) and r["score"] == pytest.approx(1.75 - 0.15 * 80 / 120)
    centres = spark.createDataFrame([(1, 1, 0.0, 0.0, 100, 1), (1, 2, 30.0, 0.0, 2, 1)], "mask int, centre int, cx double, cy double, sx int, sy int")
    assert joins.nearest(spark.createDataFrame([(1, 28, 0)], "mask int, x int, y int"), centres, "mask").first()["centre"] == 1  # in units of the boxes
    union = spark.createDataFrame([(1, x, 0) for x in range(6)], "mask int, x int, y int")
    inst = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 1, 0), (1, 2, 1, 0), (1, 2, 5, 0)], "mask int, region int, x int, y int")
    boxes = spark.createDataFrame([(1, 1, 0, 0, 3, 1), (1, 2, 3, 0, 6, 1)], "mask int, region int, x1 int, y1 int, x2 int, y2 int")
    assert {(r["x"], r["region"]) for r in joins.partition(union, inst, boxes).collect()} == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}
    assert masks.difference_free(joins.partition(union, inst, boxes), union).count() == 0


def test_stability(spark):
    data = [(1, "alpha", "text_only", "a", 1, "ok", 4, 4, 4), (1, "alpha", "text_only", "b", 1, "ok", 4, 4, 2), (2, "alpha", "text_only", "a", 1, "ok", 4, 4, 4), (3, "alpha", "text_only", "b", 1, "ok", 4, 4, 4), (4, "alpha", "text_only", "a", 1, "ok", 1, 1, 1), (4, "alpha", "text_only", "b", 1, "judge_parse_error", None, None, None)]
    r = summary.stability(rows(spark, data), "a").first()
    assert (r["reference"], r["variant"], r["paired"], r["unpaired"], r["any_axis_changed"], r["strict_changed"]) == ("a", "b", 1, 3, 1, 1)
    assert [r["eval_index"] for r in summary.changed_samples(rows(spark, data), "a").collect()] == [1]
    ranges = F.create_map(F.lit("edit"), F.struct(F.lit(1).alias("low"), F.lit(3).alias("high")), F.lit("quality"), F.struct(F.lit(0).alias("low"), F.lit(4).alias("high")))
    assert set(one(spark, summary.out_of_range(ranges, F.create_map(F.lit("edit"), F.lit(4), F.lit("quality"), F.lit(None).cast("int"))))) == {"edit", "quality"}


def test_positions_and_rules(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)][::-1], "k string")
    assert {(r["k"], r["position"]) for r in order.with_position(df, "k").collect()} == {(f"k{i:03d}", i) for i in range(50)}
    bad = spark.createDataFrame([(1, 5), (1, -1), (2, 7)], "id long, v int")
    got = {tuple(r) for r in validate.errors(bad, "id", {"positive": F.col("v") > 0}).collect()}
    assert got == {(1, "positive"), (1, "unique")}
    with pytest.raises(ValueError):
        validate.require(bad)


def test_subsets_and_orders(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(6)], "eval_index long, v string")
    assert [r["v"] for r in order.subset(df, [4, 1, 4], 1).collect()] == ["r1"]
    with pytest.raises(Exception, match="no such position"):
        order.subset(df, [9]).collect()
    jobs = spark.createDataFrame([(1, "beta", "text_only"), (0, "beta", "text_only"), (5, "alpha", "point_annotation"), (9, "alpha", "text_only")], "eval_index long, method string, setting string")
    placed = {r["position"]: r["eval_index"] for r in judge.ordered(jobs).collect()}
    assert placed == {0: 9, 1: 5, 2: 0, 3: 1}
    with pytest.raises(Exception, match="unknown method"):
        judge.ordered(jobs.withColumn("method", F.lit("zeta"))).collect()
    assert [r["status"] for r in summary.first_seen(spark.createDataFrame([(2, "b"), (1, "b"), (3, "a")], "line int, status string"), "status", "line").orderBy("position").collect()] == ["b", "a"]


def test_case_contracts(spark):
    good = {"id": "a", "source_dataset": "composed", "edit_type": "add", "source_image": "s", "instruction": {"with_location_reference": "x", "region_only": "Add {region_1}"}, "regions": [{"mask": "m", "box": [0, 0, 5, 5], "point": [1, 1]}],
            "evaluation_mask": "e", "target": {"reference_image": "r", "expected_local_content": "c", "expected_global_description": None}, "difficulty": {"same_class_multi_instance": True, "multi_object_scene": False}}
    lines = [good, good | {"extra": 1}, good | {"target": {"reference_image": "r"}}, {k: v for k, v in good.items() if k != "id"}]
    text_rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "n int, line string")
    got = {(r["n"], r["rule"]) for r in text_rows.select("n", F.explode(validate.broken(validate.field_rules(F.col("line")))).alias("rule")).collect()}
    assert got == {(1, "fields $"), (2, "fields $.target"), (3, "fields $")}
    kind = "id string, source_dataset string, edit_type string, source_image string, instruction struct<with_location_reference:string,region_only:string>, regions array<struct<mask:string,box:array<int>,point:array<int>>>, target struct<reference_image:string,expected_local_content:string>, width int, height int"
    case = lambda **v: {k: x for k, x in (good | {"width": 5, "height": 5} | v).items() if k in ("id", "source_dataset", "edit_type", "source_image", "instruction", "regions", "target", "width", "height")}
    bad = spark.createDataFrame([case(), case(id="b", edit_type="paint"), case(id="c", instruction={"with_location_reference": " ", "region_only": "Add {region_2}"}), case(id="d", source_dataset="polygon"), case(id="e", width=4)], kind)
    built = {(r["id"], r["rule"]) for r in validate.errors(bad, "id", validate.built_case_rules(("composed", "polygon"), "polygon")).collect()}
    assert built == {("b", "edit_type"), ("c", "placeholders"), ("d", "reference"), ("e", "geometry")}
    assert {(r["id"], r["rule"]) for r in validate.errors(bad, "id", validate.loaded_case_rules()).collect()} == {("c", "placeholders"), ("c", "instruction")}
    assert one(spark, validate.different_fields(F.array(F.lit("a"), F.lit("z")), ("a", "b"))) == ["b", "z"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, ("y", "x"), None), (2, None, "n")], "b int, a struct<d:string,c:string>, e string")
    writers.write_jsonl(df, str(tmp_path / "out"))
    lines = sorted(r["value"] for r in readers.raw_lines(spark, str(tmp_path / "out")).collect())
    assert lines[1] == '{"a":{"c":"x","d":"y"},"b":1,"e":null}' or lines[0] == '{"a":{"c":"x","d":"y"},"b":1,"e":null}'
    assert readers.jsonl(spark, str(tmp_path / "out"), df.schema).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\nnot json\n')
    assert [r["line"] for r in readers.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()] == ["not json"]
    assert readers.first_error(spark, str(tmp_path / "bad.jsonl")) == "bad.jsonl:3" and readers.first_error(spark, str(tmp_path / "out")) is None
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    name = readers.file_hashes(spark, str(tmp_path / "p"), "*.parquet").first()["path"].rsplit("/", 1)[-1]
    place = lambda *rows_: readers.by_ordinal(spark, [str(tmp_path / "p")], spark.createDataFrame([(name, r) for r in rows_], "file string, row long"), "b")
    assert sorted(r["b"] for r in place(0, 1).collect()) == [1, 2]
    with pytest.raises(Exception, match="no such row"):
        place(0, 7).collect()
    kept = readers.by_identity(df.select("b", "e"), spark.createDataFrame([(2, "n")], "b int, want string"), "b", "e", "want")
    assert kept.count() == 1
    with pytest.raises(Exception, match="identity differs"):
        readers.by_identity(df.select("b", "e"), spark.createDataFrame([(2, "m")], "b int, want string"), "b", "e", "want").collect()
    import struct

    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest")
    (tmp_path / "pics" / "b.png").write_bytes(b"no picture")
    assert sorted(((r["width"], r["height"]) for r in readers.png_sizes(spark, str(tmp_path / "pics")).collect()), key=str) == [(640, 480), (None, None)]
    (tmp_path / "config.json").write_text('{\n "b": 3\n}')
    assert readers.config(spark, str(tmp_path / "config.json"), "b int")["b"] == 3
    body = "x <!-- BEGIN t --> old <!-- END t --> y"
    new = writers.replace_section(body, "t", "new")
    assert "old" not in new and writers.replace_section(new, "t", "new") == new
    with pytest.raises(ValueError):
        writers.replace_section("none", "t", "new")


def test_stream(spark, tmp_path):
    from brocade.streaming import ingest

    kind = "key string, method string, setting string, finished_at timestamp"
    rows_ = [("a", "alpha", "text_only"), ("b", "beta", "text_only"), ("a", "alpha", "text_only")]
    df = spark.createDataFrame(rows_, "key string, method string, setting string").withColumn("finished_at", F.lit("2026-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.copy_new(ingest.records(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "marks"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and kind
