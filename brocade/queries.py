"""Queries of the evaluation engine and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import AXES, METHODS, SETTINGS
from .functions import geometry, records as record_functions, text
from .operators import audit, joins, masks, order, summary, validate
from .operators.stack import met
from .plans import build, compare, judge, prepare
from .sources.derived import DERIVED_SQL, cases, judge_records, pixels, records, selections, shapes, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {DERIVED_SQL} {sql}"
        return fn

    return add


def _rates(c: str, most: int = 7) -> str:
    v = f"(CASE WHEN status = 'missing_output' THEN false ELSE {c} END)"
    yes, no, n = f"count(CASE WHEN {v} THEN 1 END)", f"count(CASE WHEN NOT {v} THEN 1 END)", "count(*)"
    parts = [f"{yes} AS {c}_success", f"{no} AS {c}_failure", f"{n} - {yes} - {no} AS {c}_unknown", f"({yes} + {no}) / {n} AS {c}_coverage", f"{yes} / nullif({yes} + {no}, 0) AS {c}_rate",
             f"{yes} / {n} AS {c}_lower", f"({n} - {no}) / {n} AS {c}_upper"]
    return ", ".join(parts[:most])


def _axis(a: str) -> str:
    return f"avg({a}) AS {a}_mean, count({a}) AS {a}_decidable, count(*) - count({a}) AS {a}_unknown, " + ", ".join(f"count(CASE WHEN {a} = {s} THEN 1 END) AS {a}_{s}" for s in range(5))


SUMMARY_SQL = f"count(*) AS n, {_rates('all_edits_success')}, {_rates('strict_success')}, {', '.join(_axis(a) for a in AXES)}"


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).join(cases(spark, sf_dir), "eval_index")


@query(f"SELECT method, count(DISTINCT eval_index) AS cases, {SUMMARY_SQL}, CAST(list_position({list(METHODS)!r}, method) - 1 AS BIGINT) AS position FROM records GROUP BY method")
def method_summary(spark, sf_dir):
    return summary.method_table(records(spark, sf_dir))


@query(f"SELECT variant, method, setting, split, source_dataset, {SUMMARY_SQL} FROM records JOIN cases USING (eval_index) GROUP BY ALL")
def group_summary(spark, sf_dir):
    return summary.summarize(_full(spark, sf_dir), "variant", "method", "setting", "split", "source_dataset")


@query("SELECT method, map_from_entries(list((edit, c) ORDER BY edit))::VARCHAR AS distribution FROM (SELECT method, edit, count(*) AS c FROM records WHERE edit IS NOT NULL GROUP BY ALL) GROUP BY method")
def edit_distribution(spark, sf_dir):
    got = summary.distribution(records(spark, sf_dir), "edit", "method")
    return got.select("method", F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ", "), F.lit("}")).alias("distribution"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM cases GROUP BY {c}" for c in ("source_dataset", "edit_type", "region_count", "split")))
def case_value_counts(spark, sf_dir):
    return summary.value_counts(cases(spark, sf_dir), "source_dataset", "edit_type", "region_count", "split")


_SETS = ("edit_type", "region_count", "setting")
_STRICT5 = _rates("strict_success", 5)


@query(" UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, method, count(*) AS n, avg(edit) AS edit_mean, avg(preservation) AS preservation_mean, avg(quality) AS quality_mean, {_STRICT5} FROM records JOIN cases USING (eval_index) GROUP BY {d}, method" for d in _SETS))
def method_breakdown(spark, sf_dir):
    return summary.breakdown(_full(spark, sf_dir), _SETS)


@query("SELECT method, " + ", ".join(f"avg(edit) FILTER (setting = '{s}') AS {s}" for s in SETTINGS) + " FROM records GROUP BY method")
def method_setting_matrix(spark, sf_dir):
    return summary.mean_matrix(records(spark, sf_dir), "edit")


@query()
def bootstrap_intervals(spark, sf_dir):
    return summary.bootstrap(records(spark, sf_dir), "method")


_CUT = "(SELECT * FROM records WHERE variant {0} 'r1' QUALIFY row_number() OVER (PARTITION BY eval_index, method, setting, variant ORDER BY line) = 1)"
_BOTH_OK = "a.status = 'ok' AND b.status = 'ok'"
_CHANGED = "(a.edit IS DISTINCT FROM b.edit OR a.preservation IS DISTINCT FROM b.preservation OR a.quality IS DISTINCT FROM b.quality)"


@query(f"""SELECT 'r1' AS reference, v.variant, count(CASE WHEN {_BOTH_OK} THEN 1 END) AS paired, (SELECT count(*) FROM (SELECT DISTINCT eval_index, method, setting FROM records)) - count(CASE WHEN {_BOTH_OK} THEN 1 END) AS unpaired,
 count(CASE WHEN {_BOTH_OK} AND {_CHANGED} THEN 1 END) AS any_axis_changed, count(CASE WHEN {_BOTH_OK} AND a.strict_success IS DISTINCT FROM b.strict_success THEN 1 END) AS strict_changed
 FROM (SELECT DISTINCT variant FROM records WHERE variant <> 'r1') v LEFT JOIN {_CUT.format('<>')} b ON b.variant = v.variant LEFT JOIN {_CUT.format('=')} a USING (eval_index, method, setting) GROUP BY v.variant""")
def variant_stability(spark, sf_dir):
    return summary.stability(records(spark, sf_dir), "r1")


@query(f"""SELECT eval_index, method, setting, b.variant, {_CHANGED} AS any_axis, a.strict_success IS DISTINCT FROM b.strict_success AS strict FROM {_CUT.format('=')} a JOIN {_CUT.format('<>')} b USING (eval_index, method, setting)
 WHERE {_BOTH_OK} AND ({_CHANGED} OR a.strict_success IS DISTINCT FROM b.strict_success)""")
def changed_samples(spark, sf_dir):
    return summary.changed_samples(records(spark, sf_dir), "r1")


_EXPECTED = "(CASE WHEN eval_index % 3 = 0 THEN true WHEN eval_index % 3 = 1 THEN false END)"


@query(f"""SELECT variant, split AS provenance, count(*) AS total, count({_EXPECTED}) AS binary_labeled, count(CASE WHEN {_EXPECTED} IS NOT NULL AND all_edits_success IS NULL THEN 1 END) AS unresolved,
 count(CASE WHEN {_EXPECTED} AND all_edits_success THEN 1 END) AS true_positive, count(CASE WHEN {_EXPECTED} AND NOT all_edits_success THEN 1 END) AS false_negative, count(CASE WHEN NOT {_EXPECTED} AND all_edits_success THEN 1 END) AS false_positive,
 count(CASE WHEN NOT {_EXPECTED} AND NOT all_edits_success THEN 1 END) AS true_negative FROM records JOIN cases USING (eval_index) GROUP BY ALL""")
def control_confusion(spark, sf_dir):
    e = F.when(F.col("eval_index") % 3 == 0, True).when(F.col("eval_index") % 3 == 1, False)
    return summary.control_counts(_full(spark, sf_dir), e, "variant", "split").withColumnRenamed("split", "provenance")


_U = "status = 'ok' AND edit IS NOT NULL AND preservation IS NOT NULL AND quality IS NOT NULL"
_S = f"{_U} AND edit = 4 AND preservation >= 3 AND quality >= 3"
_CASE = f"""SELECT eval_index, count(*) AS records, count(CASE WHEN {_U} THEN 1 END) AS usable, avg(edit) FILTER ({_U}) AS edit_mean, max(edit) FILTER ({_U}) AS edit_max, count(CASE WHEN {_U} AND edit = 4 THEN 1 END) AS edit_successes, count(CASE WHEN {_S} THEN 1 END) AS strict_successes,
 {', '.join(f"max(edit) FILTER ({_U} AND method = '{m}') AS best_{m}" for m in METHODS)}, {', '.join(f"count(CASE WHEN {_S} AND method = '{m}' THEN 1 END) AS strict_{m}" for m in METHODS)},
 {', '.join(f"max(edit) FILTER ({_U} AND setting = '{s}') AS best_{s}" for s in SETTINGS)},
 count(DISTINCT method) FILTER ({_S}) AS strict_methods, count(DISTINCT setting) FILTER ({_S}) AS strict_settings,
 coalesce(string_agg(method || '/' || setting, ',' ORDER BY list_position({list(METHODS)!r}, method), list_position({list(SETTINGS)!r}, setting)) FILTER ({_S}), '') AS strict_outputs FROM records GROUP BY eval_index"""


@query(_CASE)
def case_summaries(spark, sf_dir):
    return summary.case_summary(records(spark, sf_dir)).withColumn("strict_outputs", F.array_join("strict_outputs", ","))


_TIERS = {"edit_at_most_1": "edit_max <= 1", "edit_at_most_2": "edit_max <= 2", "no_edit_success": "edit_successes = 0", "no_strict_success": "strict_successes = 0",
          **{f"strict_at_most_{k}": f"strict_successes <= {k}" for k in (1, 2, 3, 4)}, "strict_in_few_methods": "strict_successes >= 5 AND strict_methods <= 2",
          "strict_in_one_setting": "strict_successes >= 5 AND strict_settings = 1", "concentrated": "strict_successes >= 5 AND (strict_methods <= 2 OR strict_settings = 1)",
          **{f"{s}_edit_at_most_1": f"best_{s} <= 1" for s in SETTINGS}}


_WHOLE_CASE = _CASE.replace("FROM records", "FROM judge_records")


@query(_WHOLE_CASE)
def whole_case_summaries(spark, sf_dir):
    """Cases that have every method and setting."""
    return summary.case_summary(judge_records(spark, sf_dir)).withColumn("strict_outputs", F.array_join("strict_outputs", ","))


@query(f"WITH {DERIVED_SQL}, s AS ({_WHOLE_CASE}) " + " UNION ALL ".join(f"SELECT '{t}' AS tier, eval_index FROM s WHERE usable = 20 AND {c}" for t, c in _TIERS.items()))
def failure_tiers(spark, sf_dir):
    return summary.failure_tiers(summary.case_summary(judge_records(spark, sf_dir)))


@query(f"WITH {DERIVED_SQL}, s AS ({_WHOLE_CASE}) SELECT strict_successes, count(*) AS count FROM s GROUP BY ALL")
def strict_histogram(spark, sf_dir):
    return summary.histogram(summary.case_summary(judge_records(spark, sf_dir)), "strict_successes")


@query("SELECT status, count(*) AS count FROM records GROUP BY status")
def status_counts(spark, sf_dir):
    return summary.histogram(records(spark, sf_dir), "status")


_GRID = f"grid AS (SELECT eval_index, method, setting FROM cases, unnest({list(METHODS)!r}) m(method), unnest({list(SETTINGS)!r}) s(setting))"
_FIRST = "first AS (SELECT * FROM records WHERE variant = 'r1' QUALIFY row_number() OVER (PARTITION BY eval_index, method, setting ORDER BY line) = 1)"


@query(f"WITH {DERIVED_SQL}, {_GRID}, {_FIRST} SELECT method, setting, coalesce(status, 'pending') AS status, count(*) AS count FROM grid LEFT JOIN first USING (eval_index, method, setting) GROUP BY ALL")
def pending_jobs(spark, sf_dir):
    """Every case, method and setting with its first record, pending where there is none."""
    first = records(spark, sf_dir).filter("variant = 'r1'")
    rows = joins.filled_grid(cases(spark, sf_dir).select("eval_index"), first, F.min_by("status", "line"), "status", F.lit("pending"))
    return rows.groupBy("method", "setting", "status").agg(F.count(F.lit(1)).alias("count"))


@query(f"WITH {DERIVED_SQL}, {_GRID}, k AS (SELECT eval_index, method, setting, sum(e) AS e, sum(a) AS a FROM (SELECT eval_index, method, setting, 1 AS e, 0 AS a FROM grid UNION ALL SELECT eval_index, method, setting, 0, 1 FROM records) GROUP BY ALL) "
       "SELECT eval_index, method, setting, CASE WHEN a = 0 THEN 'missing' WHEN e = 0 THEN 'unexpected' ELSE 'duplicate' END AS problem FROM k WHERE a = 0 OR e = 0 OR a > 1")  # fmt: skip
def coverage_errors(spark, sf_dir):
    return joins.grid_errors(cases(spark, sf_dir), records(spark, sf_dir))


@query(f"WITH {DERIVED_SQL}, {_GRID} SELECT method, setting, count(*) AS count FROM grid WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.eval_index = grid.eval_index AND r.method = grid.method AND r.setting = grid.setting AND r.status = 'ok') GROUP BY ALL")
def jobs_to_resume(spark, sf_dir):
    done = records(spark, sf_dir).filter("status = 'ok'")
    left = joins.unfinished(joins.expected_jobs(cases(spark, sf_dir).select("eval_index")), done, "eval_index", "method", "setting")
    return left.groupBy("method", "setting").agg(F.count(F.lit(1)).alias("count"))


@query("""WITH """ + DERIVED_SQL + """, ok AS (SELECT * FROM judge_records WHERE status = 'ok') SELECT method, count(*) AS n, avg(edit) AS edit_mean FROM ok WHERE (eval_index, setting) IN
 (SELECT (eval_index, setting) FROM ok GROUP BY eval_index, setting HAVING count(DISTINCT method) = 5) GROUP BY method""")
def matched_cohort(spark, sf_dir):
    """Means over the cases and settings for which every method has a result."""
    return joins.common_cohort(judge_records(spark, sf_dir).filter("status = 'ok'")).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("edit").alias("edit_mean"))


@query("SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS position, CAST((row_number() OVER (ORDER BY case_id) - 1 + 3) % 8 AS BIGINT) AS shard, CAST(floor((row_number() OVER (ORDER BY case_id) - 1) / 20) AS BIGINT) AS page FROM cases")
def case_positions(spark, sf_dir):
    placed = order.with_position(cases(spark, sf_dir).select("case_id"), "case_id")
    return placed.select("case_id", "position", order.shard(F.col("position"), 8, 3).alias("shard"), order.page(F.col("position"), 20).alias("page"))


@query("SELECT eval_index, line, method, status FROM records QUALIFY row_number() OVER (PARTITION BY eval_index ORDER BY coalesce(edit, -1) DESC, line) = 1")
def latest_records(spark, sf_dir):
    rows = records(spark, sf_dir).select("eval_index", "line", "method", "status", F.coalesce("edit", F.lit(-1)).alias("at"))
    return order.latest(rows, "eval_index", "at", "line").drop("at")


@query("SELECT method, setting, count(*) AS done, max(updated_at) AS latest, round_even(100 * count(*) / 1000, 2) AS percent FROM judge_records WHERE status = 'ok' GROUP BY ALL")
def judging_progress(spark, sf_dir):
    done = judge_records(spark, sf_dir).filter("status = 'ok'")
    grid = joins.expected_jobs(spark.range(1).select(F.lit(0).alias("one"))).select("method", "setting")
    return summary.progress(done, grid, "method", "setting", per_key=1000)


@query("SELECT method, setting, eval_index, updated_at FROM judge_records WHERE status = 'ok' ORDER BY updated_at DESC, method, setting, eval_index LIMIT 1")
def latest_result(spark, sf_dir):
    return summary.latest_done(judge_records(spark, sf_dir).filter("status = 'ok'"), "method", "setting", "eval_index")


@query("SELECT count(*) AS count, sum(elapsed_seconds) AS elapsed_seconds_total, count(derived_from_output) AS derived_outputs FROM judge_records")
def run_summary(spark, sf_dir):
    return summary.record_summary(judge_records(spark, sf_dir))


@query("SELECT status, row_number() OVER (ORDER BY min(line), status) - 1 AS position FROM judge_records GROUP BY status")
def statuses_as_seen(spark, sf_dir):
    return summary.first_seen(judge_records(spark, sf_dir), "status", "line")


_RANGES = {"edit": (2, 4), "preservation": (0, 2), "quality": (1, 3)}


@query("SELECT line, list_sort(list_filter([" + ", ".join(f"CASE WHEN {k} IS NULL OR {k} NOT BETWEEN {a} AND {b} THEN '{k}' END" for k, (a, b) in _RANGES.items()) + "], lambda x: x IS NOT NULL))::VARCHAR AS outside FROM judge_records")
def range_checks(spark, sf_dir):
    """Axes of controls outside their expected ranges; an unknown score is outside."""
    want = F.create_map(*[x for k, (a, b) in _RANGES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")))])
    have = F.create_map(*[x for k in _RANGES for x in (F.lit(k), F.col(k))])
    keys = F.array_sort(F.map_keys(summary.out_of_range(want, have)))
    return judge_records(spark, sf_dir).select("line", F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("outside"))


_SIDE = "greatest(32, CAST(round_even(sqrt(1048576 * {0} / {1}) / 32, 0) * 32 AS INT))"
_SHORT = "greatest({1}, CAST(round_even(least(width, height) * {0}, 0) AS INT))"
_VIEW = "CASE WHEN sqrt(65536.0 / (width * height)) < 1 THEN greatest(1, CAST(round_even({0} * sqrt(65536.0 / (width * height)), 0) AS INT)) ELSE {0} END"


@query(f"SELECT eval_index, {_SIDE.format('width', 'height')} AS out_width, {_SIDE.format('height', 'width')} AS out_height, {_VIEW.format('width')} AS view_width, {_VIEW.format('height')} AS view_height, " + ", ".join(f"{_SHORT.format(*v)} AS {k}" for k, v in geometry.MARKERS.items()) + " FROM cases")
def output_sizes(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    scale = geometry.view_scale(w, h, 65536)
    markers = [geometry.marker(F.least(w, h), share, least).alias(k) for k, (share, least) in geometry.MARKERS.items()]
    return cases(spark, sf_dir).select("eval_index", geometry.output_side(w, h).alias("out_width"), geometry.output_side(h, w).alias("out_height"), geometry.view_side(w, scale).alias("view_width"), geometry.view_side(h, scale).alias("view_height"), *markers)


_LINE_BOX = "lb AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey % 100 AS INT) AS x1, CAST(l_suppkey % 80 AS INT) AS y1, CAST(l_partkey % 100 AS INT) + CAST(trunc(l_quantity) AS INT) AS x2, CAST(l_suppkey % 80 AS INT) + 10 + l_linenumber AS y2 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"


def _boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 100).cast("int"), (F.col("l_suppkey") % 80).cast("int")
    rows = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.struct("l_partkey", "l_suppkey", "l_quantity").alias("o"), F.array(x, y, x + F.col("l_quantity").cast("int"), y + 10 + F.col("l_linenumber")).alias("box"))
    return rows.groupBy("k", "n").agg(F.min_by("box", "o").alias("box"))


_IOU = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "CAST(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1) AS DOUBLE)"
_BOTH = f"({_IOU}) / greatest(1e-9, {_AREA.format('a')} + {_AREA.format('b')} - ({_IOU}))"


@query(f"""WITH {_LINE_BOX}, scored AS (SELECT *, n AS rank, n * 0.25 + (x2 - x1) * 0.0625 AS score FROM lb), pairs AS (SELECT a.k, a.rank AS first, b.rank AS second, a.score + b.score - 0.15 * ({_BOTH}) AS score, {_BOTH} AS iou FROM scored a JOIN scored b ON a.k = b.k AND a.n % 2 = 1 AND b.n % 2 = 0)
 SELECT k, first, second, score FROM pairs WHERE iou < 0.75 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, first, second) = 1""")
def best_region_pairs(spark, sf_dir):
    """For each case the best pair of a box of one list (odd lines) and of the other (even ones): pairs form within a case, of a few lines."""
    scored = _boxes(spark, sf_dir).withColumns({"rank": F.col("n"), "score": F.col("n") * 0.25 + (F.element_at("box", 3) - F.element_at("box", 1)) * 0.0625})
    return joins.box_pairs(scored.filter("n % 2 = 1"), scored.filter("n % 2 = 0"), "k")


@query(f"""WITH {_LINE_BOX} SELECT k AS eval_index, n AS line, rule FROM (SELECT *, unnest(list_filter([CASE WHEN NOT (x1 >= 0 AND x1 < x2 AND x2 <= 130 AND y1 >= 0 AND y1 < y2 AND y2 <= 90) THEN 'box' END, CASE WHEN NOT (x1 < 95) THEN 'left' END], lambda r: r IS NOT NULL)) AS rule FROM lb)""")
def box_errors(spark, sf_dir):
    rules = {"box": geometry.box_valid(F.col("box"), F.lit(130), F.lit(90)), "left": F.element_at("box", 1) < 95}
    return _boxes(spark, sf_dir).select(F.col("k").alias("eval_index"), F.col("n").alias("line"), F.explode(validate.broken(rules)).alias("rule"))


@query("SELECT count(*) AS total, count(DISTINCT case_id) AS unique_ids, count(DISTINCT source_group) AS unique_sources, count(CASE WHEN source_dataset <> 'POLYGON' THEN 1 END) AS \"references\", sum(1 + mask % 2)::BIGINT AS regions, count(CASE WHEN mask % 2 = 1 THEN 1 END) AS multi_region, count(region_only) AS region_only_instructions FROM selections")
def validation_report(spark, sf_dir):
    made = {"source_image": F.col("source_group"), "target": F.when(F.col("source_dataset") != "POLYGON", F.col("case_id")), "region_count": 1 + F.col("mask") % 2, "region_instruction": F.col("region_only")}
    return validate.report(selections(spark, sf_dir).withColumns(made))


@query("SELECT mask, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS area FROM pixels GROUP BY mask")
def mask_boxes(spark, sf_dir):
    return masks.boxes(pixels(spark, sf_dir))


@query("SELECT mask, count(CASE WHEN a + b = 1 THEN 1 END) AS mismatched FROM (SELECT mask, x, y, max(a) AS a, max(b) AS b FROM (SELECT mask, x, y, 1 AS a, 0 AS b FROM pixels WHERE x > 3 UNION ALL SELECT mask, x, y, 0, 1 FROM pixels WHERE y > 2) GROUP BY ALL) GROUP BY mask")
def mask_mismatches(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return masks.difference(p.filter("x > 3"), p.filter("y > 2"))


@query("SELECT mask % 7 AS mask, count(*) AS area FROM (SELECT DISTINCT mask % 7 AS mask, x, y FROM pixels) GROUP BY ALL")
def mask_unions(spark, sf_dir):
    got = masks.union(pixels(spark, sf_dir).withColumn("whole", F.col("mask") % 7))
    return got.groupBy("mask").agg(F.count(F.lit(1)).alias("area"))


def split_sql(pixels: str) -> str:
    """cut: the best cut of each mask, every line of the range tried, empty ones too."""
    return f"""l AS (SELECT mask, 0 AS axis, x AS place, count(*) AS n FROM {pixels} GROUP BY ALL UNION ALL SELECT mask, 1, y, count(*) FROM {pixels} GROUP BY ALL),
 ax AS (SELECT mask, axis, min(place) AS a, max(place) - min(place) + 1 AS span, max(n) AS most, sum(n) AS area FROM l GROUP BY mask, axis),
 tried AS (SELECT ax.*, a + o AS place, coalesce((SELECT sum(n) FROM l WHERE l.mask = ax.mask AND l.axis = ax.axis AND l.place < a + o), 0) AS lf, coalesce((SELECT sum(n) FROM l WHERE l.mask = ax.mask AND l.axis = ax.axis AND l.place = a + o), 0) AS n
  FROM ax, range(1, 64) t(o) WHERE span >= 4 AND o >= greatest(1, floor(span * 0.15)) AND o < least(span - 1, floor(span * 0.85))),
 cut AS (SELECT mask, axis, place, n / greatest(1.0, most) + 0.18 * (abs(2 * lf - area) / area) AS score FROM tried WHERE least(lf, area - lf) >= area * 0.12
  QUALIFY row_number() OVER (PARTITION BY mask ORDER BY n / greatest(1.0, most) + 0.18 * (abs(2 * lf - area) / area), axis, place) = 1)"""


@query(f"WITH {DERIVED_SQL}, {split_sql('shapes')} SELECT mask, axis, CAST(place AS INT) AS place, score FROM cut")
def mask_splits(spark, sf_dir):
    return masks.splits(shapes(spark, sf_dir), 64, 48)


PARTS = "parts AS (SELECT mask, CASE WHEN CASE WHEN axis = 0 THEN x ELSE y END < place THEN 1 ELSE 2 END AS part, x, y FROM {0} JOIN cut USING (mask)), named AS (SELECT mask, part, row_number() OVER (PARTITION BY mask ORDER BY avg(x), avg(y), part) AS region FROM parts GROUP BY mask, part)"


@query(f"WITH {DERIVED_SQL}, {split_sql('pixels')}, {PARTS.format('pixels')} SELECT mask, CAST(region AS INT) AS region, count(*) AS area, min(x) AS x1, min(y) AS y1 FROM parts JOIN named USING (mask, part) GROUP BY ALL")
def split_regions(spark, sf_dir):
    """The two parts of each mask at its best cut, in order of their means."""
    return masks.split_parts(pixels(spark, sf_dir)).groupBy("mask", "region").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"))


#: Labels of 8-connected components by the least pixel that can be reached, those of 16 pixels or more in bands of rows.
_COMPONENTS = """steps AS (WITH RECURSIVE r(mask, x, y, label) USING KEY (mask, x, y) AS (SELECT mask, x, y, y * 64 + x FROM shapes
  UNION SELECT p.mask, p.x, p.y, min(r.label) FROM r JOIN (VALUES (-1,-1),(0,-1),(1,-1),(-1,0),(1,0),(-1,1),(0,1),(1,1)) d(dx, dy) ON true JOIN recurring.r p ON p.mask = r.mask AND p.x = r.x + dx AND p.y = r.y + dy WHERE r.label < p.label GROUP BY p.mask, p.x, p.y) SELECT * FROM r),
 large AS (SELECT mask, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM steps GROUP BY mask, label HAVING count(*) >= 16),
 comps AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY round_even(cy / 7.199999999999999, 0), cx, cy) AS component FROM large)"""


@query(f"WITH {DERIVED_SQL}, {_COMPONENTS} SELECT mask, component, area, cx, cy FROM comps")
def mask_components(spark, sf_dir):
    return masks.components(shapes(spark, sf_dir), 64, 48)


#: Masks of one or two components; of two, every pixel at the nearer one, the left one of ties.
_REGIONS = f"""{_COMPONENTS}, number AS (SELECT mask, count(*) AS n FROM comps GROUP BY mask), sided AS (SELECT mask, label, row_number() OVER (PARTITION BY mask ORDER BY cx, cy) AS region FROM comps JOIN number USING (mask) WHERE n = 2),
 held AS (SELECT steps.mask, x, y, region FROM steps JOIN sided USING (mask, label)), loose AS (SELECT steps.mask, x, y FROM steps JOIN number USING (mask) LEFT JOIN sided USING (mask, label) WHERE n = 2 AND region IS NULL),
 near AS (SELECT l.mask, l.x, l.y, h.region FROM loose l JOIN held h USING (mask) GROUP BY l.mask, l.x, l.y, h.region QUALIFY row_number() OVER (PARTITION BY l.mask, l.x, l.y ORDER BY min((l.x - h.x) * (l.x - h.x) + (l.y - h.y) * (l.y - h.y)), h.region) = 1),
 regs AS (SELECT mask, CAST(region AS INT) AS region, x, y FROM held UNION ALL SELECT mask, CAST(region AS INT), x, y FROM near UNION ALL SELECT mask, 1, x, y FROM steps JOIN number USING (mask) WHERE n = 1)"""


@query(f"WITH {DERIVED_SQL}, {_REGIONS} SELECT mask, region, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM regs GROUP BY ALL")
def mask_regions(spark, sf_dir):
    """Regions of masks: two components with all stray pixels at the nearer one, or the whole mask."""
    return masks.region_shapes(shapes(spark, sf_dir), 64, 48).drop("px", "py")


def disc_sql(radius: int) -> str:
    return f"(SELECT dx, dy FROM range(-{radius}, {radius + 1}) a(dx), range(-{radius}, {radius + 1}) b(dy) WHERE abs(dx) <= round_even({radius} * sqrt(({radius * radius} - dy * dy) * (1.0::DOUBLE / {radius * radius})), 0)) d"


@query(f"SELECT mask, count(*) AS area, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys FROM (SELECT DISTINCT mask, x + dx AS x, y + dy AS y FROM pixels, {disc_sql(3)} WHERE x + dx BETWEEN 0 AND 199 AND y + dy BETWEEN 0 AND 149) GROUP BY mask")
def mask_dilations(spark, sf_dir):
    return masks.dilated(pixels(spark, sf_dir), 200, 150).groupBy("mask").agg(F.count(F.lit(1)).alias("area"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


@query(f"SELECT mask, count(*) AS area FROM (SELECT DISTINCT mask, x + dx AS x, y + dy AS y FROM shapes, {disc_sql(1)} WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 47) GROUP BY mask")
def evaluation_masks(spark, sf_dir):
    """Union of a case's regions, widened."""
    return masks.evaluation_masks(masks.regions(shapes(spark, sf_dir), 64, 48, strict=False), 64, 48).groupBy("mask").agg(F.count(F.lit(1)).alias("area"))


@query(f"""WITH {DERIVED_SQL}, square AS (SELECT dx, dy FROM range(-2, 3) a(dx), range(-2, 3) b(dy)), wide AS (SELECT DISTINCT mask, x + dx AS x, y + dy AS y FROM shapes, square WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 47),
 inner_ AS (SELECT s.mask, s.x, s.y FROM shapes s, square LEFT JOIN shapes o ON o.mask = s.mask AND o.x = s.x + dx AND o.y = s.y + dy GROUP BY ALL HAVING count(CASE WHEN o.mask IS NULL AND s.x + dx BETWEEN 0 AND 63 AND s.y + dy BETWEEN 0 AND 47 THEN 1 END) = 0)
 SELECT mask, count(*) AS area FROM (SELECT * FROM wide EXCEPT SELECT * FROM inner_) GROUP BY mask""")
def mask_edges(spark, sf_dir):
    return masks.edges(shapes(spark, sf_dir), 64, 48, 2).groupBy("mask").agg(F.count(F.lit(1)).alias("area"))


# the nearest pixel outside is beside one inside: only those beside the mask are tried
@query(f"""WITH {DERIVED_SQL}, beside AS (SELECT DISTINCT mask, x + dx AS x, y + dy AS y FROM shapes, (VALUES (1,0),(-1,0),(0,1),(0,-1)) d(dx, dy)), border AS (SELECT * FROM beside EXCEPT SELECT * FROM shapes),
 far AS (SELECT s.mask, s.x, s.y, min((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) AS d FROM shapes s JOIN border b USING (mask) GROUP BY ALL) SELECT mask, x, y FROM far QUALIFY row_number() OVER (PARTITION BY mask ORDER BY d DESC, y, x) = 1""")
def mask_inner_points(spark, sf_dir):
    return masks.innermost_points(shapes(spark, sf_dir), 64, 48)


_CENTRES = "(VALUES (0, 10.0, 10.0, 4, 8), (1, 50.0, 12.0, 20, 5), (2, 30.0, 40.0, 0, 9)) c(centre, cx, cy, sx, sy)"
_FAR = "((x - cx) / greatest(1.0, sx)) * ((x - cx) / greatest(1.0, sx)) + ((y - cy) / greatest(1.0, sy)) * ((y - cy) / greatest(1.0, sy))"


@query(f"SELECT mask, centre, count(*) AS pixels FROM (SELECT mask, x, y, centre FROM pixels, {_CENTRES} QUALIFY row_number() OVER (PARTITION BY mask, x, y ORDER BY {_FAR}, centre) = 1) GROUP BY ALL")
def nearest_centres(spark, sf_dir):
    """Pixels by the nearest of three boxes' centres, in units of the boxes' sides."""
    p = pixels(spark, sf_dir)
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("centre", "cx", "cy", "sx", "sy"), r, strict=True)]) for r in ((0, 10.0, 10.0, 4, 8), (1, 50.0, 12.0, 20, 5), (2, 30.0, 40.0, 0, 9))]
    centres = p.select("mask").distinct().select("mask", F.explode(F.array(*rows)).alias("c")).select("mask", "c.*")
    return joins.nearest(p, centres, "mask").groupBy("mask", "centre").agg(F.count(F.lit(1)).alias("pixels"))


_TWO = "two AS (SELECT mask, 1 AS region, mask % 20 AS x1, mask % 13 AS y1, mask % 20 + 30 AS x2, 48 AS y2 FROM (SELECT DISTINCT mask FROM shapes) UNION ALL SELECT mask, 2, 20 + mask % 9, 10, 64, 48 FROM (SELECT DISTINCT mask FROM shapes))"


@query(f"""WITH {DERIVED_SQL}, {_TWO}, inst AS (SELECT s.mask, region, x, y FROM shapes s JOIN two USING (mask) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 AND (x + y) % 7 > 0), own AS (SELECT mask, x, y, min(region) AS region FROM inst GROUP BY ALL HAVING count(*) = 1),
 near AS (SELECT s.mask, s.x, s.y, two.region FROM shapes s JOIN two USING (mask) ANTI JOIN own USING (mask, x, y) QUALIFY row_number() OVER (PARTITION BY s.mask, s.x, s.y ORDER BY ((s.x - (x1 + x2) / 2) / (x2 - x1)) * ((s.x - (x1 + x2) / 2) / (x2 - x1)) + ((s.y - (y1 + y2) / 2) / (y2 - y1)) * ((s.y - (y1 + y2) / 2) / (y2 - y1)), two.region) = 1),
 dealt AS (SELECT mask, region, x, y FROM own UNION ALL SELECT mask, region, x, y FROM near), bad AS (SELECT mask FROM (SELECT mask, region, count(*) AS n FROM dealt GROUP BY ALL) GROUP BY mask HAVING min(n) < 16 OR count(*) < 2), again AS (SELECT * FROM shapes SEMI JOIN bad USING (mask)),
 {split_sql('again')}, {PARTS.format('again')} SELECT mask, CAST(region AS INT) AS region, count(*) AS area FROM (SELECT mask, region, x, y FROM dealt ANTI JOIN bad USING (mask) UNION ALL SELECT mask, named.region, x, y FROM parts JOIN named USING (mask, part)) GROUP BY ALL""")
def instance_partition(spark, sf_dir):
    """Masks dealt to two overlapping instances with gaps; where one would keep fewer than 16 pixels, split at the best cut instead."""
    whole, m = shapes(spark, sf_dir), F.col("mask")
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("mask")).distinct()
    box = lambda r, *v: F.struct(F.lit(r).alias("region"), *[(F.lit(x) if isinstance(x, int) else x).cast("int").alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    both = F.explode(F.array(box(1, m % 20, m % 13, m % 20 + 30, 48), box(2, 20 + m % 9, 10, 64, 48))).alias("b")
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("x1")) & (x < F.col("x2")) & (y >= F.col("y1")) & (y < F.col("y2")) & ((x + y) % 7 > 0)
    instances = whole.select("mask", "x", "y", both).select("mask", "x", "y", "b.*").filter(inside).select("mask", "region", "x", "y")
    parts = masks.partitioned(whole, instances, ids.select("mask", both).select("mask", "b.*"), 64, 48)
    return parts.groupBy("mask", "region").agg(F.sum(F.col("x2") - F.col("x1")).alias("area"))


@query(r"""SELECT mask, wanted AS target, regexp_replace(regexp_replace(instruction_original, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '-' || substr(sha256(instruction_original), 1, 8) AS file,
 replace(replace(instruction_original || '<&>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') AS escaped, contains(lower(case_id || ' ' || instruction_original), 'big') AS hit FROM selections""")
def instruction_texts(spark, sf_dir):
    """Targets by all six patterns and none, file names, escaped texts, search hits."""
    t, i = selections(spark, sf_dir), F.col("instruction_original")
    return t.select("mask", text.replacement_target(i).alias("target"), text.safe_name(i).alias("file"), text.html_escape(F.concat(i, F.lit("<&>"))).alias("escaped"), text.gallery_hit("BIG", F.col("case_id"), i).alias("hit"))


_BARE = "trim(regexp_replace(instruction_original, '\\s+', ' ', 'g'))"
_UPPER = f"regexp_replace(upper(substr({_BARE}, 1, 1)) || substr({_BARE}, 2), '\\.+$', '')"
_ONLY = f"""CASE WHEN edit_type = 'counting' OR needs_reference THEN NULL
 WHEN edit_type IN ('remove', 'multi_object_remove') THEN CASE WHEN n = 1 THEN 'Remove {{region_1}}.' ELSE 'Remove {{region_1}} and {{region_2}}.' END
 WHEN rewrite IS NOT NULL THEN rewrite WHEN edit_type = 'add' THEN 'Use {{region_1}} as the exact placement region. ' || {_UPPER} || '.'
 WHEN edit_type = 'multi_object_add' AND n = 1 THEN 'Add a ' || p_name || ' in {{region_1}}.'
 WHEN edit_type = 'multi_object_add' AND mask % 4 < 2 THEN 'Add a ' || p_name || ' in {{region_1}} and a ' || p_name || ' in {{region_2}}.'
 WHEN edit_type = 'multi_object_add' THEN 'Add a ' || p_name || ' in {{region_1}} and one ' || p_brand || ' in {{region_2}}.'
 WHEN wanted IS NOT NULL THEN 'Replace {{region_1}} with ' || wanted || '.' ELSE 'Edit {{region_1}} to match this expected result: ' || local_caption || '.' END"""
#: Regions of a selection as far as its captions allow: two captions need two regions where several objects are added.
_N = "CASE WHEN edit_type = 'multi_object_add' AND mask % 4 >= 2 THEN 2 ELSE 1 + mask % 2 END"
_SPOKEN = {
    "mask": ("the region marked by the red mask in Image 2", "R1 (red mask) in Image 2", "R2 (green mask) in Image 2"),
    "box": ("the region inside the red box in Image 2", "R1 (red box) in Image 2", "R2 (green box) in Image 2"),
    "point": ("the object or location at the center of the red point in Image 2", "the object or location at the center of R1 (red point) in Image 2", "the object or location at the center of R2 (green point) in Image 2"),
}


def _prompt_sql(only: str, kind: str) -> str:
    one, first, second = _SPOKEN[kind]
    named = f"CASE WHEN n = 1 THEN replace({only}, '{{region_1}}', '{one}') ELSE replace(replace({only}, '{{region_1}}', '{first}'), '{{region_2}}', '{second}') END"
    return f"'Edit Image 1. ' || {named} || ' Keep everything else unchanged. Return only the edited Image 1 without any markers from Image 2.'"


def _selected(spark, sf_dir):
    """Selections that aren't of polygons with their number of regions and their region-only instruction."""
    given = selections(spark, sf_dir).filter("source_dataset <> 'POLYGON'").drop("rewrite")
    rewrites = selections(spark, sf_dir).filter("rewrite is not null").select("case_id", "rewrite")
    rows = text.rewritten_instruction(given, rewrites, (F.col("source_dataset") == "EDITED") & (F.col("edit_type") == "add"))
    n = F.when((F.col("edit_type") == "multi_object_add") & (F.col("mask") % 4 >= 2), 2).otherwise(1 + F.col("mask") % 2).cast("int")
    only = text.region_only_instruction(F.col("edit_type"), F.col("n"), F.col("instruction_original"), F.col("local_caption"), F.col("rewrite"), F.col("needs_reference"))
    return rows.withColumn("n", n).withColumn("only", only)


_SELECTED = f"sel AS (SELECT *, {_ONLY} AS alone FROM (SELECT *, {_N} AS n FROM selections WHERE source_dataset <> 'POLYGON'))"


@query(f"""WITH {DERIVED_SQL}, {_SELECTED} SELECT mask, alone AS instruction, {', '.join(f"{_prompt_sql('alone', k)} AS {k}_prompt" for k in _SPOKEN)}, replace(local_caption, ' | ', CASE WHEN edit_type = 'multi_object_add' THEN '; ' ELSE ' ;  ' END) AS content FROM sel""")
def region_instructions(spark, sf_dir):
    """Region-only instructions of every edit type, the prompts of all three locators, and the texts of what regions are to show."""
    rows = _selected(spark, sf_dir)
    return rows.select("mask", F.col("only").alias("instruction"), *[text.locator_prompt(F.col("only"), F.col("n"), k).alias(f"{k}_prompt") for k in _SPOKEN], text.local_content(F.col("edit_type"), F.col("local_caption")).alias("content"))


_PREPARED = "prepared AS (" + " UNION ALL ".join(
    [f"SELECT mask AS eval_index, 'text_only' AS setting, {_BARE} AS prompt, 'source' AS roles, 'source/' || lpad(mask::VARCHAR, greatest(4, length(mask::VARCHAR))::INT, '0') || '.png' AS images FROM sel WHERE alone IS NOT NULL"]
    + [f"SELECT mask, '{k}_annotation', {_prompt_sql('alone', k)}, 'source,{k}', 'source/' || lpad(mask::VARCHAR, greatest(4, length(mask::VARCHAR))::INT, '0') || '.png,{k}/' || lpad(mask::VARCHAR, greatest(4, length(mask::VARCHAR))::INT, '0') || '.png' FROM sel WHERE alone IS NOT NULL" for k in _SPOKEN]
) + ")"


def _prepared(spark, sf_dir):
    rows = _selected(spark, sf_dir).filter("only is not null")
    return prepare.prepared(rows.select(F.col("mask").alias("eval_index"), F.col("n").alias("region_count"), text.clean(F.col("instruction_original")).alias("instruction"), F.col("only").alias("region_instruction")))


@query(f"WITH {DERIVED_SQL}, {_SELECTED}, {_PREPARED} SELECT * FROM prepared")
def prepared_inputs(spark, sf_dir):
    return _prepared(spark, sf_dir).select("eval_index", "setting", "prompt", F.array_join("roles", ",").alias("roles"), F.array_join("images", ",").alias("images"))


@query(f"""WITH {DERIVED_SQL}, {_SELECTED}, {_PREPARED}, cut AS (SELECT * FROM prepared WHERE NOT (eval_index % 10 = 0 AND setting = 'box_annotation') AND eval_index % 17 > 0),
 per AS (SELECT eval_index, count(*) AS n FROM cut GROUP BY eval_index) SELECT eval_index, 'settings' AS rule FROM per WHERE n <> 4 UNION ALL SELECT eval_index, 'gap' FROM per WHERE eval_index <> 0 AND eval_index - 1 NOT IN (SELECT eval_index FROM per)
 UNION ALL SELECT DISTINCT eval_index, 'prompt' FROM cut WHERE eval_index % 6 = 1 UNION ALL SELECT DISTINCT eval_index, 'roles' FROM cut WHERE setting = 'mask_annotation' AND eval_index % 4 = 1 UNION ALL SELECT DISTINCT eval_index, 'protocol' FROM cut WHERE eval_index % 9 = 4""")
def prepared_errors(spark, sf_dir):
    """What a damaged table of prepared inputs breaks."""
    i = F.col("eval_index")
    rows = _prepared(spark, sf_dir).filter(~((i % 10 == 0) & (F.col("setting") == "box_annotation")) & (i % 17 > 0))
    wrong = {"prompt": F.when(i % 6 == 1, " \t").otherwise(F.col("prompt")), "roles": F.when((i % 4 == 1) & (F.col("setting") == "mask_annotation"), F.array(F.lit("source"), F.lit("target"))).otherwise(F.col("roles")), "protocol": F.when(i % 9 == 4, "old").otherwise("new")}
    return prepare.contract(rows.withColumns(wrong), "new")


@query(f"WITH {DERIVED_SQL}, {_SELECTED}, {_PREPARED} SELECT eval_index, setting FROM prepared WHERE eval_index % 4 = 1 AND setting = 'mask_annotation'")
def leaking_inputs(spark, sf_dir):
    """Inputs that would show the target."""
    bad = (F.col("eval_index") % 4 == 1) & (F.col("setting") == "mask_annotation")
    return prepare.leaks_target(_prepared(spark, sf_dir).withColumn("roles", F.when(bad, F.array(F.lit("source"), F.lit("target"))).otherwise(F.col("roles")))).select("eval_index", "setting")


@query(f"""WITH {DERIVED_SQL}, {_SELECTED} SELECT mask, 'edit_type' AS field FROM sel WHERE mask % 5 = 1 AND mask % 8 > 0 UNION ALL SELECT mask, 'instruction_original' FROM sel WHERE mask % 6 = 4 AND mask % 8 > 0 UNION ALL SELECT mask, 'missing' FROM sel WHERE mask % 8 = 0""")
def frozen_differences(spark, sf_dir):
    """Fields in which a frozen copy of a table differs from it, row by row."""
    rows = _selected(spark, sf_dir).select("mask", "case_id", "edit_type", "instruction_original", "target_prompt")
    m = F.col("mask")
    frozen = rows.filter(m % 8 > 0).withColumns({"edit_type": F.when(m % 5 == 1, "other").otherwise(F.col("edit_type")), "instruction_original": F.when(m % 6 == 4, None).otherwise(F.col("instruction_original"))})
    return joins.same_rows(rows, frozen, "mask", ["case_id", "edit_type", "instruction_original", "target_prompt"])


_PATH = "lower(source_dataset)"
_FILE = "regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '-' || substr(sha256({0}), 1, 8)"
_STATED = "CASE WHEN source_dataset = 'POLYGON' THEN region_only ELSE alone END"
_FAR_IN = "beside AS (SELECT DISTINCT mask, region, x + dx AS x, y + dy AS y FROM regs, (VALUES (1,0),(-1,0),(0,1),(0,-1)) d(dx, dy)), border AS (SELECT * FROM beside EXCEPT SELECT mask, region, x, y FROM regs), far AS (SELECT s.mask, s.region, s.x, s.y, min((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) AS d FROM regs s JOIN border b USING (mask, region) GROUP BY ALL), deep AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY mask, region ORDER BY d DESC, y, x) = 1)"


@query(f"""WITH {DERIVED_SQL}, {_REGIONS}, {_FAR_IN}, bx AS (SELECT mask, region, greatest(0, min(x) - 1) AS x1, greatest(0, min(y) - 1) AS y1, least(64, max(x) + 2) AS x2, least(48, max(y) + 2) AS y2 FROM regs GROUP BY ALL), cnt AS (SELECT mask, max(region) AS n FROM regs GROUP BY mask),
 sel AS (SELECT *, {_ONLY} AS alone FROM selections JOIN cnt USING (mask) WHERE edit_type <> 'multi_object_add' OR mask % 4 < 2 OR n = 2)
 SELECT case_id AS id, bx.region, {_PATH} AS source_dataset, CASE edit_type WHEN 'multi_object_add' THEN 'add' WHEN 'multi_object_remove' THEN 'remove' ELSE edit_type END AS edit_type, 'images/source/' || {_PATH} || '/' || {_FILE.format('source_group')} || '.png' AS source_image,
 {_BARE} AS located, {_STATED} AS regional, 'regions/input/' || {_PATH} || '/' || {_FILE.format('case_id')} || '_r' || lpad(bx.region::VARCHAR, 2, '0') || '.png' AS mask_path, x1 || ',' || y1 || ',' || x2 || ',' || y2 AS box, deep.x || ',' || deep.y AS point,
 CASE WHEN source_dataset <> 'POLYGON' THEN 'images/target/' || {_PATH} || '/' || {_FILE.format('case_id')} || '.png' END AS reference, trim(regexp_replace(target_prompt, '\\s+', ' ', 'g')) AS expected, coalesce(same_class, true) AS same_class FROM sel JOIN bx USING (mask) JOIN deep USING (mask, region)""")
def built_cases(spark, sf_dir):
    """Nested cases from selections and derived regions, one row a region."""
    found = order.held(build.region_assets(shapes(spark, sf_dir), 64, 48, strict=False))
    chosen = selections(spark, sf_dir).join(met(found), "mask")
    fits = (F.col("edit_type") != "multi_object_add") | (F.col("mask") % 4 < 2) | (F.size("regions") == 2)
    rows = build.built_cases(chosen.filter(fits).drop("regions"), chosen.select("case_id", "regions"))
    flat = rows.select("*", F.posexplode("regions").alias("at", "r"))
    return flat.select(
        "id", (F.col("at") + 1).alias("region"), "source_dataset", "edit_type", "source_image", F.col("instruction.with_location_reference").alias("located"), F.col("instruction.region_only").alias("regional"),
        F.col("r.mask").alias("mask_path"), F.array_join("r.box", ",").alias("box"), F.array_join("r.point", ",").alias("point"), F.col("target.reference_image").alias("reference"),
        F.col("target.expected_global_description").alias("expected"), F.col("difficulty.same_class_multi_instance").alias("same_class"),
    )


@query("SELECT eval_index, sha256('{\"case_id\": \"' || case_id || '\", \"eval_index\": ' || eval_index || '}') AS digest FROM cases")
def case_digests(spark, sf_dir):
    rows = cases(spark, sf_dir)
    return rows.select("eval_index", record_functions.digest_of({c: rows.schema[c].dataType for c in ("case_id", "eval_index")}).alias("digest"))


@query("""SELECT CASE WHEN l_linenumber > 4 THEN 'axis' WHEN l_linenumber = 4 THEN 'trailing' ELSE 'good' END AS reply, count(*) AS n, count(CASE WHEN l_linenumber < 4 THEN 1 END) AS accepted, sum(CASE WHEN l_linenumber < 4 THEN l_linenumber END)::BIGINT AS edits FROM lineitem GROUP BY ALL""")
def parsed_replies(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n > 4, "axis").when(n == 4, "trailing").otherwise("good")
    body = F.concat(F.lit('<think>hm</think>{"edit": '), n.cast("string"), F.lit(', "preservation": 3, "quality": null, "edit_evidence": "a", "preservation_evidence": "b", "quality_evidence": "c"}'), F.when(n == 4, " and more").otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select(kind.alias("reply"), record_functions.parsed(body).alias("p"))
    return rows.groupBy("reply").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p.error").isNull()).alias("accepted"), F.sum("p.edit").alias("edits"))


_REPLY = """'<think>hm</think>{{"edit": ' || coalesce({0}edit::VARCHAR, 'null') || ', "preservation": ' || coalesce({0}preservation::VARCHAR, 'null') || ', "quality": ' || coalesce({0}quality::VARCHAR, 'null') || ', "edit_evidence": "e", "preservation_evidence": "p", "quality_evidence": "q"}}'"""


def _recorded_jobs(spark, sf_dir):
    """Jobs of all cases with the replies that were recorded for them, two at most, as their prompt."""
    r = records(spark, sf_dir)
    score = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    good = F.concat(F.lit('<think>hm</think>{"edit": '), score("edit"), F.lit(', "preservation": '), score("preservation"), F.lit(', "quality": '), score("quality"), F.lit(', "edit_evidence": "e", "preservation_evidence": "p", "quality_evidence": "q"}'))
    said = F.when(F.col("status") == "judge_parse_error", F.lit("I can't say")).otherwise(good)
    reply = F.struct("line", F.struct(said.alias("text"), F.when(F.col("status") == "pending", "length").otherwise("stop").alias("finish_reason")).alias("r"))
    replies = joins.by_case(r, F.to_json(F.slice(F.transform(F.array_sort(F.collect_list(reply)), lambda x: x["r"]), 1, 2)))
    rows = cases(spark, sf_dir).select("eval_index", "case_id", "edit_type", "source_dataset", "split").join(met(replies), "eval_index", "left")
    all_jobs = judge.jobs(rows, r, "run-1", conflicts=cases(spark, sf_dir).filter("eval_index % 50 = 21"))
    return all_jobs.withColumns({"prompt": F.try_element_at("held", F.struct("method", "setting")), "source_image": F.lit("before.png"), "output_image": F.lit("after.png")}).drop("held")


_TRIED = f"""tried AS (SELECT eval_index, method, setting, line, status, edit, preservation, quality, row_number() OVER (PARTITION BY eval_index, method, setting ORDER BY line) AS turn FROM records),
 ok AS (SELECT *, status NOT IN ('judge_parse_error', 'pending') AS good FROM tried WHERE turn <= 2),
 done AS (SELECT eval_index, method, setting, min(turn) FILTER (good) AS turn FROM ok GROUP BY ALL),
 result AS (SELECT g.eval_index, g.method, g.setting, CASE WHEN d.eval_index IS NULL THEN 'missing_output' WHEN g.eval_index % 50 = 21 THEN 'annotation_conflict' WHEN d.turn IS NULL THEN 'judge_parse_error' ELSE 'ok' END AS status, d.turn FROM grid g LEFT JOIN done d USING (eval_index, method, setting)),
 scored_result AS (SELECT r.*, CASE WHEN r.status = 'ok' THEN o.edit END AS edit, CASE WHEN r.status IN ('missing_output', 'annotation_conflict') THEN 0 ELSE coalesce(r.turn, 2) END AS attempts FROM result r LEFT JOIN ok o ON o.eval_index = r.eval_index AND o.method = r.method AND o.setting = r.setting AND o.turn = r.turn)"""


@query(f"WITH {DERIVED_SQL}, {_GRID}, {_TRIED} SELECT method, setting, status, CAST(attempts AS INT) AS attempts, count(*) AS n, sum(edit)::BIGINT AS edits FROM scored_result GROUP BY ALL")
def judged_jobs(spark, sf_dir):
    """Recorded replies judged again: malformed and cut ones are asked for once more."""
    got = judge.judged(_recorded_jobs(spark, sf_dir), judge.recorded())
    return got.groupBy("method", "setting", "status", F.size("attempts").alias("attempts")).agg(F.count(F.lit(1)).alias("n"), F.sum("edit").alias("edits"))


_JOB_JSON = """'{"case_id": "' || case_id || '", "edit_type": "' || edit_type || '", "eval_index": ' || eval_index || ', "method": "' || method || '", "setting": "' || setting || '", "source_dataset": "' || source_dataset || '", "split": "' || split || '"}'"""


@query(f"""WITH {DERIVED_SQL}, {_GRID}, d AS (SELECT *, sha256({_JOB_JSON}) AS input_digest FROM grid JOIN cases USING (eval_index))
 SELECT lpad(eval_index::VARCHAR, greatest(4, length(eval_index::VARCHAR))::INT, '0') || '/' || method || '/' || setting AS sample_id, input_digest, sha256('{{"input": "' || input_digest || '", "run_id": "run-1", "variant": "first"}}') AS key FROM d""")
def job_keys(spark, sf_dir):
    """Digests of all jobs' inputs and keys of their records."""
    rows = cases(spark, sf_dir, by_case=True).select("eval_index", "case_id", "edit_type", "source_dataset", "split")
    return judge.jobs(rows, records(spark, sf_dir), "run-1", by_case=True).select("sample_id", "input_digest", "key")


@query(f"WITH {DERIVED_SQL} SELECT eval_index, method, setting, row_number() OVER (ORDER BY list_position({list(METHODS)!r}, method), list_position({list(SETTINGS)!r}, setting), eval_index) - 1 AS position FROM judge_records")
def job_order(spark, sf_dir):
    return judge.ordered(judge_records(spark, sf_dir).select("eval_index", "method", "setting"))


@query(f"WITH {DERIVED_SQL}, {_GRID}, p AS (SELECT *, row_number() OVER (ORDER BY list_position({list(METHODS)!r}, method), list_position({list(SETTINGS)!r}, setting), eval_index) - 1 AS position FROM grid JOIN cases USING (eval_index)) SELECT eval_index, method, setting, position FROM p WHERE split = 'dev' ORDER BY position LIMIT 500")
def dev_jobs(spark, sf_dir):
    """The first jobs of the development split in job order."""
    rows = joins.expected_jobs(cases(spark, sf_dir).select("eval_index", "split"))
    return judge.selected(judge.ordered(rows), "dev", 500).select("eval_index", "method", "setting", "position")


_RUBRIC = "Judge the edit."


@query(f"""WITH {DERIVED_SQL}, {_SELECTED} SELECT mask, 'Judge the edit.' || chr(10) || 'TASK:' || chr(10) || '{{"instruction": "' || instruction_original || '", "region_instruction": ' || coalesce('"' || alone || '"', 'null') || ', "target_contours": [' || CASE WHEN n = 1 THEN '"R1 = red contour"' ELSE '"R1 = red contour", "R2 = green contour"' END || ']}}' AS prompt FROM sel""")
def judge_prompts(spark, sf_dir):
    rows = _selected(spark, sf_dir)
    return rows.select("mask", text.judge_prompt(_RUBRIC, F.col("instruction_original"), F.col("only"), F.col("n")).alias("prompt"))


@query()
def method_comparison(spark, sf_dir):
    return compare.comparison(records(spark, sf_dir))


_PLAN = """plan AS (SELECT l_orderkey AS eval_index, ['text_only','mask_annotation','box_annotation','point_annotation'][(l_partkey % 4) + 1] AS setting, l_suppkey % 3 AS model,
 CAST(l_partkey % 5 AS DOUBLE) AS x1, CAST(l_suppkey % 4 AS DOUBLE) AS y1, CAST(l_linenumber AS DOUBLE) AS x2, CAST(3 AS DOUBLE) AS y2, CASE WHEN l_linenumber = 5 THEN ' ' ELSE 'hint' END AS hint FROM lineitem)"""


@query(f"""WITH {_PLAN} SELECT model, count(*) AS scanned, count(CASE WHEN x1 = 1 AND y1 = 2 AND x2 = 3 OR x1 = 0 AND y1 = 0 AND x2 = 4 THEN 1 END) AS records,
 count(DISTINCT eval_index) FILTER (x1 = 1 AND y1 = 2 AND x2 = 3 OR x1 = 0 AND y1 = 0 AND x2 = 4) AS cases, count(DISTINCT (eval_index, setting)) FILTER (x1 = 1 AND y1 = 2 AND x2 = 3 OR x1 = 0 AND y1 = 0 AND x2 = 4) AS case_settings,
 count(CASE WHEN x2 > x1 AND y2 > y1 AND trim(hint) <> '' THEN 1 END) AS usable_regions FROM plan GROUP BY model""")
def planner_audit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    box = F.array((F.col("l_partkey") % 5).cast("double"), (F.col("l_suppkey") % 4).cast("double"), n.cast("double"), F.lit(3.0))
    region = F.struct(box.alias("box"), F.when(n == 5, " ").otherwise("hint").alias("hint"))
    rows = li.select(F.col("l_orderkey").alias("eval_index"), F.element_at(F.array(*[F.lit(s) for s in SETTINGS]), (F.col("l_partkey") % 4).cast("int") + 1).alias("setting"), (F.col("l_suppkey") % 3).alias("model"), F.array(region).alias("regions"))
    return audit.planner_audit(rows, [(1, 2, 3, 3), (0, 0, 4, 3)], "model")


@query("SELECT count(*) AS n, count(DISTINCT eval_index) AS \"distinct\", min(eval_index) AS least, max(eval_index) AS greatest, count(*) = count(DISTINCT eval_index) AND min(eval_index) = 0 AND max(eval_index) = count(*) - 1 AS gap_free FROM cases")
def index_check(spark, sf_dir):
    return audit.index_gaps(cases(spark, sf_dir))


_VALUES = "vals AS (SELECT l_suppkey AS mask, l_orderkey AS x, l_linenumber AS y, CASE l_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE CAST(l_partkey % 256 AS INT) END AS v FROM lineitem)"


@query(f"WITH {_VALUES} SELECT mask, count(CASE WHEN v NOT IN (0, 255) THEN 1 END) = 0 AS only_binary, count(CASE WHEN v = 255 THEN 1 END) > 0 AS has_region FROM vals GROUP BY mask")
def binary_mask_assets(spark, sf_dir):
    p = F.col("l_partkey")
    v = F.when(p % 3 == 0, 0).when(p % 3 == 1, 255).otherwise((p % 256).cast("int"))
    return audit.binary_assets(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("mask"), v.alias("v")))


@query(f"WITH {_VALUES} SELECT mask, count(CASE WHEN v >= 128 THEN 1 END) AS above, count(CASE WHEN v < 128 THEN 1 END) AS below FROM vals GROUP BY mask HAVING count(CASE WHEN v >= 128 THEN 1 END) > 0 AND count(CASE WHEN v < 128 THEN 1 END) > 0")
def mask_thresholds(spark, sf_dir):
    p = F.col("l_partkey")
    v = F.when(p % 3 == 0, 0).when(p % 3 == 1, 255).otherwise((p % 256).cast("int"))
    values = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("mask"), F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), v.alias("v"))
    above = audit.thresholded(values).groupBy("mask").agg(F.count(F.lit(1)).alias("above"))
    return above.join(audit.thresholded(values, inverted=True).groupBy("mask").agg(F.count(F.lit(1)).alias("below")), "mask")


@query("SELECT mask, bx1, by1, bx2, by2, count(CASE WHEN x >= 0 AND x < 31 AND y >= 5 AND y < 48 THEN 1 END) / (31 * 43.0) AS coverage FROM (SELECT mask, x, y, -3.5::DOUBLE AS bx1, 5.2::DOUBLE AS by1, 30.1::DOUBLE AS bx2, 55.5::DOUBLE AS by2 FROM pixels) GROUP BY ALL")
def box_coverage(spark, sf_dir):
    """Coverage of a box that reaches beyond the canvas."""
    p = pixels(spark, sf_dir)
    boxed = p.select("mask").distinct().select("mask", F.lit(-3.5).alias("bx1"), F.lit(5.2).alias("by1"), F.lit(30.1).alias("bx2"), F.lit(55.5).alias("by2"))
    return masks.coverage(p, boxed, 64, 48)


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 2""")
def top_candidates(spark, sf_dir):
    tie = F.struct("l_partkey", "l_suppkey", "l_quantity").alias("tie")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("score"), tie)
    return order.top_candidates(rows, "k", "score", "tie", 2).select("k", "n", "score", "rank")


@query(f"WITH {_LINE_BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x2 - x1 DESC, n, x1, y1, y2) AS nth FROM lb), a AS (SELECT * FROM o WHERE nth = 1), s AS (SELECT a.k, min(b.nth) AS nth FROM a JOIN o b ON a.k = b.k AND b.nth > 1 WHERE {_BOTH} < 0.65 GROUP BY a.k) SELECT o.k, CAST(CASE WHEN any_value(s.nth) IS NULL THEN 1 ELSE 2 END AS INT) AS kept, CAST(count(*) AS INT) AS boxes FROM o LEFT JOIN s USING (k) GROUP BY o.k")
def boxes_apart(spark, sf_dir):
    """Per case the boxes, widest first, that overlap none kept before by 0.65, two at most."""
    boxes = _boxes(spark, sf_dir).withColumn("w", F.element_at("box", 3) - F.element_at("box", 1))
    listed = boxes.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "n", "box"))), lambda s: s["box"]).alias("boxes"))
    return listed.select("k", F.size(order.greedy_apart(F.col("boxes"), geometry.box_iou, 2)).alias("kept"), F.size("boxes").alias("boxes"))


@query("SELECT l_orderkey AS eval_index, CASE WHEN count(DISTINCT l_linenumber % 3) = 1 THEN ['add', 'remove', 'replace'][any_value(l_linenumber % 3) + 1] ELSE 'mixed' END AS operation FROM lineitem GROUP BY l_orderkey")
def case_operations(spark, sf_dir):
    first = F.element_at(F.array(F.lit("Add a hat"), F.lit(" remove it"), F.lit("Make it blue")), (F.col("l_linenumber") % 3) + 1)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("eval_index"), text.operation(first).alias("o"))
    return rows.groupBy("eval_index").agg(text.aggregate_operation(F.collect_list("o")).alias("operation"))


@query("SELECT p_partkey, 'Move the ' || p_name || ', and paint the ' || p_brand || '.' AS located, 'For {region_1}, move the ' || p_name || '. For {region_2}, paint the ' || p_brand || '.' AS regional FROM part")
def clause_instructions(spark, sf_dir):
    whole = F.concat(F.lit("move the "), "p_name", F.lit(", and lift it, AND turn it, and paint the "), "p_brand", F.lit(".,  and stop"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.clauses(whole).alias("c"))
    picked = F.array(F.element_at("c", 1), F.element_at("c", 4))
    return rows.select("p_partkey", text.location_instruction(F.col("c"), F.array(F.lit(1), F.lit(4))).alias("located"), text.region_instruction(picked).alias("regional"))


@query("SELECT eval_index, line, list_sort(list_filter([CASE WHEN edit IS DISTINCT FROM 4 THEN 'edit' END, CASE WHEN quality IS DISTINCT FROM 3 THEN 'quality' END], lambda x: x IS NOT NULL))::VARCHAR AS differing FROM records")
def score_disagreements(spark, sf_dir):
    want = F.create_map(F.lit("edit"), F.lit(4), F.lit("quality"), F.lit(3))
    have = F.create_map(F.lit("edit"), F.col("edit"), F.lit("quality"), F.col("quality"))
    keys = F.array_sort(F.map_keys(summary.disagreements(want, have)))
    return records(spark, sf_dir).select("eval_index", "line", F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("differing"))


from . import case_queries, picture_queries  # noqa: E402, F401  register their queries here
