"""Aggregations over judge records (columns status, edit, preservation, quality, all_edits_success, strict_success, keys)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AXES, BOOTSTRAP_DRAWS, BOOTSTRAP_QUANTILES, BOOTSTRAP_SEED, METHODS, SETTINGS
from ..functions import logic


def rate_columns(success: str, status: str = "status") -> list[Column]:
    """Counts, coverage, the rate where decidable, and bounds with unknowns as failures or successes; null where nothing divides."""
    value = logic.counted(F.col(status), F.col(success))
    yes, no, n = F.count_if(value), F.count_if(~value), F.count(F.lit(1))
    return [
        yes.alias(f"{success}_success"), no.alias(f"{success}_failure"), (n - yes - no).alias(f"{success}_unknown"),
        F.try_divide(yes + no, n).alias(f"{success}_coverage"), F.try_divide(yes, yes + no).alias(f"{success}_rate"),
        F.try_divide(yes, n).alias(f"{success}_lower"), F.try_divide(n - no, n).alias(f"{success}_upper"),
    ]


def axis_columns(axis: str) -> list[Column]:
    v = F.col(axis)
    return [F.avg(v).alias(f"{axis}_mean"), F.count(v).alias(f"{axis}_decidable"), (F.count(F.lit(1)) - F.count(v)).alias(f"{axis}_unknown"), *[F.count_if(v == s).alias(f"{axis}_{s}") for s in range(5)]]


def summary_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *rate_columns("all_edits_success"), *rate_columns("strict_success"), *[c for a in AXES for c in axis_columns(a)]]


def summarize(records: DataFrame, *keys: str) -> DataFrame:
    """One row per group with everything a report says of it."""
    return records.groupBy(*keys).agg(*summary_columns())


def distribution(records: DataFrame, value: str, *keys: str) -> DataFrame:
    """Counts of each value as a map, null values left out."""
    counts = records.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), F.col("count"))))).alias("distribution"))


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, value, count) for each column, in one reading."""
    sets = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(sets).alias("s")).groupBy("s.column", "s.value").agg(F.count(F.lit(1)).alias("count"))


def breakdown(records: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Means and rates by (dimension, method) for several dimensions at once: grouping sets over one reading."""
    v = records.select("method", *dimensions, *AXES, "status", "strict_success")
    sets = [[F.col(d), F.col("method")] for d in dimensions]
    grouped = v.groupingSets(sets, *[F.col(d) for d in dimensions], F.col("method")).agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"{a}_mean") for a in AXES], *rate_columns("strict_success")[:5]
    )
    width = len(dimensions) + 1
    which = F.coalesce(*[F.when(F.col("set").bitwiseAND(1 << (width - 1 - i)) == 0, F.lit(d)) for i, d in enumerate(dimensions)])
    value = F.coalesce(*[F.when(F.col("set").bitwiseAND(1 << (width - 1 - i)) == 0, F.col(d).cast("string")) for i, d in enumerate(dimensions)])
    return grouped.select(which.alias("dimension"), value.alias("value"), "method", "n", *[f"{a}_mean" for a in AXES], "strict_success_success", "strict_success_failure", "strict_success_unknown", "strict_success_coverage", "strict_success_rate")


def mean_matrix(records: DataFrame, axis: str, rows: str = "method", columns: str = "setting", values: Sequence[str] = SETTINGS) -> DataFrame:
    return records.groupBy(rows).pivot(columns, list(values)).agg(F.avg(axis))


def method_table(records: DataFrame, order: Sequence[str] = METHODS) -> DataFrame:
    """Summary of each method with its distinct cases and its place in the stated order; an unknown method is an error."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method")) - 1
    known = F.when(place >= 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown method: "), F.col("method"))).cast("long"))
    return records.groupBy("method").agg(F.countDistinct("eval_index").alias("cases"), *summary_columns()).withColumn("position", known)


def bootstrap(records: DataFrame, *keys: str, axes: Sequence[str] = AXES, draws: int = BOOTSTRAP_DRAWS, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Interval of each axis mean by resampling cases with replacement.

    Cases matter only by their (sum, count) of scores, of which there are few; a resample is a multinomial draw over
    those pairs. So a group never holds its cases, whatever their number.
    """
    long = records.select(*keys, "eval_index", F.explode(F.create_map(*[c for a in axes for c in (F.lit(a), F.col(a))])).alias("axis", "score")).filter("score is not null")
    by_case = long.groupBy(*keys, "axis", "eval_index").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("scores"))
    pairs = by_case.groupBy(*keys, "axis", "total", "scores").agg(F.count(F.lit(1)).alias("cases"))

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["total", "scores"])
        n = rows["cases"].to_numpy()
        drawn = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), draws)
        means = (drawn @ rows["total"].to_numpy()) / (drawn @ rows["scores"].to_numpy())
        low, high = np.quantile(means, BOOTSTRAP_QUANTILES)
        mean = float((n * rows["total"]).sum() / (n * rows["scores"]).sum())
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in (*keys, "axis")}, "cases": int(n.sum()), "mean": mean, "low": low, "high": high}])

    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys, "axis").applyInPandas(interval, f"{kinds}{', ' if keys else ''}axis string, cases long, mean double, low double, high double")


SAMPLE = ("eval_index", "method", "setting")


def _pairs(records: DataFrame, reference: str) -> DataFrame:
    """(sample, variant, ok, changed, strict): each other variant's first record of a sample with the reference's."""
    cut = lambda v: records.filter(v).groupBy(*SAMPLE, "variant").agg(F.min_by(F.struct("status", *AXES, "strict_success"), "line").alias("r"))
    a = cut(F.col("variant") == reference).select(*SAMPLE, F.col("r").alias("a"))
    b = cut(F.col("variant") != reference).select(*SAMPLE, "variant", F.col("r").alias("b"))
    changed = F.lit(False)
    for axis in AXES:
        changed = changed | ~F.col(f"a.{axis}").eqNullSafe(F.col(f"b.{axis}"))
    ok = (F.col("a.status") == "ok") & (F.col("b.status") == "ok")
    return a.join(b, list(SAMPLE)).select(*SAMPLE, "variant", ok.alias("ok"), changed.alias("changed"), (~F.col("a.strict_success").eqNullSafe(F.col("b.strict_success"))).alias("strict"))


def stability(records: DataFrame, reference: str, samples: DataFrame | None = None) -> DataFrame:
    """Each other variant against the reference over all samples: pairs that are both ok, all other samples, and pairs that differ on any axis or in success.

    samples: the distinct samples of the run; those of the records unless given.
    """
    total = (records.select(*SAMPLE).distinct() if samples is None else samples).agg(F.count(F.lit(1)).alias("total"))
    both = _pairs(records, reference).groupBy("variant").agg(F.count_if("ok").alias("paired"), F.count_if(F.col("ok") & F.col("changed")).alias("any_axis_changed"), F.count_if(F.col("ok") & F.col("strict")).alias("strict_changed"))
    others = records.select("variant").filter(F.col("variant") != reference).distinct().join(F.broadcast(total))  # one row
    none = {c: F.coalesce(c, F.lit(0)) for c in ("paired", "any_axis_changed", "strict_changed")}
    return others.join(both, "variant", "left").withColumns(none).select(F.lit(reference).alias("reference"), "variant", "paired", (F.col("total") - F.col("paired")).alias("unpaired"), "any_axis_changed", "strict_changed")


def changed_samples(records: DataFrame, reference: str) -> DataFrame:
    """(sample, variant, any_axis, strict): the samples behind the counts of stability."""
    return _pairs(records, reference).filter("ok and (changed or strict)").select(*SAMPLE, "variant", F.col("changed").alias("any_axis"), "strict")


def control_counts(records: DataFrame, expected: Column, *keys: str) -> DataFrame:
    """Confusion counts of all_edits_success against an expectation; an unknown result of a labelled control is unresolved."""
    e, v = expected, F.col("all_edits_success")
    known = e.isNotNull()
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(known).alias("binary_labeled"), F.count_if(known & v.isNull()).alias("unresolved"),
        F.count_if(e & v).alias("true_positive"), F.count_if(e & ~v).alias("false_negative"), F.count_if(~e & v).alias("false_positive"), F.count_if(~e & ~v).alias("true_negative"),
    )


def disagreements(expected: Column, actual: Column) -> Column:
    """Axes of a map of expectations whose actual value is another or unknown."""
    return F.map_filter(expected, lambda k, v: ~v.eqNullSafe(F.element_at(actual, k)))


def out_of_range(ranges: Column, actual: Column) -> Column:
    """Axes of a map of expected ranges (low, high) whose actual value is unknown or outside."""
    return F.map_filter(ranges, lambda k, r: ~F.coalesce(F.element_at(actual, k).between(r["low"], r["high"]), F.lit(False)))


def record_summary(records: DataFrame) -> DataFrame:
    """One row: records, seconds they took in all (unknown counts as none), and those made from another output."""
    return records.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.coalesce(F.col("elapsed_seconds"), F.lit(0.0))), F.lit(0.0)).alias("elapsed_seconds_total"), F.count("derived_from_output").alias("derived_outputs"))


def record_summaries(records: DataFrame, *dimensions: str) -> DataFrame:
    """record_summary of all records (a row without dimensions) and of each value of each dimension, in one pass."""
    sets = [[], *[[F.col(d)] for d in dimensions]]
    seconds = F.coalesce(F.sum(F.coalesce(F.col("elapsed_seconds"), F.lit(0.0))), F.lit(0.0)).alias("elapsed_seconds_total")
    return records.groupingSets(sets, *dimensions).agg(F.count(F.lit(1)).alias("count"), seconds, F.count("derived_from_output").alias("derived_outputs"))


def first_seen(rows: DataFrame, group: str, by: str) -> DataFrame:
    """(group, position): groups in the order in which they first come, by a column that orders rows. Groups are few."""
    seen = rows.groupBy(group).agg(F.min(by).alias("at"))
    return seen.select(group, (F.row_number().over(Window.orderBy("at", group)) - 1).cast("long").alias("position"))


def case_summary(records: DataFrame, methods: Sequence[str] = METHODS, settings: Sequence[str] = SETTINGS) -> DataFrame:
    """One row per case: usable records, best and mean edit, successes by method and setting, and the ordered strict outputs."""
    ok = logic.usable(F.col("status"), *[F.col(a) for a in AXES])
    strict = ok & logic.strict_or_false(*[F.col(a) for a in AXES])
    place = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
    # distinct values as bits of a sum: two distinct counts would send every row three times
    bits = lambda use, values, c: F.coalesce(F.bit_count(F.bit_or(F.when(use, F.call_function("shiftleft", F.lit(1), place(values, c).cast("int"))))), F.lit(0)).cast("long")
    output = F.struct(place(methods, "method").alias("m"), place(settings, "setting").alias("s"), "method", "setting")
    return records.groupBy("eval_index").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("usable"), F.avg(F.when(ok, F.col("edit"))).alias("edit_mean"), F.max(F.when(ok, F.col("edit"))).alias("edit_max"),
        F.count_if(ok & (F.col("edit") == 4)).alias("edit_successes"), F.count_if(strict).alias("strict_successes"),
        *[F.max(F.when(ok & (F.col("method") == m), F.col("edit"))).alias(f"best_{m}") for m in methods],
        *[F.count_if(strict & (F.col("method") == m)).alias(f"strict_{m}") for m in methods],
        *[F.max(F.when(ok & (F.col("setting") == s), F.col("edit"))).alias(f"best_{s}") for s in settings],
        bits(strict, methods, "method").alias("strict_methods"), bits(strict, settings, "setting").alias("strict_settings"),
        F.transform(F.array_sort(F.collect_list(F.when(strict, output))), lambda x: F.concat(x["method"], F.lit("/"), x["setting"])).alias("strict_outputs"),
    )


def failure_tiers(summary: DataFrame, complete: int = len(METHODS) * len(SETTINGS), many: int = 5, settings: Sequence[str] = SETTINGS) -> DataFrame:
    """(tier, eval_index) of every complete case and tier it falls into, in one pass of flags."""
    s, few = F.col("strict_successes"), F.col("strict_methods") <= 2
    one = F.col("strict_settings") == 1
    tiers = {"edit_at_most_1": F.col("edit_max") <= 1, "edit_at_most_2": F.col("edit_max") <= 2, "no_edit_success": F.col("edit_successes") == 0, "no_strict_success": s == 0}
    tiers |= {f"strict_at_most_{k}": s <= k for k in (1, 2, 3, 4)}
    tiers |= {"strict_in_few_methods": (s >= many) & few, "strict_in_one_setting": (s >= many) & one, "concentrated": (s >= many) & (few | one)}
    tiers |= {f"{x}_edit_at_most_1": F.col(f"best_{x}") <= 1 for x in settings}
    flags = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in tiers.items()]))
    return summary.filter(F.col("usable") == complete).select(F.explode(flags).alias("tier"), "eval_index")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def progress(done: DataFrame, expected: DataFrame, *keys: str, when: str = "updated_at", per_key: int = 1) -> DataFrame:
    """Done rows of each expected key, zero where none is, with the time of the last and the share of per_key."""
    n = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("done"), F.max(when).alias("latest"))
    full = expected.join(n, list(keys), "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return full.withColumn("percent", F.bround(100 * F.col("done") / per_key, 2))


def latest_done(done: DataFrame, *columns: str, when: str = "updated_at", tie: Sequence[str] = ("method", "setting", "eval_index")) -> DataFrame:
    """One row: the record that was written last, of equal times the first by `tie`."""
    order = F.struct(-F.unix_micros(F.col(when).cast("timestamp")), *tie)
    return done.agg(F.min_by(F.struct(*columns, when), order).alias("r")).filter("r is not null").select("r.*")
