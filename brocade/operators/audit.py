"""Audits of planner outputs, indices and raster values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def well_formed(regions: Column) -> Column:
    """Regions with four finite coordinates, a positive extent and a non-blank hint; others are passed over."""

    def good(r: Column) -> Column:
        box = r["box"]
        finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return r.isNotNull() & F.coalesce((F.size(box) == 4) & finite & (F.element_at(box, 3) > F.element_at(box, 1)) & (F.element_at(box, 4) > F.element_at(box, 2)) & (F.trim(r["hint"]) != ""), F.lit(False))

    return F.filter(regions, good)


def has_template_box(regions: Column, templates: list[tuple[float, ...]]) -> Column:
    """Whether a region's box is one of the stated template boxes."""
    known = [F.array(*[F.lit(float(v)) for v in t]) for t in templates]
    hit = lambda r: F.coalesce(F.lit(False) if not known else _any([r["box"] == k for k in known]), F.lit(False))
    return F.exists(regions, hit)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def planner_audit(rows: DataFrame, templates: list[tuple[float, ...]], *keys: str) -> DataFrame:
    """Per group: rows scanned, those with a template box, and their distinct cases and (case, setting) pairs."""
    hit = has_template_box(F.col("regions"), templates)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(hit).alias("records"), F.countDistinct(F.when(hit, F.col("eval_index"))).alias("cases"),
        F.countDistinct(F.when(hit, F.struct("eval_index", "setting"))).alias("case_settings"), F.sum(F.size(well_formed(F.col("regions")))).alias("usable_regions"),
    )


def index_gaps(rows: DataFrame, index: str = "eval_index") -> DataFrame:
    """One row: how many rows, distinct indices, least and greatest, and whether they are 0 to n - 1 without gap or repeat."""
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("distinct"), F.min(index).alias("least"), F.max(index).alias("greatest"))
    return t.withColumn("gap_free", (F.col("n") == F.col("distinct")) & (F.col("least") == 0) & (F.col("greatest") == F.col("n") - 1))


def thresholded(values: DataFrame, least: int = 128, inverted: bool = False) -> DataFrame:
    """Mask pixels of raster values (mask, x, y, v): those of at least `least`, or below it for an alpha plane."""
    return values.filter(F.col("v") < least if inverted else F.col("v") >= least).select("mask", "x", "y")


def binary_assets(values: DataFrame) -> DataFrame:
    """Whether each raster holds only 0 and 255, and 255 somewhere."""
    return values.groupBy("mask").agg((F.count_if(~F.col("v").isin(0, 255)) == 0).alias("only_binary"), (F.count_if(F.col("v") == 255) > 0).alias("has_region"))


def candidates(boxes: DataFrame, least: float = 0.02) -> DataFrame:
    """Detector boxes that cover the mask or overlap its box by more than `least`."""
    return boxes.filter((F.col("coverage") > least) | (F.col("overlap") > least))
