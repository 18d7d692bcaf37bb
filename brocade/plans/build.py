"""Cases from selections and region masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import masks
from ..operators.stack import met

#: Short names of the sources, and the one whose cases have no target picture.
DATASETS = {"COMPOSED": "composed", "EDITED": "edited", "POLYGON": "polygon"}
WITHOUT_TARGET = "POLYGON"


def region_assets(pixels: DataFrame, width: int, height: int, several: bool = True, strict: bool = True) -> DataFrame:
    """(mask, regions): of each mask's regions the padded box, innermost point and area, in order, as an array."""
    found = masks.region_shapes(pixels, width, height, several, strict)
    box = geometry.padded(F.array("x1", "y1", "x2", "y2"), F.lit(width), F.lit(height))
    one = F.struct(F.col("region").alias("n"), box.alias("box"), F.array("px", "py").alias("point"), "area")
    return found.groupBy("mask").agg(F.array_sort(F.collect_list(one)).alias("regions"))


def built_cases(selected: DataFrame, regions: DataFrame) -> DataFrame:
    """Nested cases from selections and their regions (case_id, regions array<struct<n, box, point>>).

    Selections have case_id, source_dataset, source_group, edit_type, instruction_original, local_caption,
    target_prompt, region_only (stated for polygon cases, where a missing one is an error), rewrite, needs_reference
    and the two difficulty flags, which count as true where unknown. A selection without regions is an error.
    """
    joined = selected.join(met(regions), "case_id", "left")
    n = F.size("regions")
    have = F.when(F.coalesce(n, F.lit(0)) > 0, F.col("regions")).otherwise(F.raise_error(F.concat(F.lit("no regions: "), "case_id")).cast(regions.schema["regions"].dataType))
    joined = joined.withColumns({"regions": have, "slug": text.dataset_name(F.col("source_dataset"), DATASETS), "name": text.safe_name(F.col("case_id"))})
    name, slug, polygon = F.col("name"), F.col("slug"), F.col("source_dataset") == WITHOUT_TARGET
    stated = F.when(text.is_blank(F.col("region_only")), text.fail(F.concat(F.lit("missing region-only instruction: "), "case_id"))).otherwise(text.clean(F.col("region_only")))
    derived = text.region_only_instruction(F.col("edit_type"), n, F.col("instruction_original"), F.col("local_caption"), F.col("rewrite"), F.col("needs_reference"))
    path = lambda folder, tail: F.concat(F.lit(folder + "/"), slug, F.lit("/"), tail)
    region = lambda r: F.struct(path("regions/input", F.concat(name, F.format_string("_r%02d.png", r["n"]))).alias("mask"), r["box"].alias("box"), r["point"].alias("point"))
    return joined.select(
        F.col("case_id").alias("id"), slug.alias("source_dataset"), text.edit_type(F.col("edit_type")).alias("edit_type"),
        path("images/source", F.concat(text.safe_name(F.col("source_group")), F.lit(".png"))).alias("source_image"),
        F.struct(text.clean(F.col("instruction_original")).alias("with_location_reference"), F.when(polygon, stated).otherwise(derived).alias("region_only")).alias("instruction"),
        F.transform("regions", region).alias("regions"), path("regions/evaluation", F.concat(name, F.lit(".png"))).alias("evaluation_mask"),
        F.struct(
            F.when(~polygon, path("images/target", F.concat(name, F.lit(".png")))).alias("reference_image"),
            text.local_content(F.col("edit_type"), F.col("local_caption")).alias("expected_local_content"), text.clean(F.col("target_prompt")).alias("expected_global_description"),
        ).alias("target"),
        F.struct(F.coalesce("same_class", F.lit(True)).alias("same_class_multi_instance"), F.coalesce("multi_object", F.lit(True)).alias("multi_object_scene")).alias("difficulty"),
    )


def metadata(built: DataFrame, order: tuple[str, ...] = ("add", "remove", "replace", "mixed", "counting")) -> DataFrame:
    """One row: number of cases, counts by dataset and edit type as maps with string keys, and the types that are there in a fixed order."""
    counts = lambda c: built.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c).cast("string"), "n")))).alias(f"counts_by_{c}"))
    one = built.agg(F.count(F.lit(1)).alias("cases"), F.array_intersect(F.array(*[F.lit(k) for k in order]), F.collect_set("edit_type")).alias("edit_types"))
    return one.join(F.broadcast(counts("source_dataset"))).join(F.broadcast(counts("edit_type")))  # one row each
