"""Contracts as rules: each row gets the names of the rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EDIT_TYPES
from ..functions import geometry, text


def broken(rules: dict[str, Column]) -> Column:
    """Names of rules that are false or unknown for a row."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def errors(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of all broken rules; the same columns for repeated keys under the rule `unique`."""
    listed = rows.select(key, F.explode(broken(rules)).alias("rule"))
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("unique").alias("rule"))
    return listed.unionByName(repeated)


def require(found: DataFrame, shown: int = 100) -> None:
    """Raise with the first errors if there are any."""
    rows = found.limit(shown).collect()
    if rows:
        raise ValueError("\n".join(str(r.asDict()) for r in rows))


def closed_fields(text: Column, names: set[str]) -> Column:
    """Whether a JSON object has exactly these fields."""
    return F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(n) for n in sorted(names)])


def case_rules(width: Column, height: Column) -> dict[str, Column]:
    """Rules of flat cases with one box and point each."""
    box, point = F.col("box"), F.col("point")
    return {
        "edit_type": F.col("edit_type").isin(*EDIT_TYPES), "region_count": F.col("region_count").isin(1, 2), "box": geometry.box_valid(box, width, height),
        "point": geometry.point_inside(point, width, height), "target": (F.col("source_dataset") == "POLYGON") == F.col("target").isNull(),
    }


#: Field names of a case and of its parts: no others may be there, none may be missing.
CASE = {
    "$": ("difficulty", "edit_type", "evaluation_mask", "id", "instruction", "regions", "source_dataset", "source_image", "target"),
    "$.instruction": ("region_only", "with_location_reference"), "$.target": ("expected_global_description", "expected_local_content", "reference_image"),
    "$.difficulty": ("multi_object_scene", "same_class_multi_instance"), "$.regions[0]": ("box", "mask", "point"),
}


def field_rules(line: Column) -> dict[str, Column]:
    """Closed field sets at each level of a case's JSON text, which a schema would hide."""
    return {f"fields {path}": F.array_sort(F.json_object_keys(line if path == "$" else F.get_json_object(line, path))) == F.array(*[F.lit(n) for n in names]) for path, names in CASE.items()}


def different_fields(have: Column, want: tuple[str, ...]) -> Column:
    """Names that only one of two field sets has, in order."""
    known = F.array(*[F.lit(n) for n in want])
    return F.array_sort(F.array_union(F.array_except(have, known), F.array_except(known, have)))


def built_case_rules(datasets: tuple[str, ...], without_target: str) -> dict[str, Column]:
    """Rules of nested cases as they are built (regions array<struct<mask,box,point>>, width and height of the source): up to three regions, placeholders as a set."""
    regions, only = F.col("regions"), F.col("instruction.region_only")
    n = F.size(regions)
    inside = lambda r: geometry.box_valid(r["box"], F.col("width"), F.col("height")) & geometry.point_inside(r["point"], F.col("width"), F.col("height"))
    named = F.when(F.col("edit_type") == "counting", only.isNull()).otherwise(F.coalesce(text.placeholders_complete(only, n), F.lit(False)))
    return {
        "source_dataset": F.col("source_dataset").isin(*datasets), "edit_type": F.col("edit_type").isin(*EDIT_TYPES), "region_count": n.between(1, 3), "placeholders": named,
        "reference": (F.col("source_dataset") == without_target) == F.col("target.reference_image").isNull(), "local_content": ~text.is_blank(F.col("target.expected_local_content")),
        "geometry": F.forall(regions, inside),
    }


def loaded_case_rules() -> dict[str, Column]:
    """Stricter rules of cases as they are loaded: one or two regions, placeholders in order, an instruction that isn't blank."""
    n = F.size("regions")
    return {"region_count": n.isin(1, 2), "placeholders": text.placeholders_ordered(F.col("instruction.region_only"), n), "instruction": ~text.is_blank(F.col("instruction.with_location_reference"))}


def report(rows: DataFrame) -> DataFrame:
    """One row of totals: cases, unique ids and source images, references, regions, cases of several regions, region-only instructions."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("case_id").alias("unique_ids"), F.countDistinct("source_image").alias("unique_sources"), F.count("target").alias("references"),
        F.sum("region_count").alias("regions"), F.count_if(F.col("region_count") > 1).alias("multi_region"), F.count("region_instruction").alias("region_only_instructions"),
    )
