"""Selection of polygon cases: annotations with their candidate crops and a table of picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def with_crops(annotations: DataFrame, crops: DataFrame, expected: int = 5) -> DataFrame:
    """Annotations (image, ..) with their crops (image, place, ..) in order of place; another number of them is an error."""
    listed = crops.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("place", *[c for c in crops.columns if c not in ("image", "place")]))).alias("crops"))
    n = F.coalesce(F.size("crops"), F.lit(0))
    checked = F.when(n == expected, F.col("crops")).otherwise(F.raise_error(F.format_string("%s has %d crops", "image", n)).cast(listed.schema["crops"].dataType))
    return annotations.join(listed, "image", "left").withColumn("crops", checked)


def selected(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """Cases of picked crops: rows (case_id, instruction, crops with an `edit`), picks (case_id, picks: 1-based, one or two, distinct).

    Adds located and regional instructions, the operation and the number of regions.
    """
    few = F.size("picks").isin(1, 2) & (F.size(F.array_distinct("picks")) == F.size("picks"))
    good = F.when(few, F.col("picks")).otherwise(F.raise_error(F.lit("one or two different picks are needed")).cast("array<int>"))
    joined = rows.join(picks, "case_id").withColumn("picks", good)
    parts = text.clauses(F.col("instruction"))
    edits = F.transform("picks", lambda i: F.element_at("crops", i)["edit"])
    return joined.select(
        *rows.columns, "picks", text.location_instruction(parts, F.col("picks")).alias("located"), text.region_instruction(edits).alias("regional"),
        text.aggregate_operation(F.transform(edits, text.operation)).alias("operation"), F.size("picks").alias("region_count"),
    )


def unmatched(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """Case ids that only one side has."""
    a, b = rows.select("case_id"), picks.select("case_id")
    return a.join(b, "case_id", "left_anti").unionByName(b.join(a, "case_id", "left_anti"))


def unified(*selections: DataFrame) -> DataFrame:
    """Selections of several sources as one table; a repeated case id is an error."""
    out = selections[0]
    for s in selections[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    n = out.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    once = n.withColumn("ok", F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated case: "), "case_id")).cast("boolean"))).filter("ok").select("case_id")
    return out.join(once, "case_id")
