"""Comparison of methods on matched cohorts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, summary
from ..sources import publication, writers


def one_protocol(records: DataFrame, protocol: str) -> None:
    """Raise if any record was made under another protocol."""
    if not records.filter(~F.col("protocol").eqNullSafe(F.lit(protocol))).isEmpty():
        raise ValueError("records of different protocols can't be compared")


def cohorts(records: DataFrame) -> dict[str, DataFrame]:
    """All records, and those of cases and settings that every method has where that is fewer."""
    out = {"all": records}
    keys = records.select("eval_index", "setting", "method").distinct()
    m = records.select("method").distinct().count()
    if m >= 2:
        common = joins.common_cohort(records, m)
        if common.select("eval_index", "setting", "method").distinct().count() != keys.count():
            out["common"] = common
    return out


def comparison(records: DataFrame) -> DataFrame:
    """Per method: cases, summary and intervals of the axis means."""
    wide = summary.bootstrap(records, "method").groupBy("method").pivot("axis", ["edit", "preservation", "quality"]).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    return summary.method_table(records).join(wide, "method")


def complete(records: DataFrame, methods: int, cases: int, settings: int) -> None:
    """Raise unless every method has every case and setting, judged or in conflict."""
    t = records.groupBy("method").agg(F.countDistinct("eval_index").alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("status").isin("ok", "annotation_conflict")).alias("open"))
    rows = t.collect()  # one row a method
    if len(rows) != methods or any(r["c"] != cases or r["n"] != cases * settings or r["open"] for r in rows):
        raise ValueError("results are not complete")


def publish(records: DataFrame, root: str, methods: int, cases: int, settings: int, files: DataFrame | None = None) -> str:
    """Publish the comparison of complete records with its files (name, content); incomplete ones are an error before anything is written.

    The set holds summary.json and summary.md, one row a method, and the given files; files of earlier sets go. Gives the set's version.
    """
    complete(records, methods, cases, settings)
    spark = records.sparkSession
    table = summary.method_table(records).orderBy("position").drop("position")
    rows = [r.asDict() for r in table.collect()]  # one row a method
    made = [("summary.json", json.dumps({r["method"]: r for r in rows}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"), ("summary.md", writers.markdown_table(rows, table.columns))]
    own = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in made], publication.FILE)
    return publication.publish(own if files is None else own.unionByName(files.select("name", "content")), root)
