"""Writers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_fields(column: Column, kind: T.DataType) -> Column:
    """The value with the fields of all its structs in order of name."""
    if isinstance(kind, T.StructType):
        parts = [sorted_fields(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: sorted_fields(x, kind.elementType))
    return column


def write_jsonl(rows: DataFrame, path: str, sort_keys: bool = True) -> None:
    """JSON lines with nulls kept; fields in order of name at every level if sort_keys. Spark's commit makes the write whole or nothing."""
    names = sorted(rows.columns) if sort_keys else rows.columns
    parts = [sorted_fields(F.col(n), rows.schema[n].dataType).alias(n) if sort_keys else F.col(n) for n in names]
    rows.select(*parts).write.option("ignoreNullFields", False).json(path)


def append_records(rows: DataFrame, path: str) -> None:
    """Finished records, by run, to a Parquet table that a resumed run reads."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def append_new(rows: DataFrame, path: str, key: str = "key") -> None:
    """Append those finished records whose key the table doesn't have yet, each key once, so that a repeated append adds nothing."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    new = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if there else rows
    append_records(new.dropDuplicates([key]), path)


def append_outcomes(rows: DataFrame, path: str) -> None:
    """Append rows (run_id, error and more) to a table in one pass, those with an error in folders of their own: the log of a run's failures."""
    rows.withColumn("failed", F.col("error").isNotNull()).write.mode("append").partitionBy("run_id", "failed").parquet(path)


def error_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The rows with an error, of one run or all; no file of other rows is opened."""
    rows = spark.read.parquet(path).filter("cast(failed as boolean)").drop("failed")
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return rows.filter("error is null"), rows.filter("error is not null")


def summary_json(row: dict) -> str:
    return json.dumps(row, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A table of a bounded summary."""
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [" | ".join(columns), " | ".join("---" for _ in columns), *(" | ".join(show(r[c]) for c in columns) for r in rows)]
    return "\n".join(f"| {x} |" for x in lines) + "\n"


def replace_section(body: str, name: str, content: str) -> str:
    """The text between the one BEGIN and END mark of a section, replaced; another number of marks is an error."""
    begin, end = f"<!-- BEGIN {name} -->", f"<!-- END {name} -->"
    if body.count(begin) != 1 or body.count(end) != 1 or body.index(begin) > body.index(end):
        raise ValueError(f"not one section {name}")
    return re.sub(re.escape(begin) + ".*?" + re.escape(end), lambda _: f"{begin}\n{content.strip()}\n{end}", body, flags=re.S)
