"""Readers of row and record files, through Spark only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file or folder under a stated schema; blank lines are skipped, a malformed one is an error unless strict is off."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line) of the non-blank lines of manifests, which are read whole to be numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("number", "line"))
    return whole.filter(F.trim("line") != "").withColumn("number", F.col("number") + 1)


def first_error(spark: SparkSession, path: str) -> str | None:
    """file:line of the first line of a manifest that holds no JSON object."""
    bad = numbered_lines(spark, path).filter(F.json_object_keys("line").isNull()).orderBy("file", "number").first()
    return f"{bad['file']}:{bad['number']}" if bad else None


def config(spark: SparkSession, path: str, schema: T.StructType) -> dict:
    """A file of one JSON object as a dictionary; another number of objects is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} holds {len(rows)} objects")
    return rows[0].asDict(recursive=True)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of lines that hold no JSON object."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return lines.filter((F.trim("line") != "") & F.json_object_keys("line").isNull())


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text, for checks of field names that a schema would hide."""
    return spark.read.text(path).filter(F.trim("value") != "")


def record_folder(spark: SparkSession, path: str, schema: T.StructType, names: str = "*.json") -> DataFrame:
    """One record a file, with the file's stem; numeric stems can be had with `names`."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", names).json(path)
    return rows.withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


FOUR_DIGITS = "[0-9][0-9][0-9][0-9].json"


def numeric_stems(files: DataFrame) -> DataFrame:
    return files.filter(F.col("stem").rlike(r"^\d+$"))


def by_ordinal(spark: SparkSession, paths: Sequence[str], wanted: DataFrame, *columns: str) -> DataFrame:
    """Rows of Parquet files at stated places: wanted has file (its name) and row (from 0); only the named columns are read. A place that isn't there is an error."""
    rows = spark.read.parquet(*paths).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), *columns, F.lit(True).alias("there"))
    gone = F.raise_error(F.concat(F.lit("no such row: "), F.col("file"), F.lit(" "), F.col("row").cast("string"))).cast("boolean")
    return wanted.join(rows, ["file", "row"], "left").withColumn("there", F.coalesce("there", gone)).filter("there").drop("there")


def by_identity(rows: DataFrame, wanted: DataFrame, place: str, own: str, expected: str) -> DataFrame:
    """Rows at stated places, whose column `own` must be what `wanted` has in `expected`: a shifted file is an error."""
    joined = wanted.join(rows, place, "left")
    good = F.col(own).eqNullSafe(F.col(expected))
    wrong = F.raise_error(F.concat(F.lit("source identity differs: "), F.coalesce(expected, F.lit("null")))).cast("boolean")
    return joined.withColumn("__good", F.when(good, True).otherwise(wrong)).filter("__good").drop("__good")


def png_sizes(spark: SparkSession, path: str, names: str = "*.png") -> DataFrame:
    """(path, width, height) of PNG files, from the first bytes; null sizes for what is no PNG."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(path)
    head = F.hex(F.substring("content", 1, 24))
    good = F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.length(head) == 48)
    side = lambda at: F.when(good, F.conv(F.substring(head, at, 8), 16, 10).cast("int"))
    return files.select("path", side(33).alias("width"), side(41).alias("height"))


def file_hashes(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(path, length, sha256) of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def drifted(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (path, sha256) whose file is gone or another, each distinct path once."""
    want = expected.select("path", "sha256").distinct()
    return want.join(actual.select("path", F.col("sha256").alias("now")), "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("now")))
