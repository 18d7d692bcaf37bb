"""What has been done so far, from the names and times of files; their contents are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOUR_DIGITS = r"^[0-9]{4}$"
DIGITS = r"^\d+$"


def files(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(path, folder, stem, kind, modified, length) of all files below a path; kind is what follows the last dot."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    return found.select("path", part(r"^(.*)/[^/]*$").alias("folder"), part(r"([^/]*?)(?:\.[^./]*)?$").alias("stem"), part(r"\.([^./]*)$").alias("kind"), F.col("modificationTime").alias("modified"), "length")


def by_folders(listed: DataFrame, *names: str) -> DataFrame:
    """The last folders of each path as columns of the given names, outermost first."""
    up = "([^/]+)/" * len(names)
    return listed.withColumns({n: F.regexp_extract("path", up + r"[^/]+$", i) for i, n in enumerate(names, 1)})


def numeric(listed: DataFrame, kind: str = "json", pattern: str = DIGITS) -> DataFrame:
    """Record files whose stem is a number, of any width or by a pattern."""
    return listed.filter((F.col("kind") == kind) & F.col("stem").rlike(pattern))


def paired(listed: DataFrame, kind: str = "png", partner: str = "json") -> DataFrame:
    """Files of a kind that have a partner of the same folder and stem; the listing is read once."""
    has = F.max(F.col("kind") == partner).over(Window.partitionBy("folder", "stem"))
    both = listed.filter(F.col("kind").isin(kind, partner)).withColumn("__has", has)
    return both.filter((F.col("kind") == kind) & F.col("__has")).drop("__has")


def progress(done: DataFrame, expected: DataFrame, *keys: str, per_key: int, when: str = "modified") -> DataFrame:
    """Per expected key: done, latest and percent of per_key, half to even to two places; then one row of nulls for all of them.

    Keys that aren't expected don't count.
    """
    n = done.join(expected, list(keys), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("done"), F.max(when).alias("latest"))
    full = expected.join(n, list(keys), "left").withColumn("done", F.coalesce("done", F.lit(0)))
    summed = full.groupingSets([[F.col(k) for k in keys], []], *keys).agg(F.sum("done").alias("done"), F.max("latest").alias("latest"), F.count(F.lit(1)).alias("keys"))
    return summed.select(*keys, "done", "latest", F.bround(100 * F.col("done") / (F.col("keys") * per_key), 2).alias("percent"))


def latest(done: DataFrame, *tie: str, when: str = "modified") -> DataFrame:
    """One row: the file that was written last, of equal times the first by `tie` (the path by default); none where there are no files."""
    order = F.struct(-F.unix_micros(F.col(when).cast("timestamp")), *(tie or ("path",)))
    return done.agg(F.min_by(F.struct(*done.columns), order).alias("r")).filter("r is not null").select("r.*")


def record_of(spark: SparkSession, one: DataFrame, schema: str) -> dict | None:
    """The record in the file of a single listed row."""
    row = one.first()
    if row is None:
        return None
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(row["path"]).first().asDict(recursive=True)


def progress_line(row: dict, *keys: str) -> str:
    """A row of progress as a line of text."""
    name = "/".join(str(row[k]) for k in keys if row[k] is not None) or "all"
    when = row["latest"].isoformat(sep=" ", timespec="seconds") if row["latest"] else "-"
    return f"{name} {row['done']} done ({row['percent']:.2f} %), latest {when}"


