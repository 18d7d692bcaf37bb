"""Rows of Parquet files at stated places, of which only the row groups that hold them are read.

Footers are read as a table, of the wanted files only; places become row groups by their first rows; each group is
opened once, by one task, for the wanted columns. Files are opened by pyarrow's file systems; for stores that only Spark
reads there is readers.by_ordinal, which scans the files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened(path: str):
    """A Parquet file at a path or URI as Spark writes it."""
    from pyarrow import fs
    from pyarrow import parquet

    files, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return parquet.ParquetFile(files.open_input_file(at))


def listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, file) of the Parquet files at or below the paths, without reading any."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(list(paths))
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))


GROUPS = "path string, file string, row_group int, first long, n long"


def row_groups(files: DataFrame) -> DataFrame:
    """(path, file, row_group, first, n): the row groups of files (path, file), from their footers; first is the place of a group's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file in zip(batch.column("path").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with opened(path) as parquet:
                    n = np.array([parquet.metadata.row_group(g).num_rows for g in range(parquet.metadata.num_row_groups)], np.int64)
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array([file] * k), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.cumsum(n) - n), pa.array(n)], names=["path", "file", "row_group", "first", "n"])

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(spread, "path").mapInArrow(run, GROUPS)


def by_row_group(spark: SparkSession, paths: Sequence[str], wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows of wanted (file, the name, and row, from 0, and more) with the named columns of the row there.

    A place that isn't there is an error, as is a name that two of the files have. Places may repeat.
    """
    places = wanted.select("file", F.col("row").cast("long").alias("row")).distinct()
    files = listed(spark, paths).join(places.select("file").distinct(), "file", "left_semi")
    twice = files.groupBy("file").count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"two files of one name: {twice['file']}")
    groups = row_groups(files)
    inside = (F.col("p.file") == F.col("g.file")) & (F.col("p.row") >= F.col("g.first")) & (F.col("p.row") < F.col("g.first") + F.col("g.n"))
    asked = places.alias("p").join(groups.alias("g"), inside).select("g.path", "g.row_group", "p.file", "p.row", (F.col("p.row") - F.col("g.first")).alias("at"))
    kinds = spark.read.parquet(*paths).select(*columns)
    made = spark.createDataFrame([], "file string, row long").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.schema])
    target = made.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, g, f, r, a) for b in batches for p, g, f, r, a in zip(*(b.column(c).to_pylist() for c in ("path", "row_group", "file", "row", "at")), strict=True))
        for (path, group), own in groupby(rows, key=lambda x: x[:2]):
            _, _, file, row, at = zip(*own, strict=True)
            with opened(path) as parquet:
                table = parquet.read_row_group(group, columns=list(columns)).select(list(columns)).take(pa.array(at))
            whole = pa.Table.from_arrays([pa.array(file), pa.array(row, pa.int64()), *table.columns], names=target.names).cast(target)
            yield from whole.to_batches()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = asked.repartition(n, "path", "row_group").sortWithinPartitions("path", "row_group", "at").mapInArrow(run, made.schema).withColumn("__there", F.lit(True))
    gone = F.raise_error(F.concat(F.lit("no such row: "), F.col("file"), F.lit(" "), F.col("row").cast("string"))).cast("boolean")
    return wanted.join(found, ["file", "row"], "left").withColumn("__there", F.coalesce("__there", gone)).filter("__there").drop("__there")
