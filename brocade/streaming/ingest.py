"""Records as a stream: new files of a folder, each key once, with running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def records(spark: SparkSession, path: str, schema: T.StructType, key: str = "key", when: str = "finished_at", late: str = "1 day") -> DataFrame:
    """Streaming records of Parquet files in a folder; a key that comes again within the watermark is dropped."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(when, late).dropDuplicatesWithinWatermark([key])


def copy_new(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is new to a Parquet table, then stop; a second call goes on where the first ended."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def running_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("method", "setting").agg(F.count(F.lit(1)).alias("done"))
