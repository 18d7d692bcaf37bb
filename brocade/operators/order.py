"""Positions, shards, pages and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import METHODS, SETTINGS


def held(rows: DataFrame) -> DataFrame:
    """The rows as they were dealt once, for two uses that must see the same deal: a checkpoint in the folder that spark.checkpoint.dir names, else kept by the executors."""
    return rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows.persist()


def with_position(rows: DataFrame, *by: str, name: str = "position") -> DataFrame:
    """0-based place in the order of `by`, without bringing all rows together.

    Rows are range-partitioned and sorted; each gets its place in its partition plus the sizes of the partitions
    before, which are a few numbers. The order of exact ties is open, so `by` should be a key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    dealt = held(dealt)  # range bounds come from a sample: dealt twice, partitions could differ
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + F.col("__at")).alias(name))


def place(column: str, names: tuple[str, ...] | None = None) -> Column:
    """0-based place of a method or setting (or of stated names) in its list; an unknown one is an error."""
    names = names or {"method": METHODS, "setting": SETTINGS}[column]
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)) - 1
    return F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(column, F.lit("null")))).cast("long"))


def subset(rows: DataFrame, positions: list[int], most: int | None = None, by: str = "eval_index") -> DataFrame:
    """Rows at a stated set of positions, in their own order, of these the first `most`; a position that no row has is an error."""
    wanted = rows.sparkSession.createDataFrame([(int(p),) for p in sorted(set(positions))], f"{by} long")
    found = F.broadcast(wanted).join(rows.withColumn("there", F.lit(True)), by, "left")
    checked = found.filter(F.coalesce("there", F.raise_error(F.concat(F.lit("no such position: "), F.col(by).cast("string"))).cast("boolean"))).select(*rows.columns)
    return checked if most is None else checked.orderBy(by).limit(most)


def shard(position: Column, world: int, shift: int = 0) -> Column:
    """Round-robin shard of a position, shifted for repeats."""
    return F.pmod(position + shift, F.lit(world))


def page(position: Column, size: int) -> Column:
    return F.floor(position / size)


def latest(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The row of greatest `when` of each key, the least `tie` among equals."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(when), -F.col(tie))).alias("r")).select("r.*")


def top_candidates(rows: DataFrame, key: str, score: str, tie: str, most: int = 10) -> DataFrame:
    """Up to `most` rows of highest score for each key."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def greedy_apart(boxes: Column, overlap, most: int, limit: float = 0.65) -> Column:
    """From an ordered array of boxes, those that overlap none kept before by `limit`, until there are `most`."""
    empty = F.slice(boxes, 1, 0)
    return F.aggregate(boxes, empty, lambda kept, b: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: overlap(k, b) >= limit), F.concat(kept, F.array(b))).otherwise(kept))
