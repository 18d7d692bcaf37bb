"""Case boards: each case with all of its outputs, in pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import METHODS, SETTINGS
from . import order
from .stack import stacked

CELL = ("status", "edit", "preservation", "quality", "output")


def boards(cases: DataFrame, records: DataFrame, per_page: int = 20, methods: Sequence[str] = METHODS, settings: Sequence[str] = SETTINGS, line: str = "line") -> DataFrame:
    """(eval_index, case, page, cells, absent): each case with one cell for every method and setting, in their order.

    A cell has the first record's status, scores and output, or the status pending where there is none; absent counts
    those. Records of unknown cases, methods or settings are left out. Cases and records go through one shuffle together,
    and a case's cells are aggregates of their own, so no list grows with the number of records. Cases are numbered
    without gaps, so a page is known from the number alone.
    """
    kinds = {c: records.schema[c].dataType.simpleString() for c in CELL if c in records.columns}
    cell = F.struct(*kinds)
    case = F.struct(*[c for c in cases.columns if c != "eval_index"])
    tagged = cases.select("eval_index", case.alias("case"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("setting"), F.lit(None).cast(records.schema[line].dataType).alias("line"), F.lit(None).cast(f"struct<{','.join(f'{c}:{k}' for c, k in kinds.items())}>").alias("cell"))
    given = records.select("eval_index", F.lit(None).cast(tagged.schema["case"].dataType).alias("case"), "method", "setting", F.col(line).alias("line"), cell.alias("cell"))
    grid = [(m, s) for m in methods for s in settings]
    first = [F.min_by("cell", F.when((F.col("method") == m) & (F.col("setting") == s), F.col("line"))).alias(f"c{i}") for i, (m, s) in enumerate(grid)]
    rows = stacked(["eval_index"], tagged, given).groupBy("eval_index").agg(F.first("case", ignorenulls=True).alias("case"), *first).filter("case is not null")
    shown = [F.struct(F.lit(m).alias("method"), F.lit(s).alias("setting"), F.coalesce(F.col(f"c{i}.status"), F.lit("pending")).alias("status"), *[F.col(f"c{i}.{c}").alias(c) for c in kinds if c != "status"]) for i, (m, s) in enumerate(grid)]
    absent = sum((F.col(f"c{i}").isNull().cast("int") for i in range(len(grid))), F.lit(0))
    return rows.select("eval_index", "case", order.page(F.col("eval_index"), per_page).alias("page"), F.array(*shown).alias("cells"), absent.alias("absent"))


def pages(shown: DataFrame) -> DataFrame:
    """(page, first, last, cases, absent): what each page of boards holds."""
    return shown.groupBy("page").agg(F.min("eval_index").alias("first"), F.max("eval_index").alias("last"), F.count(F.lit(1)).alias("cases"), F.sum("absent").alias("absent"))


def write_pages(shown: DataFrame, path: str) -> None:
    """Boards by page: a reader of one page opens one folder."""
    n = int(shown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shown.repartition(n, "page").sortWithinPartitions("page", "eval_index").write.partitionBy("page").parquet(path)


def shard_balance(rows: DataFrame, world: int, shift: int = 0, position: str = "eval_index") -> DataFrame:
    """(rank, rows): how many rows each of `world` workers gets, round robin by position; workers without any too."""
    n = rows.groupBy(order.shard(F.col(position), world, shift).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.sparkSession.range(world).select(F.col("id").alias("rank")).join(n, "rank", "left").select("rank", F.coalesce("rows", F.lit(0)).alias("rows"))
