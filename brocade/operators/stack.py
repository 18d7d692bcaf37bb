"""Tables on top of each other, for a grouping over all of them, and beside each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def stacked(by: list[str], *tables: DataFrame) -> DataFrame:
    """The rows of all tables, dealt anew by the columns that the next step groups by.

    Without it Spark takes a union of tables that are each partitioned by a key to be partitioned by it as a whole.
    Adaptive execution coalesces the tables' partitions apart from each other, and a key can then lie in two of them: seen
    with 4.1.2 as groups that came out twice, now and then. They are dealt over as many partitions as the session's
    shuffles have: by size alone some thousand well compressed masks would come together in one task.
    """
    return dealt(reduce(DataFrame.unionByName, tables), *by)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """The rows over all partitions of a shuffle by some columns, however small they look."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def met(rows: DataFrame) -> DataFrame:
    """A side of a join that meets the other by sorting, and is never sent whole to the driver and every executor.

    Spark takes a table for as small as the columns of the file it is made from, however many pixels or runs each row
    comes to, and an array for as small as it is compressed.
    """
    return rows.hint("merge")
