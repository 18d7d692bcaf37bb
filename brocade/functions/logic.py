"""Success under partly unknown scores: three-valued where unknown stays unknown, two-valued where it counts as failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def conjunction(values: Column) -> Column:
    """AND over an array of booleans: false wins over null, null over true; an empty array is true."""
    return F.aggregate(values, F.lit(True), lambda a, b: a & b)


def all_edits(edit: Column) -> Column:
    return edit == 4


def strict(edit: Column, preservation: Column, quality: Column) -> Column:
    """All edits done and both other axes at 3 or more; null where that depends on an unknown score."""
    return (edit == 4) & (preservation >= 3) & (quality >= 3)


def strict_or_false(edit: Column, preservation: Column, quality: Column) -> Column:
    return F.coalesce(strict(edit, preservation, quality), F.lit(False))


def counted(status: Column, success: Column) -> Column:
    """The value that a rate counts: a missing output is a failure whatever the scores say."""
    return F.when(status == "missing_output", F.lit(False)).otherwise(success)


def usable(status: Column, *axes: Column) -> Column:
    out = status == "ok"
    for a in axes:
        out = out & a.isNotNull()
    return out
