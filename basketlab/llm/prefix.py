"""Running totals over a whole table in a given order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(parts: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """`parts` (one row per partition number) with the total of all smaller numbers.

    A running total over one row per partition: as many rows as the table has
    partitions, not rows.
    """
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))

