"""Landed price bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.functions.exprs import finite


def load_bars(bars: DataFrame, tickers: DataFrame | None, as_of: str, years: int) -> DataFrame:
    """Bars of the wanted securities from `years` back to the day before `as_of`.

    The date range is a plain predicate on the date column, so a table
    partitioned by date is pruned. Securities without a single close drop out.
    """
    end = F.date_sub(F.lit(as_of).cast("date"), 1)
    start = F.date_sub(F.lit(as_of).cast("date"), 365 * years)
    rows = bars.where(F.col("date").between(start, end)).select(
        "security", "date", finite("close").alias("close"), finite("volume").alias("volume")
    )
    if tickers is not None:
        rows = rows.join(tickers.select("security"), "security", "left_semi")
    alive = rows.groupBy("security").agg(F.count("close").alias("n")).where("n > 0")
    return rows.join(alive.select("security"), "security", "left_semi")


def load_gauges(gauges: DataFrame, as_of, days: int = 10) -> DataFrame:
    """The last `days` days of gauge closes; `as_of` is a date column or text."""
    end = as_of if not isinstance(as_of, str) else F.lit(as_of).cast("date")
    return gauges.where(
        F.col("date").between(F.date_sub(end, days), end) & F.col("close").isNotNull()
    )
