"""Constituent lists -> one row per ticker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_universe(lists: list[DataFrame]) -> DataFrame:
    """Union of up to three lists; a later list overwrites an earlier one, and
    within one list the later row (column `line`) does."""
    tagged = [d.withColumn("priority", F.lit(i)) for i, d in enumerate(lists)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged).withColumn(
        "ticker", F.upper(F.trim("ticker"))
    )
    # combines before the shuffle, however often a ticker is listed
    newest = F.max_by(
        F.struct("name", "sector", "sub_industry", "cik"), F.struct("priority", "line")
    )
    return rows.groupBy("ticker").agg(newest.alias("r")).select(
        "ticker",
        F.coalesce(F.trim("r.name"), F.col("ticker")).alias("name"),
        F.coalesce("r.sector", F.lit("Unknown")).alias("sector"),
        F.coalesce(F.trim("r.sub_industry"), F.lit("")).alias("sub_industry"),
        F.col("r.cik").try_cast("bigint").alias("cik"),
    )
