"""Gauges and the regime label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlab.functions.exprs import ratio
from basketlab.params import Params


def regime_label(vix, p: Params) -> Column:
    v = F.col(vix) if isinstance(vix, str) else vix
    return (
        F.when(v < p.vix_risk_on, "risk-on")
        .when(v > p.vix_risk_off, "risk-off")
        .otherwise("neutral")
    )


def volatility_level(vix) -> Column:
    v = F.col(vix) if isinstance(vix, str) else vix
    # fixed values: level bounds
    return F.when(v > 30, "high").when(v > 20, "moderate").otherwise("low")


def gauge_changes(recent: DataFrame) -> DataFrame:
    """Last price and last / first - 1 of the loaded days, per gauge."""
    return recent.groupBy("gauge").agg(
        F.max_by("close", "date").alias("price"),
        (ratio(F.max_by("close", "date"), F.min_by("close", "date")) - 1.0).alias("weeklyReturn"),
    )


def market_summary(changes: DataFrame, p: Params) -> DataFrame:
    """One row; a missing gauge gives 0, a missing volatility level null."""
    def pick(gauge: str, field: str) -> Column:
        return F.max(F.when(F.col("gauge") == gauge, F.col(field)))

    row = changes.agg(
        pick("VIX", "price").alias("_vix"),
        F.coalesce(pick("S&P 500", "weeklyReturn"), F.lit(0.0)).alias("sp500Return"),
        F.coalesce(pick("Nasdaq Composite", "weeklyReturn"), F.lit(0.0)).alias("nasdaqReturn"),
        F.coalesce(pick("10Y Treasury Yield", "price"), F.lit(0.0)).alias("treasuryYield"),
    )
    return row.select(
        F.round("_vix", 2).alias("vix"),
        "sp500Return", "nasdaqReturn", "treasuryYield",
        regime_label("_vix", p).alias("riskSentiment"),
        volatility_level("_vix").alias("volatilityLevel"),
    )
