"""Weights, portfolio return series, blends and NAV."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import ratio
from basketlab.operators.prices import calendar_array
from basketlab.params import Params
from basketlab.sources.scratch import materialize

KEY = ["portfolio"]


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """`rows` with their portfolio's row of `totals`.

    Totals are written first: the optimizer broadcasts them by their measured
    size, and beyond its limit a join of two shuffles is left, whose hot
    portfolios adaptive execution splits (it can't below an aggregate).
    """
    return rows.join(materialize(totals, "totals"), KEY)


def cap_levels(rows: DataFrame, cap: float) -> DataFrame:
    """(portfolio, _total, _positive, _lam) from rows with a score `_s` of 0 or more.

    At most 1/cap names can sit at the cap, so lam needs only the 1/cap + 1 largest
    scores of a portfolio plus its total: the top rows are cut before the
    shuffle and no portfolio is ever gathered whole.
    """
    most = math.floor(1.0 / cap + 1e-9)
    totals = rows.groupBy(*KEY).agg(
        F.sum("_s").alias("_total"), F.count(F.when(F.col("_s") > 0, 1)).alias("_positive")
    )
    best = Window.partitionBy(*KEY).orderBy(F.desc("_s"), F.asc("security"))
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    top = (
        rows.select(*KEY, "security", "_s")
        .withColumn("_k", F.row_number().over(best))
        .where(F.col("_k") <= most + 1)
        .withColumn("_above", F.coalesce(F.sum("_s").over(before), F.lit(0.0)))
        .join(totals, KEY)
        # with k-1 names at the cap, the k-th largest is the first one below it
        .withColumn(
            "_lam",
            ratio(1.0 - (F.col("_k") - 1) * F.lit(cap), F.col("_total") - F.col("_above")),
        )
        .where((F.col("_s") > 0) & (F.col("_lam") * F.col("_s") <= cap + 1e-12))
        .groupBy(*KEY)
        .agg(F.min_by("_lam", "_k").alias("_lam"))
    )
    return totals.join(top, KEY, "left")


def capped_weights(holdings: DataFrame, cap: float, score: str = "score") -> DataFrame:
    """Weights in proportion to max(score, 0), none above `cap`, summing to 1.

    The excess over the cap spreads in proportion over the rest until nobody is
    above it, which is the point where w = min(cap, lam * score).
    """
    s = F.greatest(F.col(score), F.lit(0.0))
    rows = holdings.withColumn("_s", F.coalesce(s, F.lit(0.0)))
    raw = (
        F.when(F.col("_s") <= 0, 0.0)
        .when(F.col("_positive") * F.lit(cap) <= 1.0 + 1e-12, F.lit(cap))
        .otherwise(F.least(F.lit(cap), F.col("_lam") * F.col("_s")))
    )
    weighted = with_totals(rows, cap_levels(rows, cap)).withColumn("_raw", raw)
    # the capped weights already sum to 1 unless too few names can carry them
    scale = F.when(
        F.col("_positive") * F.lit(cap) <= 1.0 + 1e-12,
        ratio(F.lit(1.0), F.col("_positive") * F.lit(cap)),
    ).otherwise(F.lit(1.0))
    return weighted.withColumn("weight", F.coalesce(F.col("_raw") * scale, F.lit(0.0))).drop(
        "_s", "_total", "_positive", "_lam", "_raw"
    )


def equal_weights(holdings: DataFrame) -> DataFrame:
    counts = holdings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    return with_totals(holdings, counts).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def held_weights(weights: DataFrame, priced: DataFrame) -> DataFrame:
    """Holdings that have prices, weights renormalised per portfolio."""
    held = weights.join(priced.select("security"), "security", "left_semi")
    totals = held.groupBy(*KEY).agg(F.sum("weight").alias("_w"))
    return (
        with_totals(held, totals)
        .withColumn("weight", ratio("weight", F.when(F.col("_w") != 0, F.col("_w")).otherwise(1.0)))
        .drop("_w")
    )


def portfolio_returns(weights: DataFrame, returns: DataFrame, bars: DataFrame) -> DataFrame:
    """Sum of weight x return per portfolio and trading date.

    A missing return counts as 0 without renormalising, and a date on which no
    holding has one is a 0, so every portfolio has a row on every date.
    """
    sums = (
        weights.select(*KEY, "security", "weight")
        .join(returns.select("security", "date", "ret"), "security")
        .groupBy(*KEY, "date")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    )
    frame = weights.select(*KEY).distinct().select(
        *KEY, F.explode(calendar_array(bars)).alias("date")
    )
    return frame.join(sums, [*KEY, "date"], "left").fillna(0.0, ["ret"])


def latest_marks(weights: DataFrame, returns: DataFrame, bars: DataFrame) -> DataFrame:
    """Last date's return of frozen weights: missing returns are 0, weights are
    renormalised over the names that have any price."""
    last = bars.agg(F.max("date")).scalar()
    held = held_weights(weights, bars.where(F.col("close").isNotNull()).select("security").distinct())
    today = returns.where(F.col("date") == last).select("security", "ret")
    return (
        held.join(today, "security", "left")
        .groupBy(*KEY)
        .agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
        .withColumn("date", last)
    )


def weighted_mean(field: str) -> Column:
    """Mean over the names that report the field."""
    v = F.col(field)
    return ratio(
        F.sum(v * F.col("weight")), F.sum(F.when(v.isNotNull(), F.col("weight")))
    )


def blended(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy(*KEY).agg(
        F.round(weighted_mean("peRatio"), 2).alias("pe"),
        F.round(weighted_mean("fcfYield"), 4).alias("fcfYield"),
        F.round(weighted_mean("revenueGrowth"), 4).alias("revenueGrowth"),
        F.round(weighted_mean("returnOnEquity"), 4).alias("returnOnEquity"),
        F.round(weighted_mean("netMargin"), 4).alias("netMargin"),
        weighted_mean("dividendYield").alias("weightedDividendYield"),
        F.count("netMargin").alias("coverage"),
    )


def sector_breakdown(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy(*KEY, F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(
        F.round(F.sum("weight"), 4).alias("weight")
    )


def align(series: DataFrame, bench: DataFrame) -> DataFrame:
    """Dates on which both the portfolio and the benchmark have a return."""
    # one benchmark row per trading date
    return series.join(F.broadcast(bench), "date").where(
        F.col("ret").isNotNull() & F.col("bench").isNotNull()
    )


def nav_series(aligned: DataFrame) -> DataFrame:
    """Growth of fund and benchmark, both divided by their first value."""
    own = Window.partitionBy(*KEY).orderBy("date")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    grown = aligned.withColumn("_f", F.product(1.0 + F.col("ret")).over(run)).withColumn(
        "_b", F.product(1.0 + F.col("bench")).over(run)
    )
    return grown.select(
        *KEY,
        "date",
        (F.col("_f") / F.first("_f").over(run)).alias("fund"),
        (F.col("_b") / F.first("_b").over(run)).alias("benchmark"),
    )


def downsample(nav: DataFrame, points: int) -> DataFrame:
    """Every max(1, n div points)-th row, and the last."""
    own = Window.partitionBy(*KEY)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points)).cast("int")
    return (
        nav.withColumn("_i", F.row_number().over(own.orderBy("date")) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(own))
        .where((F.pmod(F.col("_i"), step) == 0) | (F.col("_i") == F.col("_n") - 1))
        .drop("_i", "_n")
    )


def reprice_universe(ranked: DataFrame, arms: DataFrame, p: Params) -> DataFrame:
    """Ranked names, every arm's names, and the benchmark: each once."""
    bench = ranked.sparkSession.range(1).select(F.lit(p.benchmark).alias("security"))
    return (
        ranked.select("security").union(arms.select("security")).union(bench).distinct()
    )


