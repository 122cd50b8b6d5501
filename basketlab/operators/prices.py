"""Price panels in long form.

The dense (security x date) panel is never built for a computation. Where a
rule counts calendar rows, a bar carries its ordinal in the calendar; where
the dense panel is itself the result, each bar is expanded over its own gap.
A security's rows are bounded by the calendar, so per-security windows are too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import clip, finite, ratio
from basketlab.params import Params


def calendar_array(bars: DataFrame) -> Column:
    """All trading dates in order, as a scalar subquery (one array)."""
    return (
        bars.select("date").distinct().agg(F.array_sort(F.collect_set("date"))).scalar()
    )


def calendar(bars: DataFrame) -> DataFrame:
    """(t, date): trading dates numbered from 0."""
    dates = bars.select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("c"))
    return dates.select(F.posexplode("c").alias("t", "date"))


def with_ordinal(bars: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Adds the calendar ordinal `t`. `dates` names the panel whose calendar
    counts, where `bars` is only a part of it."""
    cal = calendar(bars if dates is None else dates)
    # one row per trading date, however many securities there are
    return bars.join(F.broadcast(cal), "date")


def calendar_grid(bars: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Every security on every date; missing bars have null close and volume."""
    cal = calendar_array(bars if dates is None else dates)
    own = Window.partitionBy("security").orderBy("t")
    first = F.lag("t").over(own).isNull()
    next_t = F.lead("t").over(own)
    return (
        with_ordinal(bars, dates)
        .withColumn("lo", F.when(first, F.lit(0)).otherwise(F.col("t")))
        .withColumn("next_t", next_t)
        .withColumn("hi", F.coalesce("next_t", F.size(cal)) - 1)
        .select("security", "t", "close", "volume", F.explode(F.sequence("lo", "hi")).alias("u"))
        .select(
            "security",
            "u",
            F.element_at(cal, F.col("u") + 1).alias("date"),
            F.when(F.col("u") == F.col("t"), F.col("close")).alias("close"),
            F.when(F.col("u") == F.col("t"), F.col("volume")).alias("volume"),
        )
    )


def forward_fill(grid: DataFrame) -> DataFrame:
    own = Window.partitionBy("security").orderBy("date").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return grid.withColumn("filled", F.last("close", ignorenulls=True).over(own))


def daily_returns(bars: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """close / previous close - 1 where the previous *calendar* row has a close.

    Rows without a return are left out; on the panel they are the nulls.
    """
    own = Window.partitionBy("security").orderBy("t")
    back_to_back = F.lag("t").over(own) == F.col("t") - 1
    return (
        with_ordinal(bars, dates)
        .withColumn("prev", F.when(back_to_back, F.lag("close").over(own)))
        .select("security", "date", "t", finite(ratio("close", "prev") - 1.0).alias("ret"))
        .where("ret IS NOT NULL")
    )


def clean_returns(
    bars: DataFrame, dates: DataFrame | None = None, bound: float = 0.5
) -> DataFrame:
    """Daily returns with +-inf dropped and clipped to +-bound."""
    return daily_returns(bars, dates).withColumn("ret", clip("ret", -bound, bound))


def _with_anchors(bars: DataFrame, p: Params, dates: DataFrame | None) -> DataFrame:
    """Adds the date at which each window begins, found once, as one struct."""
    cal = (bars if dates is None else dates).agg(F.array_sort(F.collect_set("date")).alias("c"))
    days = F.size("c")
    begin = [
        F.when(days > k, F.element_at("c", F.greatest(days - k, F.lit(1)))).alias(name)
        for name, k in p.return_windows
    ]
    return bars.withColumn("_anchor", cal.select(F.struct(*begin)).scalar())


def _trailing_aggs(p: Params) -> list[Column]:
    known = F.col("close").isNotNull()
    exprs = [F.max_by("close", F.when(known, F.col("date"))).alias("price")]
    for name, _ in p.return_windows:
        upto = F.when(known & (F.col("date") <= F.col("_anchor")[name]), F.col("date"))
        exprs.append(F.max_by("close", upto).alias(f"_{name}"))
    return exprs


def _trailing_columns(p: Params, positive_base: bool) -> list[Column]:
    out = []
    for name, _ in p.return_windows:
        base = F.col(f"_{name}")
        if positive_base:
            base = F.when(base > 0, base)
        out.append((ratio("price", base) - 1.0).alias(name))
    return out


def trailing_returns(
    bars: DataFrame, p: Params, positive_base: bool = False, dates: DataFrame | None = None
) -> DataFrame:
    """Return over each window at the last date, on forward-filled closes.

    The filled close at a date is the last close on or before it, so one
    aggregate with partial combine replaces the panel, the fill and the lags.
    `positive_base` is the daily job's extra test on the base price.
    """
    rows = _with_anchors(bars, p, dates).groupBy("security").agg(*_trailing_aggs(p))
    return rows.select("security", "price", *_trailing_columns(p, positive_base))


def trailing_variants(bars: DataFrame, p: Params) -> DataFrame:
    """Weekly and daily (`<window>_daily`) trailing returns from one aggregate."""
    rows = _with_anchors(bars, p, None).groupBy("security").agg(*_trailing_aggs(p))
    daily = [c.alias(f"{n}_daily") for c, (n, _) in zip(_trailing_columns(p, True), p.return_windows)]
    return rows.select("security", "price", *_trailing_columns(p, False), *daily)


def screen_reason(p: Params) -> Column:
    """First failing rule; a null volume or price passes its test."""
    return (
        F.when(F.col("n_obs") < p.min_history_rows, "insufficientHistory")
        .when(F.col("avg_volume") < p.volume_floor, "lowLiquidity")
        .when(F.col("last_price") < p.min_price, "lowPrice")
    )


def _screen_aggs() -> list[Column]:
    known = F.when(F.col("close").isNotNull(), F.col("date"))
    return [
        F.count("close").alias("n_obs"),
        F.avg("volume").alias("avg_volume"),
        F.max_by("close", known).alias("last_price"),
    ]


def liquidity_screen(bars: DataFrame, p: Params) -> DataFrame:
    """One row per security with its measures and the first failing rule."""
    return (
        bars.groupBy("security")
        .agg(*_screen_aggs())
        .where("n_obs > 0")
        .withColumn("reason", screen_reason(p))
    )


def security_measures(bars: DataFrame, p: Params) -> DataFrame:
    """Screen measures and trailing returns from one pass over the bars."""
    return (
        _with_anchors(bars, p, None).groupBy("security")
        .agg(*_screen_aggs(), *_trailing_aggs(p))
        .where("n_obs > 0")
        .select(
            "security", "n_obs", "avg_volume", "last_price", screen_reason(p).alias("reason"),
            *_trailing_columns(p, False),
        )
    )


def benchmark_returns(returns: DataFrame) -> DataFrame:
    """Equal-weight mean of the clean returns per date."""
    return returns.groupBy("date").agg(F.avg("ret").alias("bench"))


def coverage(returns: DataFrame, dates: DataFrame, p: Params) -> DataFrame:
    """Share of the window's dates on which each security has a return.

    `dates` are the last rows of the calendar (`tail_dates`), so a date on
    which nobody has a return still counts.
    """
    n = dates.agg(F.count("date")).scalar()
    inside = returns.join(F.broadcast(dates), "date", "left_semi")
    return (
        inside.groupBy("security")
        .agg((F.count("ret") / n).alias("coverage"))
        .withColumn("kept", F.col("coverage") >= p.min_coverage)
    )


def tail_dates(cal: DataFrame, n: int) -> DataFrame:
    """The last n dates of a calendar (top-n over its bounded rows)."""
    return cal.orderBy(F.desc("date")).limit(n).select("date")


def tail_rows(series: DataFrame, keys: list[str], n: int) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(F.desc("date"))
    return (
        series.withColumn("back", F.row_number().over(last)).where(F.col("back") <= n)
    )
