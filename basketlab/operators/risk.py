"""Risk and performance measures of return series.

A series is `(*keys, date, ret)` with optional `bench` and annual `rf_annual`;
it has one row per trading date, so the windows below are bounded by the
calendar and share one shuffle on the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import (
    bartlett_sum,
    lagged_dot,
    newey_west_lags,
    ordered_list,
    ratio,
)
from basketlab.params import Params


# --- aggregates over a group of rows -------------------------------------------------

def geometric_annual(ret: str, td: int) -> Column:
    n = F.count(ret)
    return F.pow(F.product(1.0 + F.col(ret)), F.lit(float(td)) / n) - 1.0


def annual_vol(ret, td: int) -> Column:
    return F.stddev_samp(ret) * F.lit(float(td) ** 0.5)


def downside_dev(td: int) -> Column:
    """Root mean square over the downside rows only, annualised."""
    gap = F.col("ret") - F.col("rf_annual") / td
    return F.sqrt(F.avg(F.when(gap < 0, gap * gap))) * F.lit(float(td) ** 0.5)


def value_at_risk() -> Column:
    return -F.percentile("ret", F.lit(0.05))


# --- per-row columns ------------------------------------------------------------------

def with_drawdown(series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the growth curve, its running peak, the drawdown and the length of
    the current run below the peak."""
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    under = F.col("curve") < F.col("peak")
    return (
        series.withColumn("curve", F.product(1.0 + F.col("ret")).over(run))
        .withColumn("peak", F.max("curve").over(run))
        .withColumn("drawdown", (F.col("curve") - F.col("peak")) / F.col("peak"))
        .withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
        .withColumn("_top", F.last(F.when(~under, F.col("_row")), ignorenulls=True).over(run))
        .withColumn(
            "underwater", F.when(under, F.col("_row") - F.coalesce("_top", F.lit(0)))
        )
        .drop("_row", "_top")
    )


def with_tail(series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the group's value at risk, so the tail mean needs no second pass."""
    return series.withColumn(
        "_var", F.percentile("ret", F.lit(0.05)).over(Window.partitionBy(*keys))
    )


def tail_mean() -> Column:
    return -F.avg(F.when(F.col("ret") <= F.col("_var"), F.col("ret")))


# --- bundles ----------------------------------------------------------------------------

def zero_if_undefined(num: Column, den: Column) -> Column:
    """The in-sample convention: an undefined ratio is 0."""
    return F.when(F.coalesce(den, F.lit(0.0)) == 0, 0.0).otherwise(ratio(num, den))


def sharpe(p: Params) -> Column:
    td = p.trading_days
    return zero_if_undefined(
        geometric_annual("ret", td) - F.avg("rf_annual"), annual_vol("ret", td)
    )


def sortino(p: Params) -> Column:
    td = p.trading_days
    return zero_if_undefined(
        geometric_annual("ret", td) - F.avg("rf_annual"), downside_dev(td)
    )


def calmar(p: Params) -> Column:
    return zero_if_undefined(
        geometric_annual("ret", p.trading_days), F.abs(F.min("drawdown"))
    )


def beta() -> Column:
    """Null below two rows or without benchmark variance."""
    return ratio(F.covar_samp("ret", "bench"), F.var_samp("bench"))


def tracking_error(td: int) -> Column:
    return annual_vol(F.col("ret") - F.col("bench"), td)


def information_ratio(td: int) -> Column:
    te = tracking_error(td)
    return ratio(
        geometric_annual("ret", td) - geometric_annual("bench", td), F.when(te != 0, te)
    )


def capm_alpha(td: int) -> Column:
    rf = F.avg("rf_annual")
    return geometric_annual("ret", td) - (rf + beta() * (geometric_annual("bench", td) - rf))


def skew() -> Column:
    return F.when(F.count("ret") > 2, F.skewness("ret"))


def excess_kurtosis() -> Column:
    return F.when(F.count("ret") > 3, F.kurtosis("ret"))


def win_rate() -> Column:
    return F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0))


def metrics_summary(series: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """Fifteen measures per group. `bench` may be null on some rows; the
    benchmark-relative ones use the rows that have it."""
    td = p.trading_days
    rows = with_tail(with_drawdown(series, keys), keys)
    both = F.col("bench").isNotNull()
    rows = rows.withColumn("_r", F.when(both, F.col("ret")))
    paired_ann = geometric_annual("_r", td) - geometric_annual("bench", td)
    te = annual_vol(F.col("ret") - F.col("bench"), td)
    return rows.groupBy(*keys).agg(
        geometric_annual("ret", td).alias("annualReturn"),
        annual_vol("ret", td).alias("annualVolatility"),
        sharpe(p).alias("sharpeRatio"),
        sortino(p).alias("sortinoRatio"),
        F.min("drawdown").alias("maximumDrawdown"),
        calmar(p).alias("calmarRatio"),
        (-F.max("_var")).alias("valueAtRisk95"),
        tail_mean().alias("conditionalVar95"),
        win_rate().alias("winRate"),
        skew().alias("skewness"),
        excess_kurtosis().alias("kurtosis"),
        F.max("underwater").cast("bigint").alias("maxDrawdownDuration"),
        ratio(F.covar_samp("_r", "bench"), F.var_samp("bench")).alias("beta"),
        te.alias("trackingError"),
        ratio(paired_ann, F.when(te != 0, te)).alias("informationRatio"),
    )


# --- autocorrelation-robust statistics ------------------------------------------------

def alpha_newey_west(aligned: DataFrame, keys: list[str], p: Params, min_n: int = 60) -> DataFrame:
    """OLS alpha of excess on excess with a Bartlett HAC t-statistic.

    Rows need `ret`, `bench` and `rf_annual`. Each row's share of the
    intercept's estimating equation is computed from group sums; the lag sums
    then run over one array per group, for any number of lags.
    """
    td = p.trading_days
    group = Window.partitionBy(*keys)
    rf = F.col("rf_annual") / td
    rows = (
        aligned.withColumn("_y", F.col("ret") - rf)
        .withColumn("_x", F.col("bench") - rf)
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_mx", F.avg("_x").over(group))
        .withColumn("_my", F.avg("_y").over(group))
        .withColumn("_sxx", F.sum((F.col("_x") - F.col("_mx")) * (F.col("_x") - F.col("_mx"))).over(group))
        .withColumn("_sxy", F.sum((F.col("_x") - F.col("_mx")) * (F.col("_y") - F.col("_my"))).over(group))
        .withColumn("_b", ratio("_sxy", "_sxx"))
        .withColumn("_a", F.col("_my") - F.col("_b") * F.col("_mx"))
        .withColumn("_e", F.col("_y") - F.col("_a") - F.col("_b") * F.col("_x"))
        .withColumn(
            "_z",
            F.col("_e")
            * (1.0 / F.col("_n") - F.col("_mx") * ratio(F.col("_x") - F.col("_mx"), "_sxx")),
        )
    )
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.first("_a").alias("alpha_daily"),
        ordered_list("date", "_z").alias("_zs"),
    )
    lags = newey_west_lags("n")
    v = F.greatest(bartlett_sum("_zs", "n", lags), F.lit(0.0))
    enough = F.col("n") >= min_n
    t = ratio("alpha_daily", F.when(v > 0, F.sqrt(v)))
    return grouped.select(
        *keys,
        "n",
        F.when(enough, F.col("alpha_daily") * td).alias("alphaAnnual"),
        F.when(enough, t).alias("alphaTStat"),
    )


def newey_west_mean(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """HAC t-statistic of a mean; variance over n, at least one lag, n >= 3."""
    grouped = series.groupBy(*keys).agg(
        F.count(value).cast("int").alias("n"),
        F.avg(value).alias("mean"),
        ordered_list("date", value).alias("_xs"),
    )
    centred = grouped.withColumn("_xs", F.expr("transform(_xs, x -> x - mean)"))
    lags = F.least(newey_west_lags("n", 1), F.greatest(F.col("n") - 1, F.lit(0)))
    var = bartlett_sum("_xs", "n", lags) / F.col("n")
    t = ratio("mean", F.when(var > 0, F.sqrt(var / F.col("n"))))
    return centred.select(*keys, "n", F.when(F.col("n") >= 3, t).alias("t_stat"))


def autocov_lags(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per group and lag: sum of x[t] x[t-k] of the demeaned series
    and the lag's Bartlett weight."""
    grouped = series.groupBy(*keys).agg(
        F.count(value).cast("int").alias("n"),
        F.avg(value).alias("mean"),
        ordered_list("date", value).alias("_xs"),
    )
    return (
        grouped.withColumn("_xs", F.expr("transform(_xs, x -> x - mean)"))
        .withColumn("lags", newey_west_lags("n", 1))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("lags"))).alias("lag"))
        .select(
            *keys,
            "lag",
            (1.0 - F.col("lag") / (F.col("lags") + 1.0)).alias("weight"),
            lagged_dot("_xs", "n", F.col("lag")).alias("autocov"),
        )
    )


# --- trailing windows --------------------------------------------------------------------

def window_rows(aligned: DataFrame, p: Params) -> DataFrame:
    """The last years x trading_days rows per portfolio and window length, kept
    only where at least 90 % of the window exists."""
    own = Window.partitionBy("portfolio")
    rows = (
        aligned.withColumn("_back", F.row_number().over(own.orderBy(F.desc("date"))))
        .withColumn("_have", F.count(F.lit(1)).over(own))
    )
    years = F.array(*[F.lit(y) for y in p.fund_windows])
    td = p.trading_days
    return (
        rows.withColumn("years", F.explode(years))
        .where(F.col("_back") <= F.col("years") * td)
        .where(F.col("_have") >= F.floor(F.col("years") * F.lit(td * 0.9) + 1e-9))
        .drop("_back", "_have")
    )


def window_metrics(aligned: DataFrame, p: Params) -> DataFrame:
    """Ten rounded fields per portfolio and window; rows need `rf_annual`."""
    td, keys = p.trading_days, ["portfolio", "years"]
    rows = window_rows(aligned, p)
    main = with_drawdown(rows, keys).groupBy(*keys).agg(
        F.round(geometric_annual("ret", td), 4).alias("annualReturn"),
        F.round(annual_vol("ret", td), 4).alias("annualVolatility"),
        F.round(sharpe(p), 3).alias("sharpeRatio"),
        F.round(sortino(p), 3).alias("sortinoRatio"),
        F.round(F.min("drawdown"), 4).alias("maximumDrawdown"),
        F.round(calmar(p), 3).alias("calmarRatio"),
        F.round(capm_alpha(td), 4).alias("alpha"),
        F.round(beta(), 3).alias("beta"),
        F.round(geometric_annual("bench", td), 4).alias("benchmarkReturn"),
    )
    hac = alpha_newey_west(rows, keys, p).select(
        *keys, F.round("alphaTStat", 2).alias("alphaTStat")
    )
    return main.join(hac, keys)
