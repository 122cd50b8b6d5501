"""The daily refresh: re-price a frozen selection, ranks untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlab.functions.exprs import iso, ordered_list
from basketlab.operators import forward, market, portfolio, prices, report, risk
from basketlab.params import Params
from basketlab.plans import documents
from basketlab.plans.screen import FUND_NAME, Screen
from basketlab.sources import bars as bar_source
from basketlab.sources import forward_log, rates
from basketlab.sources.scratch import materialize


def refreshed_stocks(stocks: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    """Frozen rows with new prices and trailing returns; a name without bars
    keeps what it had."""
    names = [name for name, _ in p.return_windows]
    fresh = prices.trailing_returns(
        bars.join(stocks.select("security"), "security", "left_semi"), p,
        positive_base=True, dates=bars,
    ).select("security", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in ["price", *names]])
    joined = stocks.join(fresh, "security", "left")
    new = {"price": F.coalesce("_price", "price")}
    new |= {n: F.when(F.col("_hit"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names}
    return joined.withColumns(new).drop("_hit", "_price", *[f"_{n}" for n in names])


def refreshed_log(
    log: DataFrame, arms: DataFrame, bars: DataFrame, run_seq: int
) -> DataFrame:
    """The log with the last date's unclipped marks of frozen arm weights."""
    marks = portfolio.latest_marks(arms, prices.daily_returns(bars), bars)
    rows = marks.select("date", F.col("portfolio").alias("arm"), "ret")
    return forward_log.upsert(log, forward_log.record(rows, "daily", run_seq))


def frozen_arms(document: DataFrame) -> DataFrame:
    """(portfolio, security, weight) of every arm, as the document holds them."""
    arms = document.select(F.explode("portfolio.research.arms").alias("a"))
    return arms.select(F.col("a.key").alias("portfolio"), F.explode("a.weights").alias("security", "weight"))


def refreshed_fund(s: Screen, arms: DataFrame, stocks: DataFrame, document: DataFrame) -> DataFrame:
    """One row: the baseline's fund record on frozen weights and new bars. `stocks` are
    the published rows by security; names and the benchmark's label stay."""
    # one arm's names, a bounded number
    own = arms.where(F.col("portfolio") == s.p.baseline_arm)
    held = materialize(own.join(stocks.drop("score"), "security", "left"), "held")
    series = portfolio.align(portfolio.portfolio_returns(held, s.returns, s.bars), s.bench)
    aligned = materialize(rates.attach(series, s.rf, s.p.risk_free), "aligned")
    said = document.select(F.lit(s.p.baseline_arm).alias("portfolio"), "portfolio.fund.weighting")
    return report.fund_records(
        held,
        portfolio.blended(held),
        risk.window_metrics(aligned, s.p),
        portfolio.downsample(portfolio.nav_series(aligned), s.p.nav_points),
        portfolio.sector_breakdown(held),
        s.p,
        name=FUND_NAME,
        weighting=said,
    ).drop("portfolio")


def refresh(document: DataFrame, log: DataFrame, s: Screen, run_seq: int) -> tuple[DataFrame, DataFrame]:
    """(document, log) after a day: prices, trailing returns, the fund, the market and
    the forward record are new; ranks, scores, selections and weights stay as they were.

    `document` is one row; its nested rows are taken out, joined by their keys and put
    back, so only as many rows as it holds move. `s` has the bars up to the day.
    """
    document = materialize(document, "before")
    stocks = document.select(F.inline("portfolio.stocks"))
    order = stocks.columns
    stocks = materialize(
        refreshed_stocks(stocks.withColumnRenamed("ticker", "security"), s.bars, s.p), "stocks"
    )
    listed = stocks.withColumnRenamed("security", "ticker").select(*order)
    arms = materialize(frozen_arms(document), "frozen")
    fund = materialize(refreshed_fund(s, arms, stocks, document), "fund")
    log = materialize(refreshed_log(log, arms, s.bars, run_seq), "log")
    marks = materialize(
        forward_log.explode_marks(log).withColumn("date", F.col("date").cast("date")), "marks"
    )
    stats, nav = refreshed_stats(marks, s.daily_rates(marks), s.p)
    points = forward.nav_points(nav).select(iso("date").alias("date"), "nav")
    stats = materialize(stats, "stats")
    newest = s.gauges.agg(F.max("date")).scalar()
    conditions = market.market_summary(
        market.gauge_changes(bar_source.load_gauges(s.gauges, newest)), s.p
    )

    def rows_of(df: DataFrame, by: str) -> Column:
        return df.agg(ordered_list(by, F.struct(*df.columns))).scalar()

    pinned = F.col("portfolio.fund")
    new_fund = fund.select(F.struct(*fund.columns)).scalar()
    changed = (
        F.col("portfolio")
        .withField("stocks", rows_of(listed, "rank"))
        .withField("fund", new_fund.withField("benchmark", pinned["benchmark"]).withField("name", pinned["name"]))
        .withField("marketConditions", documents.conditions_of(conditions, newest))
        .withField("pricesAsOf", newest.cast("string"))
        .withField("research.forwardStats", rows_of(stats, "arm"))
        .withField("research.forwardNav", rows_of(points, "date"))
    )
    after = document.select(
        "success",
        newest.cast("string").alias("date"),
        F.lit(None).cast("double").alias("elapsed_seconds"),
        "backend_version",
        F.lit("daily").alias("run_type"),
        changed.alias("portfolio"),
    )
    return after, log


def refreshed_stats(marks: DataFrame, rf_daily: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Forward statistics and NAV, both recomputed from the log's marks."""
    rows = materialize(forward.compared(marks, rf_daily, p), "compared")
    return forward.forward_stats(rows, p), forward.forward_nav(marks)
