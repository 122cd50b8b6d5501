"""Every query by name: `CATALOG[name](screen) -> DataFrame`.

Results are flattened for comparison: dates as ISO text, string arrays joined,
doubles at six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.functions.exprs import gated_growth, gated_margin, ratio
from basketlab.functions.leaves import leaves
from basketlab.operators import (
    baskets,
    covariance,
    facts,
    forward,
    market,
    portfolio,
    prices,
    report,
    risk,
    scoring,
)
from basketlab.plans.screen import Screen
from basketlab.sources import bars as bar_source
from basketlab.sources import filings, forward_log, rates, snapshot, universe
from basketlab.sources.scratch import materialize, scratch_path

CATALOG: dict[str, Callable[[Screen], DataFrame]] = {}

DIGITS = 6
WHOLE = 1_000_000  # a horizon longer than any calendar


def query(fn):
    CATALOG[fn.__name__] = fn
    return fn


def tidy(df: DataFrame, *columns) -> DataFrame:
    df = df.select(*columns) if columns else df
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DoubleType):
            # prices are cents over shares and can end in an exact half, which
            # summation order would round either way
            c = F.round(c + 1e-9, DIGITS)
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.IntegerType, T.LongType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.array_join(c, " | ")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- sources and sinks -----------------------------------------------------------------

@query
def universe_load(s: Screen) -> DataFrame:
    rows = s.table("supplier").select(
        F.col("s_suppkey").alias("k"),
        F.concat(F.lit(" t"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("ticker"),
        F.col("s_suppkey").alias("line"),
        F.when(F.col("s_suppkey") % 11 == 0, F.lit("n/a"))
        .otherwise(F.col("s_suppkey").cast("string")).alias("cik"),
    )

    def listed(name: str, keep) -> DataFrame:
        return rows.where(keep).select(
            "ticker",
            F.when(F.col("k") % 13 != 0, F.concat(F.lit(f" {name} "), F.col("k").cast("string"))).alias("name"),
            F.when(F.col("k") % 7 != 0, F.lit(name)).alias("sector"),
            F.when(F.col("k") % 5 != 0, F.lit(f" {name} sub ")).alias("sub_industry"),
            "cik",
            "line",
        )

    lists = [
        listed("large", F.col("k") % 2 == 0),
        listed("mid", F.col("k") % 3 == 0),
        listed("small", F.col("k") % 5 < 3),
    ]
    return tidy(universe.load_universe(lists))


@query
def bars_load(s: Screen) -> DataFrame:
    asia = s.securities.where("sector = 'ASIA'")
    return tidy(bar_source.load_bars(s.raw_bars, asia, "2001-07-01", 3))


@query
def facts_flatten(s: Screen) -> DataFrame:
    path = scratch_path(s.spark, "filings")
    filings.nest_facts(s.facts, ["filing"]).write.option("compression", "gzip").json(path)
    flat = filings.flatten_filings(filings.read_filings(s.spark, path))
    return tidy(flat, "entity", "taxonomy", "concept", "unit", "start", "end", "val", "filed", "form")


def _yield_text(s: Screen) -> DataFrame:
    """Yield prints as the published CSV shows them: percent text, and December repeated with another value in the next year's file."""
    pct = F.round(F.col("rf_annual") * 100.0, 4)
    base = s.rf.select("date", pct.alias("pct"), F.year("date").alias("batch"))
    again = base.where(F.month("date") == 12).select(
        "date", (F.col("pct") + 0.5).alias("pct"), (F.col("batch") + 1).alias("batch")
    )
    return base.unionByName(again).select(
        F.date_format("date", "MM/dd/yyyy").alias("Date"), F.col("pct").cast("string").alias("3 Mo"), "batch"
    )


def _landed_yields(s: Screen) -> DataFrame:
    path = scratch_path(s.spark, "yields")
    _yield_text(s).write.partitionBy("batch").option("header", True).csv(path)
    rows = rates.read_yield_csv(s.spark, f"{path}/*/")
    return rows.withColumn("file", F.regexp_extract("file", r"batch=(\d+)", 1))


@query
def rf_load(s: Screen) -> DataFrame:
    return tidy(rates.parse_yields(_landed_yields(s)))


@query
def rf_fallback(s: Screen) -> DataFrame:
    path = scratch_path(s.spark, "rates")
    rates.refresh_cache(s.rf.withColumn("rf_annual", F.col("rf_annual") + 0.01), path)
    cached = s.spark.read.schema("date DATE, rf_annual DOUBLE").parquet(path)
    nothing = s.rf.where("rf_annual < 0")
    cases = {
        "primary": (s.rf, cached),
        "cached": (nothing, cached),
        "constant": (nothing, nothing),
    }
    out = None
    for name, (first, second) in cases.items():
        rows = rates.with_fallback(first, second, s.p.risk_free).agg(
            F.lit(name).alias("source"),
            F.count(F.lit(1)).alias("n"),
            F.min("date").alias("first_date"),
            F.avg("rf_annual").alias("mean_rf"),
        )
        out = rows if out is None else out.unionByName(rows)
    return tidy(out)


def _landed_log(s: Screen) -> str:
    path = scratch_path(s.spark, "log")
    line = F.to_json(F.struct("date", "runType", "armReturns"), {"ignoreNullFields": "false"})
    forward_log.record(s.marks, "daily", 1).select(line).write.text(path)
    return path


@query
def log_read(s: Screen) -> DataFrame:
    """Every mark of the log's lines."""
    return tidy(forward_log.explode_marks(forward_log.read_log(s.spark, _landed_log(s))))


@query
def rejects(s: Screen) -> DataFrame:
    """How many landed rows of the log and of the yields were kept, and how many not and
    why."""
    log = forward_log.rejected(forward_log.read_lines(s.spark, _landed_log(s)))
    prints = rates.read_prints(_landed_yields(s)).groupBy(F.coalesce("cause", F.lit("kept")).alias("cause"))
    counted = prints.agg(F.count(F.lit(1)).alias("n"))
    return tidy(log.withColumn("source", F.lit("log")).unionByName(counted.withColumn("source", F.lit("yields"))))


@query
def log_upsert(s: Screen) -> DataFrame:
    nav = forward.forward_nav(s.marks)
    old = forward_log.record(s.marks, "weekly", 1, nav)
    rerun = forward_log.record(
        s.marks.where("date >= '2024-01-10'").withColumn(
            "ret",
            F.when(F.dayofmonth("date") % 9 == 0, F.lit("NaN").cast("double"))
            .otherwise(F.col("ret") * 1.5),
        ),
        "daily", 2, nav,
    )
    merged = forward_log.upsert(old, rerun)
    shown = merged.select("date", "runType", "armNav", F.explode("armReturns").alias("arm", "ret"))
    return tidy(shown.withColumn("nav", F.col("armNav")[F.col("arm")]).drop("armNav"))


@query
def log_rebalance(s: Screen) -> DataFrame:
    """Every leaf of the records of the last two weeks after a run that selected anew."""
    from basketlab.plans.documents import weekly_record

    new = weekly_record(s, 2)
    merged = forward_log.upsert(forward_log.record(s.marks, "daily", 1), new)
    path = scratch_path(s.spark, "log")
    forward_log.write_dates(merged, path)
    kept = s.spark.read.parquet(path).withColumn("date", F.col("date").cast("string")).select(*merged.columns)
    last = s.marks.agg(F.date_sub(F.max("date"), 14)).scalar()
    shown = kept.where((F.col("date") > last.cast("string")) | F.col("rebalance").isNotNull())
    return tidy(leaves(shown.drop("run_seq"), "date"))


def _document(s: Screen, stocks: DataFrame) -> DataFrame:
    from basketlab.plans.documents import screen_document

    return screen_document(s, stocks)


@query
def snapshot_write(s: Screen) -> DataFrame:
    """The written document, read back: one row per published stock."""
    from basketlab.plans.documents import SNAPSHOT

    path = scratch_path(s.spark, "snapshot")
    snapshot.write_snapshot(_document(s, s.stocks), path)
    doc = snapshot.read_snapshot(s.spark, path, SNAPSHOT)
    rows = doc.select("success", "run_type", F.explode("portfolio.stocks").alias("x"))
    return tidy(
        rows.select(
            "success", "run_type", "x.rank", "x.ticker", "x.sector", "x.score", "x.peRatio",
            "x.return6M", "x.fundWeight",
        )
    )


@query
def snapshot_read(s: Screen) -> DataFrame:
    """Every leaf of the readable document; a failed run's is ignored."""
    from basketlab.plans.documents import SNAPSHOT

    path, failed = scratch_path(s.spark, "snapshot"), scratch_path(s.spark, "failed")
    document = materialize(_document(s, s.stocks), "document")
    snapshot.write_snapshot(document, path)
    snapshot.write_snapshot(document.withColumn("success", F.lit(False)), failed)
    good = snapshot.read_snapshot(s.spark, path, SNAPSHOT)
    bad = snapshot.read_snapshot(s.spark, failed, SNAPSHOT)
    return tidy(leaves(good.unionByName(bad)))


#: days by which the refreshed document's weekly run lies behind
STALE_DAYS = 28


def _refreshed(s: Screen) -> tuple[DataFrame, DataFrame]:
    """A weekly document of four weeks ago, published, and refreshed to the last bar: the
    document a reader now gets, and the log."""
    from basketlab.plans import daily
    from basketlab.plans.documents import SNAPSHOT

    root = scratch_path(s.spark, "published")
    weekly = Screen(s.spark, s.root, s.p, behind=STALE_DAYS)
    snapshot.publish(_document(weekly, weekly.stocks), root, 1)
    log = forward_log.record(s.marks, "weekly", 1)
    after, log = daily.refresh(snapshot.read_current(s.spark, root, SNAPSHOT), log, s, 2)
    snapshot.publish(after, root, 2)
    return snapshot.read_current(s.spark, root, SNAPSHOT), log


@query
def daily_refresh(s: Screen) -> DataFrame:
    """Every leaf of the document after a daily refresh."""
    return tidy(leaves(_refreshed(s)[0]))


@query
def gauge_load(s: Screen) -> DataFrame:
    last = s.gauges.agg(F.max("date")).scalar()
    return tidy(bar_source.load_gauges(s.gauges, last))


# --- projections, filters, predicates -----------------------------------------------------

@query
def annual_span_filter(s: Screen) -> DataFrame:
    return tidy(
        facts.annual_filter(s.facts), "entity", "item", "concept", "start", "end", "val", "filed", "form"
    )


@query
def liquidity_screen(s: Screen) -> DataFrame:
    return tidy(
        prices.liquidity_screen(s.raw_bars, s.p).where("reason IS NULL"),
        "security", "n_obs", "avg_volume", "last_price",
    )


@query
def screen_reason(s: Screen) -> DataFrame:
    return tidy(prices.liquidity_screen(s.raw_bars, s.p), "security", "reason")


@query
def health_data_filter(s: Screen) -> DataFrame:
    return tidy(facts.with_health_data(s.ratios), "security", *facts.HEALTH_FIELDS)


@query
def positive_pe(s: Screen) -> DataFrame:
    return tidy(s.ratios, "security", scoring.positive_pe().alias("pe_ranked"))


@query
def margin_gate(s: Screen) -> DataFrame:
    wide = facts.years_wide(facts.annual_series(s.facts))
    return tidy(wide, "entity", "end", gated_margin("net_income", "revenue").alias("margin"))


@query
def growth_gate(s: Screen) -> DataFrame:
    grown = facts.revenue_cagr(facts.years_wide(facts.annual_series(s.facts)))
    return tidy(grown, "entity", gated_growth("revenueGrowth").alias("growth"))


@query
def clean_returns(s: Screen) -> DataFrame:
    return tidy(prices.clean_returns(s.raw_bars), "security", "date", "ret")


@query
def finite_rows(s: Screen) -> DataFrame:
    return tidy(s.panel_rows)


@query
def coverage_filter(s: Screen) -> DataFrame:
    dates = prices.tail_dates(s.calendar, s.p.cov_window)
    return tidy(prices.coverage(s.returns, dates, s.p))


@query
def regime_label(s: Screen) -> DataFrame:
    vix = s.gauges.where("gauge = 'VIX'")
    return tidy(
        vix, "date", "close", market.regime_label("close", s.p).alias("regime"),
        market.volatility_level("close").alias("level"),
    )


@query
def stat_gate(s: Screen) -> DataFrame:
    """The gated panel on the whole series and on its beginnings around the gates."""
    own = F.row_number().over(risk.Window.partitionBy("portfolio").orderBy("date"))
    horizons = F.array(*[F.lit(h) for h in (2, 3, 19, 20, 59, 60, WHOLE)])
    rows = (
        s.aligned.withColumn("_i", own)
        .select(
            "portfolio", "date", "ret", F.col("bench").alias("base"), "_i",
            (F.col("rf_annual") / s.p.trading_days).alias("rf"), F.explode(horizons).alias("horizon"),
        )
        .where(F.col("_i") <= F.col("horizon"))
        .withColumn("active", F.col("ret") - F.col("base"))
    )
    return tidy(
        forward.comparison_stats(rows, ["portfolio", "horizon"], s.p),
        "portfolio", "horizon", "nDays", "activeReturnCumulative", "activeReturnAnnualised",
        "trackingError", "calmar_arm", "calmar_baseline", "neweyWestT",
    )


@query
def holdings_query(s: Screen) -> DataFrame:
    arm = s.arms.where("portfolio = 'qubo_classical'").select("security", "weight")
    found = report.holdings_query(
        report.holdings_detail(arm, s.stocks), sector="All", text=" 2 ", sort="weight"
    )
    return tidy(found, "security", "name", "sector", "weight", "partial")


@query
def reasons(s: Screen) -> DataFrame:
    return tidy(s.explained, "security", "reasons")


@query
def risk_flags(s: Screen) -> DataFrame:
    return tidy(s.explained, "security", "flags")


# --- joins ------------------------------------------------------------------------------

@query
def calendar_grid(s: Screen) -> DataFrame:
    return tidy(prices.calendar_grid(s.raw_bars), "security", "date", "close", "volume")


@query
def score_join(s: Screen) -> DataFrame:
    return tidy(
        s.scored, "security", "netMargin", "returnOnEquity", "return6M", "return3M",
        "healthScore", "valuationScore", "momentumScore", "score",
    )


@query
def sector_lookup(s: Screen) -> DataFrame:
    """Bars' securities with their sector; one without an entry would be `Unknown`."""
    known = s.securities.select("security", "sector")
    priced = s.raw_bars.select("security").distinct()
    return tidy(
        priced.join(known, "security", "left"),
        "security", F.coalesce("sector", F.lit("Unknown")).alias("sector"),
    )


@query
def benchmark_align(s: Screen) -> DataFrame:
    rows = portfolio.portfolio_returns(s.book, s.returns, s.bars)
    return tidy(portfolio.align(rows, s.bench), "portfolio", "date", "ret", "bench")


@query
def rf_asof(s: Screen) -> DataFrame:
    dated = rates.asof(s.calendar.select("date"), s.rf, s.p.risk_free)
    return tidy(
        dated, "date", "rf_annual", (F.col("rf_annual") / s.p.trading_days * 1000.0).alias("rf_daily_milli")
    )


@query
def rf_mean_fill(s: Screen) -> DataFrame:
    dates = s.marks.select("date").distinct()
    filled = rates.mean_filled(dates, s.rf_daily)
    return tidy(filled, "date", (F.col("rf") * 1000.0).alias("rf_milli"))


def _wide(s: Screen) -> DataFrame:
    return facts.with_anchors(facts.years_wide(facts.annual_series(s.facts)))


@query
def fcf_match(s: Screen) -> DataFrame:
    rows = _wide(s).where("fcf_rank IS NOT NULL")
    return tidy(rows, "entity", "end", (F.col("cfo") - F.col("capex")).alias("fcf"), "revenue")


@query
def growth_anchor(s: Screen) -> DataFrame:
    rows = _wide(s).groupBy("entity").agg(*facts.growth_anchor_aggs())
    return tidy(
        rows.select(
            "entity", "rev_end", "rev_last", F.col("anchor.end").alias("anchor_end"),
            F.col("anchor.revenue").alias("anchor_val"),
        ).where("rev_end IS NOT NULL")
    )


@query
def candidate_pairs(s: Screen) -> DataFrame:
    return tidy(baskets.candidate_pairs(s.pool))


@query
def arm_pairs(s: Screen) -> DataFrame:
    return tidy(forward.arm_pairs(s.marks))


@query
def selection_diff(s: Screen) -> DataFrame:
    return tidy(forward.selection_diff(s.selections))


@query
def held_semi(s: Screen) -> DataFrame:
    late = s.bars.where("date >= '2001-10-29'").select("security").distinct()
    return tidy(portfolio.held_weights(s.book, late), "portfolio", "security", "weight")


@query
def holdings_detail(s: Screen) -> DataFrame:
    arm = s.arms.where("portfolio = 'qubo_quantum'").select("security", "weight")
    return tidy(
        report.holdings_detail(arm, s.stocks), "security", "partial", "rank", "score", "weight"
    )


@query
def nav_overlay(s: Screen) -> DataFrame:
    # the forward record starts after the last bar, so it is moved back to overlap
    nav = portfolio.nav_series(s.aligned)
    back = forward.forward_nav(s.marks).where("arm = 'greedy'").withColumn(
        "date", F.date_sub("date", 9135)
    )
    return tidy(report.nav_overlay(nav, back))


# --- aggregations -----------------------------------------------------------------------

@query
def annual_series(s: Screen) -> DataFrame:
    return tidy(facts.annual_series(s.facts), "entity", "item", "end", "val")


@query
def merged_annual_max(s: Screen) -> DataFrame:
    merged = facts.concept_series(s.facts).where("merged")
    return tidy(
        merged.groupBy("entity", "item", "end").agg(F.max("val").alias("val"), F.count("val").alias("concepts"))
    )


@query
def latest_value(s: Screen) -> DataFrame:
    rows = facts.annual_series(s.facts).groupBy("entity", "item").agg(
        F.max("end").alias("end"), F.max_by("val", "end").alias("val")
    )
    return tidy(rows)


@query
def shares_outstanding(s: Screen) -> DataFrame:
    return tidy(facts.shares_outstanding(s.facts))


@query
def revenue_cagr(s: Screen) -> DataFrame:
    wide = facts.years_wide(facts.annual_series(s.facts))
    return tidy(facts.revenue_cagr(wide), "entity", "rev_n", "revenueGrowth")


@query
def matched_fcf(s: Screen) -> DataFrame:
    wide = facts.years_wide(facts.annual_series(s.facts))
    return tidy(facts.matched_fcf(wide))


@query
def fundamental_ratios(s: Screen) -> DataFrame:
    return tidy(s.ratios, "security", *facts.RATIOS)


@query
def fundamentals_coverage(s: Screen) -> DataFrame:
    return tidy(
        s.ratios.agg(F.count("netMargin").alias("usable"), F.count(F.lit(1)).alias("names"))
    )


@query
def sector_pe_median(s: Screen) -> DataFrame:
    return tidy(scoring.sector_pe_median(s.names), "sector", "pe_median", "n")


@query
def pillar_score(s: Screen) -> DataFrame:
    ranked = scoring.rank_in_scope(scoring.factor_rows(s.names), s.p)
    return tidy(scoring.pillar_scores(ranked), "security", "health", "valuation", "momentum")


@query
def composite_score(s: Screen) -> DataFrame:
    return tidy(
        scoring.score_universe(s.names, s.p), "security", "healthScore", "valuationScore",
        "momentumScore", "score",
    )


@query
def screen_funnel(s: Screen) -> DataFrame:
    return tidy(scoring.screen_funnel(s.securities, s.screened, s.names))


@query
def portfolio_returns(s: Screen) -> DataFrame:
    return tidy(portfolio.portfolio_returns(s.book, s.returns, s.bars), "portfolio", "date", "ret")


@query
def latest_mark(s: Screen) -> DataFrame:
    clipped = portfolio.latest_marks(s.arms, s.returns, s.bars)
    raw = portfolio.latest_marks(s.arms, prices.daily_returns(s.bars), s.bars)
    return tidy(
        clipped.select("portfolio", "date", F.col("ret").alias("weekly_ret")).join(
            raw.select("portfolio", F.col("ret").alias("daily_ret")), "portfolio"
        )
    )


@query
def blended_fundamentals(s: Screen) -> DataFrame:
    held = s.book.join(s.scored.drop("score"), "security")
    return tidy(portfolio.blended(held))


@query
def sector_breakdown(s: Screen) -> DataFrame:
    return tidy(portfolio.sector_breakdown(s.arms))


def _per_portfolio(s: Screen, *aggs) -> DataFrame:
    return tidy(s.series.groupBy("portfolio").agg(*aggs))


@query
def annual_return(s: Screen) -> DataFrame:
    return _per_portfolio(s, risk.geometric_annual("ret", s.p.trading_days).alias("annual_return"))


@query
def annual_volatility(s: Screen) -> DataFrame:
    return _per_portfolio(s, risk.annual_vol("ret", s.p.trading_days).alias("annual_volatility"))


@query
def sharpe_ratio(s: Screen) -> DataFrame:
    return _per_portfolio(s, risk.sharpe(s.p).alias("sharpe_ratio"))


@query
def sharpe_excess(s: Screen) -> DataFrame:
    rows = s.series.withColumn("x", F.col("ret") - F.col("rf_annual") / s.p.trading_days)
    return tidy(
        rows.groupBy("portfolio").agg(forward.sharpe_excess("x", s.p.trading_days).alias("sharpe_excess"))
    )


@query
def sortino_ratio(s: Screen) -> DataFrame:
    rows = s.series.withColumn("rf", F.col("rf_annual") / s.p.trading_days)
    return tidy(
        rows.groupBy("portfolio").agg(
            risk.sortino(s.p).alias("sortino_ratio"),
            forward.forward_sortino("ret", "rf", s.p.trading_days).alias("sortino_forward"),
        )
    )


@query
def calmar_ratio(s: Screen) -> DataFrame:
    rows = risk.with_drawdown(s.series, ["portfolio"])
    return tidy(rows.groupBy("portfolio").agg(risk.calmar(s.p).alias("calmar_ratio")))


@query
def value_at_risk(s: Screen) -> DataFrame:
    return _per_portfolio(s, risk.value_at_risk().alias("value_at_risk"))


@query
def conditional_var(s: Screen) -> DataFrame:
    rows = risk.with_tail(s.series, ["portfolio"])
    return tidy(rows.groupBy("portfolio").agg(risk.tail_mean().alias("conditional_var")))


@query
def win_rate(s: Screen) -> DataFrame:
    return _per_portfolio(s, risk.win_rate().alias("win_rate"))


@query
def skew_kurtosis(s: Screen) -> DataFrame:
    return _per_portfolio(s, risk.skew().alias("skewness"), risk.excess_kurtosis().alias("kurtosis"))


def _per_aligned(s: Screen, *aggs) -> DataFrame:
    return tidy(s.aligned.groupBy("portfolio").agg(*aggs))


@query
def beta(s: Screen) -> DataFrame:
    return _per_aligned(s, risk.beta().alias("beta"))


@query
def capm_alpha(s: Screen) -> DataFrame:
    return _per_aligned(s, risk.capm_alpha(s.p.trading_days).alias("capm_alpha"))


@query
def tracking_error(s: Screen) -> DataFrame:
    return _per_aligned(s, risk.tracking_error(s.p.trading_days).alias("tracking_error"))


@query
def information_ratio(s: Screen) -> DataFrame:
    td = s.p.trading_days
    active = F.col("ret") - F.col("bench")
    te = risk.tracking_error(td)
    return _per_aligned(
        s,
        risk.information_ratio(td).alias("information_ratio"),
        ratio(F.avg(active) * td, F.when(te != 0, te)).alias("information_forward"),
    )


@query
def metrics_summary(s: Screen) -> DataFrame:
    return tidy(risk.metrics_summary(s.series, ["portfolio"], s.p))


@query
def window_metrics(s: Screen) -> DataFrame:
    return tidy(risk.window_metrics(s.aligned, s.p))


@query
def alpha_newey_west(s: Screen) -> DataFrame:
    return tidy(risk.alpha_newey_west(s.aligned, ["portfolio"], s.p))


@query
def newey_west_mean(s: Screen) -> DataFrame:
    rows = s.aligned.withColumn("active", F.col("ret") - F.col("bench"))
    return tidy(risk.newey_west_mean(rows, ["portfolio"], "active"))


@query
def prob_sharpe(s: Screen) -> DataFrame:
    rows = s.series.withColumn("x", F.col("ret") - F.col("rf_annual") / s.p.trading_days)
    found = rows.groupBy("portfolio").agg(*forward.moments("x", "x"))
    return tidy(found, "portfolio", forward.prob_sharpe("x").alias("prob_sharpe"))


@query
def cumulative_active(s: Screen) -> DataFrame:
    rows = forward.against_baseline(s.marks, s.p)
    return tidy(
        rows.groupBy("arm").agg(
            F.count(F.lit(1)).alias("n_days"),
            (F.product(1.0 + F.col("active")) - 1.0).alias("cumulative_active"),
        )
    )


@query
def forward_stats(s: Screen) -> DataFrame:
    return tidy(forward.forward_stats(s.compared, s.p))


@query
def selection_jaccard(s: Screen) -> DataFrame:
    return tidy(forward.jaccard(s.selections))


def _cov(s: Screen, method: str) -> DataFrame:
    rows = covariance.covariance(s.panel_rows, s.numbered_pool, s.cov_p, method)
    # covariances are small: shown in units of 1e-4
    return tidy(rows, "i", "j", "security_i", "security_j", (F.col("c") * 1e4).alias("cov_bp"))


@query
def cov_sample(s: Screen) -> DataFrame:
    return _cov(s, "sample")


@query
def cov_ewma(s: Screen) -> DataFrame:
    return _cov(s, "ewma")


@query
def cov_ledoit(s: Screen) -> DataFrame:
    return _cov(s, "ledoit")


def _recent_gauges(s: Screen) -> DataFrame:
    last = s.gauges.agg(F.max("date")).scalar()
    return market.gauge_changes(bar_source.load_gauges(s.gauges, last))


@query
def gauge_change(s: Screen) -> DataFrame:
    return tidy(_recent_gauges(s))


@query
def market_summary(s: Screen) -> DataFrame:
    return tidy(market.market_summary(_recent_gauges(s), s.p))


def _schemes(s: Screen) -> DataFrame:
    chosen = s.pool.where(F.col("pos") <= s.p.basket_size)
    return materialize(baskets.weight_schemes(chosen, s.factors, s.p), "schemes")


@query
def weight_report(s: Screen) -> DataFrame:
    rows = baskets.weight_report(_schemes(s), s.factors, s.p)
    return tidy(rows.withColumn("wCw_bp", F.col("wCw") * 1e4).drop("wCw", "quality", "ridge"))


@query
def arm_fund_report(s: Screen) -> DataFrame:
    """Every leaf of every arm's fund record."""
    return tidy(leaves(materialize(s.fund_records(), "funds"), "portfolio"))


@query
def research_block(s: Screen) -> DataFrame:
    """Every leaf of the experiment's record."""
    from basketlab.plans.documents import research_document

    return tidy(leaves(materialize(research_document(s), "research")))


# --- windows ----------------------------------------------------------------------------

@query
def pct_rank_universe(s: Screen) -> DataFrame:
    return tidy(
        scoring.rank_universe(scoring.factor_rows(s.names)), "security", "factor", "value", "pctl"
    )


@query
def pct_rank_sector(s: Screen) -> DataFrame:
    ranked = scoring.rank_in_scope(scoring.factor_rows(s.names), s.p)
    return tidy(ranked, "security", "sector", "factor", "pctl", "sectorRanked")


@query
def ffill_prices(s: Screen) -> DataFrame:
    return tidy(prices.forward_fill(prices.calendar_grid(s.raw_bars)), "security", "date", "filled")


@query
def trailing_returns(s: Screen) -> DataFrame:
    windows = [name for name, _ in s.p.return_windows]
    return tidy(prices.trailing_variants(s.bars, s.p), "security", "price", *windows, "return1Y_daily")


@query
def daily_returns(s: Screen) -> DataFrame:
    return tidy(prices.daily_returns(s.raw_bars), "security", "date", "ret")


@query
def nav_series(s: Screen) -> DataFrame:
    return tidy(portfolio.nav_series(s.aligned))


@query
def nav_downsample(s: Screen) -> DataFrame:
    return tidy(portfolio.downsample(portfolio.nav_series(s.aligned), s.p.nav_points))


@query
def max_drawdown(s: Screen) -> DataFrame:
    rows = risk.with_drawdown(s.series, ["portfolio"])
    return tidy(rows.groupBy("portfolio").agg(F.min("drawdown").alias("max_drawdown")))


@query
def drawdown_duration(s: Screen) -> DataFrame:
    rows = risk.with_drawdown(s.series, ["portfolio"])
    return tidy(rows.groupBy("portfolio").agg(F.max("underwater").alias("rows_below_peak")))


@query
def tail_rows(s: Screen) -> DataFrame:
    return tidy(
        prices.tail_rows(s.returns, ["security"], 60), "security", "date", "ret", "back"
    )


@query
def ewma_weights(s: Screen) -> DataFrame:
    return tidy(covariance.window_rows(s.panel_rows, s.cov_p, "ewma"), F.col("k").alias("row"), F.col("w").alias("weight"))


@query
def autocov_lags(s: Screen) -> DataFrame:
    rows = s.aligned.withColumn("active", (F.col("ret") - F.col("bench")) * 100.0)
    return tidy(risk.autocov_lags(rows, ["portfolio"], "active"))


@query
def forward_nav(s: Screen) -> DataFrame:
    return tidy(forward.forward_nav(s.marks).withColumn("nav", F.round("nav", 5)))


@query
def forward_sparkline(s: Screen) -> DataFrame:
    return tidy(forward.sparkline(forward.forward_nav(s.marks), "qubo_quantum"))


@query
def capped_weights(s: Screen) -> DataFrame:
    return tidy(s.book, "portfolio", "security", "weight")


@query
def rank_number(s: Screen) -> DataFrame:
    return tidy(s.top, "rank", "security", "score")


# --- top-k ------------------------------------------------------------------------------

@query
def screen_top_n(s: Screen) -> DataFrame:
    best = scoring.with_reasons(s.stocks, s.medians)
    windows = [name for name, _ in s.p.return_windows]
    return tidy(
        best, "rank", "security", "name", "sector", "sub_industry", "price", "score",
        "healthScore", "valuationScore", "momentumScore", *facts.RATIOS, *windows, "fundWeight",
        "reasons", "flags",
    )


@query
def candidate_pool(s: Screen) -> DataFrame:
    return tidy(s.pool, "pos", "security", "sector", "score", *facts.RATIOS)


@query
def recent_matched_years(s: Screen) -> DataFrame:
    return tidy(_wide(s).where("fcf_rank <= 3"), "entity", "end", "fcf_rank")


@query
def top_strengths(s: Screen) -> DataFrame:
    named = s.scored.select("security", F.posexplode(scoring.strengths()).alias("place", "x"))
    return tidy(
        named.select("security", "place", F.col("x.p").alias("pctl"), F.col("x.s").alias("strength"))
    )


@query
def top_sectors(s: Screen) -> DataFrame:
    return tidy(report.top_sectors(portfolio.sector_breakdown(s.arms)))


@query
def sector_options(s: Screen) -> DataFrame:
    arm = s.arms.where("portfolio = 'qubo_classical'").select("security", "weight")
    return tidy(report.sector_options(report.holdings_detail(arm, s.stocks)))


# --- set operations ----------------------------------------------------------------------

@query
def reprice_universe(s: Screen) -> DataFrame:
    return tidy(portfolio.reprice_universe(s.top, s.arms, s.p))


@query
def selection_sets(s: Screen) -> DataFrame:
    rows = forward.membership(s.selections)
    kind = (
        F.when(F.col("in_a") & F.col("in_b"), "both")
        .when(F.col("in_a"), "only_a")
        .otherwise("only_b")
    )
    return tidy(rows, "pair", "security", kind.alias("side"))


@query
def aligned_dates(s: Screen) -> DataFrame:
    return tidy(forward.aligned_marks(s.marks), "date", "arm", "ret")


# --- experiment --------------------------------------------------------------------------

@query
def block_bootstrap_sharpe(s: Screen) -> DataFrame:
    return tidy(forward.block_bootstrap(s.compared, ["arm"], s.p))


@query
def objective_terms(s: Screen) -> DataFrame:
    cov = materialize(covariance.covariance(s.panel_rows, s.numbered_pool, s.cov_p), "cov")
    return tidy(baskets.objective_terms(cov, s.pool, s.p, s.p.basket_size))


@query
def score_candidate_selections(s: Screen) -> DataFrame:
    return tidy(baskets.score_baskets(s.components, s.p), "basket", "size", "energy", "energy_std", "is_best")


SWEEP = [
    (l1, l2, 3.0, l4) for l1 in (0.5, 1.0, 2.0) for l2 in (0.0, 1.0, 5.0) for l4 in (0.0, 0.1)
]


@query
def lambda_sweep(s: Screen) -> DataFrame:
    return tidy(baskets.lambda_sweep(s.components, SWEEP))


@query
def choose_weights(s: Screen) -> DataFrame:
    chosen = baskets.choose_weights(baskets.weight_report(_schemes(s), s.factors, s.p))
    return tidy(chosen.withColumn("wCwScore_bp", F.col("wCwScore") * 1e4).drop("wCwScore"))


@query
def arm_diagnostics(s: Screen) -> DataFrame:
    """How each arm's names and weights were found."""
    rows = s.diagnostics
    for name in ("lambdas", "weightLambdas"):
        keys = ("l1", "l2", "l3", "l4") if name == "lambdas" else ("l1", "l2")
        rows = rows.withColumns({f"{name}_{k}": F.col(name)[k] for k in keys}).drop(name)
    bp = {f"{c}_bp": F.col(c) * 1e4 for c in ("wSigmaWScore", "wSigmaW")}
    return tidy(rows.withColumns(bp).drop("wSigmaWScore", "wSigmaW"))


@query
def arm_choice(s: Screen) -> DataFrame:
    """Every arm's candidate and scheme, with each name's weight."""
    won = s.winners.select(F.col("arm").alias("portfolio"), "basket")
    used = s.choice.select(F.col("arm").alias("portfolio"), "scheme")
    rows = s.arms.join(F.broadcast(won), "portfolio", "left").join(F.broadcast(used), "portfolio")
    return tidy(rows, "portfolio", "basket", "scheme", "security", "sector", "weight")


# --- streams ------------------------------------------------------------------------------

@query
def stream_daily_marks(s: Screen) -> DataFrame:
    from basketlab.streaming.marks import replay_marks

    return tidy(replay_marks(s))


@query
def stream_log_upsert(s: Screen) -> DataFrame:
    from basketlab.streaming.log import replay_log

    return tidy(replay_log(s))
