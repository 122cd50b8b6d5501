"""The weekly screen as one lazily built set of tables.

Each attribute is a DataFrame. The few tables that many branches share (bars,
measures, names, scores, arms, series) are written when first touched and read
back, so a plan that uses them several times neither recomputes them nor guesses
their size; all else runs with the action on the result.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.operators import (
    baskets,
    covariance,
    facts,
    forward,
    portfolio,
    prices,
    report,
    risk,
    scoring,
)
from basketlab.params import COVARIANCE_DAYS, COVARIANCE_ROWS, COVARIANCE_YEARS, WEEKLY_BARS, Params
from basketlab.sources import rates, warehouse
from basketlab.sources.scratch import materialize

FUND_NAME = "Screened fund"


class Screen:
    def __init__(self, spark: SparkSession, root: str, params: Params = WEEKLY_BARS, behind: int = 0):
        """`behind`: how many days before the last bar this screen ends, as an earlier
        run did."""
        self.spark, self.root, self.behind = spark, root, behind
        self.p = params.with_conf(spark)
        self.cov_p = replace(self.p, trading_days=COVARIANCE_ROWS, lookback_years=COVARIANCE_YEARS)

    def table(self, name: str) -> DataFrame:
        return warehouse.table(self.spark, self.root, name)

    # --- landed data ------------------------------------------------------------------

    @cached_property
    def securities(self) -> DataFrame:
        return warehouse.securities(
            self.table("supplier"), self.table("nation"), self.table("region")
        )

    @cached_property
    def raw_bars(self) -> DataFrame:
        """Bars derived on the fly: for jobs that pass over them once."""
        rows = warehouse.bars(self.table("lineitem"))
        if not self.behind:
            return rows
        last = rows.agg(F.date_sub(F.max("date"), self.behind)).scalar()
        return rows.where(F.col("date") <= last)

    @cached_property
    def bars(self) -> DataFrame:
        """Bars kept as a table, a fraction of the lines they come from."""
        return materialize(self.raw_bars, "bars")

    @cached_property
    def facts(self) -> DataFrame:
        return warehouse.facts(self.table("lineitem"))

    @cached_property
    def rf(self) -> DataFrame:
        return warehouse.yields(self.table("orders"))

    @cached_property
    def marks(self) -> DataFrame:
        return warehouse.forward_marks(self.table("events"))

    @cached_property
    def gauges(self) -> DataFrame:
        return warehouse.gauges(self.table("lineitem"))

    # --- prices ------------------------------------------------------------------------

    @cached_property
    def calendar(self) -> DataFrame:
        return prices.calendar(self.bars)

    @cached_property
    def returns(self) -> DataFrame:
        return prices.clean_returns(self.bars)

    @cached_property
    def bench(self) -> DataFrame:
        return prices.benchmark_returns(self.returns)

    @cached_property
    def measures(self) -> DataFrame:
        return materialize(prices.security_measures(self.bars, self.p), "measures")

    @cached_property
    def screened(self) -> DataFrame:
        return self.measures.select(
            "security", "n_obs", "avg_volume", "last_price", "reason"
        )

    @cached_property
    def survivors(self) -> DataFrame:
        windows = [name for name, _ in self.p.return_windows]
        return self.measures.where("reason IS NULL").select(
            "security", F.col("last_price").alias("price"), *windows
        )

    # --- fundamentals and scores ----------------------------------------------------------

    @cached_property
    def ratios(self) -> DataFrame:
        """Ratios of the survivors; their facts alone are aggregated."""
        kept = self.survivors.select(F.col("security").alias("entity"))
        mine = self.facts.join(kept, "entity", "left_semi")
        return facts.fundamental_ratios(mine, self.survivors)

    @cached_property
    def names(self) -> DataFrame:
        """Scorable names: ratios, trailing returns and sector, one row each."""
        looked_up = self.securities.select("security", "name", "sector", "sub_industry")
        rows = (
            facts.with_health_data(self.ratios)
            .join(looked_up, "security", "left")
            .withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
        )
        return materialize(rows, "names")

    @cached_property
    def scored(self) -> DataFrame:
        scores = scoring.score_universe(self.names, self.p)
        return materialize(self.names.join(scores, "security"), "scored")

    @cached_property
    def medians(self) -> DataFrame:
        return scoring.sector_pe_median(self.scored)

    @cached_property
    def explained(self) -> DataFrame:
        return scoring.with_reasons(self.scored, self.medians)

    @cached_property
    def top(self) -> DataFrame:
        return materialize(scoring.top_by_score(self.scored, self.p.top_n), "top")

    @cached_property
    def pool(self) -> DataFrame:
        return materialize(
            scoring.top_by_score(self.scored, self.p.pool_size)
            .withColumn("pos", F.col("rank"))
            .select("pos", *self.scored.columns),
            "pool",
        )

    # --- portfolios ------------------------------------------------------------------------

    @cached_property
    def book(self) -> DataFrame:
        """One score-weighted portfolio per sector, over every security."""
        holdings = self.securities.select(
            F.col("sector").alias("portfolio"), "security", F.col("balance").alias("score")
        )
        return portfolio.capped_weights(holdings, self.p.max_weight)

    @cached_property
    def series(self) -> DataFrame:
        """Return series of the book with benchmark (null on day one) and yield:
        portfolios x dates rows, kept because measures branch from it."""
        rows = portfolio.portfolio_returns(self.book, self.returns, self.bars)
        # one benchmark row per trading date
        rows = rows.join(F.broadcast(self.bench), "date", "left")
        return materialize(rates.attach(rows, self.rf, self.p.risk_free), "series")

    @cached_property
    def aligned(self) -> DataFrame:
        return self.series.where("bench IS NOT NULL")

    @cached_property
    def candidates(self) -> DataFrame:
        return materialize(baskets.candidate_baskets(self.pool, self.p.basket_size), "candidates")

    @cached_property
    def components(self) -> DataFrame:
        rows = baskets.basket_components(self.candidates, self.pool, self.factors, self.p.basket_size)
        return materialize(rows, "components")

    @cached_property
    def winners(self) -> DataFrame:
        return materialize(baskets.arm_winners(self.components, self.p), "winners")

    @cached_property
    def chosen(self) -> DataFrame:
        return materialize(
            baskets.arm_selections(self.winners, self.candidates, self.pool, self.p), "chosen"
        )

    @cached_property
    def arm_schemes(self) -> DataFrame:
        return materialize(baskets.weight_schemes(self.chosen, self.factors, self.p), "arm-schemes")

    @cached_property
    def choice(self) -> DataFrame:
        """How each arm is weighted: one row an arm."""
        rows = baskets.weight_report(self.arm_schemes, self.factors, self.p)
        return materialize(baskets.choose_by_arm(rows, self.p), "choice")

    @cached_property
    def diagnostics(self) -> DataFrame:
        return baskets.diagnostics(self.winners, self.choice, self.p, self.p.basket_size)

    @cached_property
    def arms(self) -> DataFrame:
        """(portfolio, security, sector, score, weight): the baseline takes the best
        scores, the two others the lowest objective of their candidates, weighted by
        the same objective."""
        rows = baskets.arm_weights(self.chosen, self.arm_schemes, self.choice, self.p)
        return materialize(rows, "arms")

    @cached_property
    def selections(self) -> DataFrame:
        return self.arms.select(F.col("portfolio").alias("arm"), "security")

    @cached_property
    def selections_with_weights(self) -> DataFrame:
        return self.arms.select(F.col("portfolio").alias("arm"), "security", "weight")

    @cached_property
    def stocks(self) -> DataFrame:
        """Published rows: the top names with their weight in the baseline fund."""
        picked = self.top.select(F.lit(self.p.baseline_arm).alias("portfolio"), "security", "score")
        fund = portfolio.capped_weights(picked, self.p.max_weight).select(
            "security", F.round("weight", 5).alias("fundWeight")
        )
        return self.top.join(fund, "security", "left")

    @cached_property
    def arm_aligned(self) -> DataFrame:
        rows = portfolio.align(
            portfolio.portfolio_returns(self.arms, self.returns, self.bars), self.bench
        )
        return rates.attach(rows, self.rf, self.p.risk_free)

    def fund_records(self) -> DataFrame:
        held = self.arms.join(
            self.scored.drop("sector", "score"), "security"
        )
        aligned = materialize(self.arm_aligned, "aligned")
        nav = portfolio.downsample(portfolio.nav_series(aligned), self.p.nav_points)
        return report.fund_records(
            self.arms,
            portfolio.blended(held),
            risk.window_metrics(aligned, self.p),
            nav,
            portfolio.sector_breakdown(self.arms),
            self.p,
            name=FUND_NAME,
            weighting=self.choice.select(
                F.col("arm").alias("portfolio"),
                F.when(F.col("arm") == self.p.baseline_arm, report.BY_SCORE)
                .when(F.col("weighting") == "objective", report.BY_OBJECTIVE)
                .otherwise(report.BY_FALLBACK)
                .alias("weighting"),
            ),
        )

    # --- covariance -------------------------------------------------------------------------

    @cached_property
    def long_bars(self) -> DataFrame:
        return materialize(warehouse.bars(self.table("lineitem"), COVARIANCE_DAYS), "long-bars")

    @cached_property
    def panel_rows(self) -> DataFrame:
        """Unfilled returns of the pool on dates complete for the names covered."""
        with ThreadPoolExecutor(1) as side:  # the pool doesn't come from these bars
            bars = side.submit(lambda: self.long_bars)
            pool = self.pool
            bars.result()
        mine = self.long_bars.join(pool.select("security"), "security", "left_semi")
        rets = prices.clean_returns(mine, self.long_bars)
        return materialize(
            covariance.estimation_rows(rets, prices.calendar(self.long_bars), self.cov_p), "panel"
        )

    @cached_property
    def numbered_pool(self) -> DataFrame:
        return self.pool.select("pos", "security")

    @cached_property
    def factors(self) -> DataFrame:
        return materialize(
            covariance.risk_factors(self.panel_rows, self.numbered_pool, self.cov_p), "factors"
        )

    # --- forward record ----------------------------------------------------------------------

    def daily_rates(self, marks: DataFrame) -> DataFrame:
        """Daily rate per date of `marks`."""
        dates = marks.select("date").distinct()
        dated = rates.asof(dates, warehouse.later_yields(self.rf), self.p.risk_free)
        return dated.select("date", (F.col("rf_annual") / self.p.trading_days).alias("rf"))

    @cached_property
    def rf_daily(self) -> DataFrame:
        """Daily rate per logged date."""
        return self.daily_rates(self.marks)

    @cached_property
    def compared(self) -> DataFrame:
        """Arms against the baseline: arms x logged dates rows."""
        return materialize(forward.compared(self.marks, self.rf_daily, self.p), "compared")
