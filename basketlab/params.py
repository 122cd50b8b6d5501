"""Run parameters. Every operator takes what it needs from one `Params`."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Params:
    # fixed values: screening, weighting and estimation defaults
    top_n: int = 100
    pool_size: int = 150
    basket_size: int = 30  # names of a candidate basket, fewer than the pool at any scale
    min_history_years: float = 3.0
    weight_health: float = 0.70
    weight_valuation: float = 0.20
    weight_momentum: float = 0.10
    sector_min_count: int = 10
    max_weight: float = 0.04
    fund_windows: tuple = (3, 5)
    lookback_years: int = 3
    cov_method: str = "ewma"
    ewma_halflife: int = 63
    min_coverage: float = 0.6
    min_cov_obs: int = 60
    feed: str = "iex"
    min_avg_volume: float = 1_000_000
    min_avg_volume_iex: float = 25_000
    min_price: float = 5.0
    risk_free: float = 0.04
    vix_risk_on: float = 16.0
    vix_risk_off: float = 24.0
    trading_days: int = 252
    return_windows: tuple = (
        ("return1W", 5), ("return1M", 21), ("return3M", 63),
        ("return6M", 126), ("return1Y", 252),
    )
    nav_points: int = 180
    min_annualise_days: int = 20
    min_calmar_days: int = 60
    min_bootstrap_days: int = 10
    n_boot: int = 2000
    l1: float = 1.0
    l2: float = 1.0
    l3: float = 3.0
    l4: float = 0.1
    baseline_arm: str = "greedy"
    benchmark: str = "SPTM"

    def __post_init__(self):
        total = self.weight_health + self.weight_valuation + self.weight_momentum
        if abs(total - 1.0) > 1e-6:
            raise ValueError(f"pillar weights must sum to 1, got {total}")
        if not 0.0 < self.max_weight <= 1.0:
            raise ValueError("max_weight must be in (0, 1]")
        if self.cov_method not in ("ewma", "ledoit", "sample"):
            raise ValueError(f"unknown covariance method {self.cov_method!r}")

    @property
    def min_history_rows(self) -> int:
        return int(self.min_history_years * self.trading_days)

    @property
    def volume_floor(self) -> float:
        return self.min_avg_volume_iex if self.feed == "iex" else self.min_avg_volume

    @property
    def cov_window(self) -> int:
        return int(self.lookback_years * self.trading_days)

    def with_conf(self, spark: SparkSession) -> "Params":
        """Scalar fields overridden by session settings `basketlab.<field>`."""
        found = {}
        for f in fields(self):
            kind = type(getattr(self, f.name))
            text = spark.conf.get(f"basketlab.{f.name}", None)
            if text is not None and kind in (int, float, str):
                found[f.name] = kind(text)
        return replace(self, **found)


DAILY = Params()

# The supplied tables make one bar per week, so a year has 52 rows, and their
# prices and volumes need floors of their own to split the universe.
WEEKLY_BARS = Params(
    min_history_years=5.47,
    trading_days=52,
    return_windows=(
        ("return1W", 1), ("return1M", 4), ("return3M", 13),
        ("return6M", 26), ("return1Y", 52),
    ),
    min_avg_volume_iex=50.0,
    min_price=900.0,
)

# Covariance needs dates on which the whole pool has unfilled returns: its bars span
# `COVARIANCE_DAYS` days, twelve rows make a year.
COVARIANCE_DAYS = 30
COVARIANCE_YEARS = 7
COVARIANCE_ROWS = 12
