"""A spread of queries against their SQL on the smallest tables; the whole
catalog is compared by `python -m checks.compare <dir>`."""

import pytest

from basketlab.plans.catalog import CATALOG
from basketlab.plans.screen import Screen
from checks.compare import compare, duck
from checks.duckdb_sql import oracles

from conftest import SF

SPREAD = [
    "bars_load", "rf_load", "facts_flatten", "calendar_grid", "trailing_returns", "fundamental_ratios",
    "pct_rank_sector", "screen_top_n", "capped_weights", "metrics_summary", "window_metrics",
    "selection_jaccard", "stream_log_upsert", "screen_funnel",
]


def test_every_query_has_sql():
    assert set(CATALOG) == set(oracles())


@pytest.mark.parametrize("name", SPREAD)
def test_against_sql(spark, name):
    def run(session, root):
        return CATALOG[name](Screen(session, root))

    assert compare(spark, duck(SF), run, oracles()[name], SF) == ""


def test_daily_refresh_keeps_ranks(screen):
    from basketlab.plans import daily

    stocks = screen.stocks
    fresh = {r.security: r for r in daily.refreshed_stocks(stocks, screen.bars, screen.p).collect()}
    for r in stocks.collect():
        assert fresh[r.security]["rank"] == r["rank"]
        assert fresh[r.security].price == pytest.approx(r.price)
        assert fresh[r.security].return6M == pytest.approx(r.return6M)
