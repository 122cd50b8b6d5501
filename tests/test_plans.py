"""Shape of the physical plans."""

import pytest

from basketlab.plans.catalog import CATALOG
from basketlab.plans.screen import Screen

from conftest import SF

SAMPLE = [
    "trailing_returns", "calendar_grid", "rf_asof", "fundamental_ratios", "pct_rank_sector",
    "sector_pe_median", "portfolio_returns", "metrics_summary", "alpha_newey_west",
    "candidate_pairs", "cov_ewma", "score_candidate_selections", "selection_jaccard",
    "block_bootstrap_sharpe",
]


def plan_of(spark, name):
    df = CATALOG[name](Screen(spark, SF))
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for node in ("CartesianProduct", "NestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
        assert node not in plan, node


def test_scan_reads_only_what_it_needs(spark):
    plan = plan_of(spark, "liquidity_screen")
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert set(schema.replace("struct<", "").replace(">", "").split(",")) == {
        "l_suppkey:bigint", "l_quantity:double", "l_extendedprice:double", "l_shipdate:timestamp_ntz",
    }


def test_dates_reach_the_scan(spark, tmp_path):
    from basketlab.sources.bars import load_bars
    from basketlab.sources.schemas import BARS

    Screen(spark, SF).raw_bars.write.partitionBy("date").parquet(str(tmp_path / "bars"))
    bars = spark.read.schema(BARS).parquet(str(tmp_path / "bars"))
    plan = load_bars(bars, None, "2001-07-01", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan.split("PartitionFilters: [")[1][:80]


def test_trailing_returns_read_the_bars_once_for_anchors_and_once_for_values(spark):
    plan = plan_of(spark, "trailing_returns")
    assert "lineitem" not in plan and plan.count("Scan parquet") <= 4
