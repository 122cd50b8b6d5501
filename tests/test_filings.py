"""Exact-value cases of the filing rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketlab.functions.exprs import gated_growth, gated_margin
from basketlab.operators import facts as f
from basketlab.operators.scoring import positive_pe
from basketlab.sources.filings import flatten_filings, nest_facts, read_filings

SCHEMA = (
    "entity STRING, taxonomy STRING, concept STRING, unit STRING, start DATE, `end` DATE, "
    "val DOUBLE, filed DATE, form STRING, seq INT"
)


def d(text):
    return dt.date.fromisoformat(text) if text else None


def fact(concept, start, end, val, filed, form="10-K", unit="USD", taxonomy="us-gaap", entity="E", seq=0):
    return (entity, taxonomy, concept, unit, d(start), d(end), float(val), d(filed), form, seq)


def year(concept, y, val, unit="USD", **kw):
    return fact(concept, f"{y - 1}-12-31", f"{y}-12-31", val, f"{y + 1}-02-15", unit=unit, **kw)


def series(spark, rows, item):
    df = f.annual_series(spark.createDataFrame(rows, SCHEMA)).where(f"item = '{item}'")
    return {str(r.end): r.val for r in df.collect()}


def test_quarter_stub_on_the_year_end_is_left_out(spark):
    rows = [
        fact("NetIncomeLoss", "2023-01-01", "2023-12-31", 100, "2024-02-01"),
        fact("NetIncomeLoss", "2023-10-01", "2023-12-31", 30, "2024-03-01", seq=1),
    ]
    assert series(spark, rows, "net_income") == {"2023-12-31": 100.0}


def test_restatement_wins_and_ties_go_to_the_later_row(spark):
    rows = [
        fact("NetIncomeLoss", "2023-01-01", "2023-12-31", 110, "2025-02-01", seq=0),
        fact("NetIncomeLoss", "2023-01-01", "2023-12-31", 100, "2024-02-01", seq=1),
        fact("NetIncomeLoss", "2022-01-01", "2022-12-31", 5, "2023-02-01", seq=2),
        fact("NetIncomeLoss", "2022-01-01", "2022-12-31", 4, "2023-02-01", seq=3),
        fact("NetIncomeLoss", "2021-01-01", "2021-12-31", 7, None, seq=9),
        fact("NetIncomeLoss", "2021-01-01", "2021-12-31", 8, "2022-02-01", seq=4),
    ]
    assert series(spark, rows, "net_income") == {
        "2023-12-31": 110.0, "2022-12-31": 4.0, "2021-12-31": 8.0,
    }


def test_long_fiscal_year_and_quarterly_form(spark):
    rows = [
        fact("OperatingIncomeLoss", "2022-12-31", "2024-01-06", 50, "2024-02-01"),
        fact("OperatingIncomeLoss", "2021-12-31", "2022-12-31", 40, "2023-02-01", form="10-Q"),
        fact("OperatingIncomeLoss", "2020-12-31", "2021-12-31", 30, "2022-02-01", form="10-K/A"),
    ]
    assert series(spark, rows, "operating_income") == {"2024-01-06": 50.0, "2021-12-31": 30.0}


def test_broadest_top_line_but_first_concept_elsewhere(spark):
    rows = [
        year("Revenues", 2023, 2), year("RevenuesNetOfInterestExpense", 2023, 25),
        year("NetIncomeLoss", 2022, 1), year("ProfitLoss", 2023, 9),
    ]
    assert series(spark, rows, "revenue") == {"2023-12-31": 25.0}
    assert series(spark, rows, "net_income") == {"2022-12-31": 1.0}


def test_instant_facts_need_no_span(spark):
    rows = [fact("StockholdersEquity", None, "2023-12-31", 70, "2024-02-01")]
    assert series(spark, rows, "equity") == {"2023-12-31": 70.0}


def growth(spark, rows):
    wide = f.years_wide(f.annual_series(spark.createDataFrame(rows, SCHEMA)))
    return f.revenue_cagr(wide).first().revenueGrowth


def test_growth_uses_elapsed_time(spark):
    rows = [year("Revenues", y, v) for y, v in ((2020, 100), (2021, 120), (2022, 90), (2023, 133.1))]
    days = (dt.date(2023, 12, 31) - dt.date(2020, 12, 31)).days
    assert growth(spark, rows) == pytest.approx(1.331 ** (365.25 / days) - 1, rel=1e-12)


def test_growth_with_a_gap_takes_the_nearest_earlier_year(spark):
    rows = [year("Revenues", y, v) for y, v in ((2017, 50), (2019, 80), (2023, 160))]
    days = (dt.date(2023, 12, 31) - dt.date(2019, 12, 31)).days
    assert growth(spark, rows) == pytest.approx(2 ** (365.25 / days) - 1, rel=1e-12)


def test_growth_needs_three_points_and_plausible_values(spark):
    assert growth(spark, [year("Revenues", 2022, 1), year("Revenues", 2023, 2)]) is None
    rows = [year("Revenues", y, v) for y, v in ((2021, 1), (2022, 50), (2023, 5000))]
    assert growth(spark, rows) is None
    rows = [year("Revenues", y, v) for y, v in ((2021, -1), (2022, 5), (2023, 5))]
    assert growth(spark, rows) is None


def test_gates_drop_what_is_not_plausible(spark):
    rows = [(12.0, 1.0, 10.0), (-3.0, 1.005, 10.01), (0.0, 1.01, None), (None, -2.0, -0.5)]
    df = spark.createDataFrame(rows, "peRatio DOUBLE, income DOUBLE, growth DOUBLE")
    got = df.select(positive_pe(), gated_margin("income", F.lit(1.0)), gated_growth("growth")).collect()
    assert [tuple(r) for r in got] == [(12.0, 1.0, 10.0), (None, 1.005, None), (None, None, None), (None, -2.0, -0.5)]
    assert df.select(gated_margin("income", F.lit(0.0)).alias("m")).where("m IS NOT NULL").isEmpty()


def test_matched_cash_flow_and_tag_switch(spark):
    old, new = "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"
    cfo = "NetCashProvidedByUsedInOperatingActivities"
    rows = [year(cfo, y, v) for y, v in ((2019, 9), (2020, 10), (2021, 20), (2022, 30), (2023, 40))]
    rows += [year(old, 2019, 1), year(old, 2020, 2), year(new, 2021, 5), year(new, 2023, 10)]
    rows += [year("Revenues", 2021, 100), year("Revenues", 2023, 200)]
    r = f.matched_fcf(f.years_wide(f.annual_series(spark.createDataFrame(rows, SCHEMA)))).first()
    assert (r.avg_fcf, r.fcf_years) == (pytest.approx((8 + 15 + 30) / 3), 3)
    assert (r.margin_fcf, r.margin_rev) == (22.5, 150.0)


def test_all_ratios(spark):
    rows = [year("Revenues", y, 1000 + 100 * (y - 2020)) for y in (2020, 2021, 2022, 2023)]
    rows += [
        year("NetIncomeLoss", 2023, 130), year("OperatingIncomeLoss", 2023, 2000),
        year("CostOfRevenue", 2023, 650), year("EarningsPerShareDiluted", 2023, 2.6, unit="USD/shares"),
        year("CommonStockDividendsPerShareDeclared", 2023, 1.3, unit="USD/shares"),
        fact("StockholdersEquity", None, "2023-12-31", 520, "2024-02-01"),
        fact("LongTermDebtNoncurrent", None, "2023-12-31", 260, "2024-02-01"),
        fact("EntityCommonStockSharesOutstanding", None, "2024-01-31", 45, "2024-02-01", unit="shares", taxonomy="dei", form="10-Q"),
        year("NetCashProvidedByUsedInOperatingActivities", 2023, 200),
        year("PaymentsToAcquireProductiveAssets", 2023, 70),
    ]
    prices = spark.createDataFrame([("E", 52.0), ("none", 10.0)], "security STRING, price DOUBLE")
    got = {r.security: r for r in f.fundamental_ratios(spark.createDataFrame(rows, SCHEMA), prices).collect()}
    r = got["E"]
    assert r.peRatio == pytest.approx(20) and r.dividendYield == pytest.approx(0.025)
    assert r.grossMargin == pytest.approx(0.5) and r.netMargin == pytest.approx(0.1)
    assert r.operatingMargin is None  # above 100 %: a data fault
    assert r.returnOnEquity == pytest.approx(0.25) and r.debtToEquity == pytest.approx(0.5)
    assert r.marketCap == pytest.approx(52 * 50) and r.fcfYield == pytest.approx(130 / 2600)
    assert r.fcfMargin == pytest.approx(0.1)
    assert all(got["none"][k] is None for k in f.RATIOS)


def test_reported_shares_and_negative_equity(spark):
    rows = [
        year("EarningsPerShareDiluted", 2023, -1, unit="USD/shares"), year("NetIncomeLoss", 2023, -5),
        fact("StockholdersEquity", None, "2023-12-31", -9, "2024-02-01"),
        fact("EntityCommonStockSharesOutstanding", None, "2024-01-31", 7, "2024-02-01", unit="shares", taxonomy="dei"),
        fact("EntityCommonStockSharesOutstanding", None, "2024-01-31", 8, "2023-02-01", unit="shares", taxonomy="dei"),
    ]
    prices = spark.createDataFrame([("E", 10.0)], "security STRING, price DOUBLE")
    r = f.fundamental_ratios(spark.createDataFrame(rows, SCHEMA), prices).first()
    assert r.peRatio is None and r.returnOnEquity is None and r.marketCap == 80.0


def test_nested_document(spark, tmp_path):
    doc = (
        '{"cik": "7", "facts": {"us-gaap": {"Revenues": {"units": {"USD": ['
        '{"start": "2022-01-01", "end": "2022-12-31", "val": 5, "filed": "2023-02-01", "form": "10-K"},'
        '{"start": "x", "end": "2023-12-31", "val": 6, "form": "10-K"}]}}},'
        '"dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [{"end": "2023-01-31", "val": 3}]}}}}}'
    )
    (tmp_path / "a.json").write_text(doc + "\n")
    rows = flatten_filings(read_filings(spark, str(tmp_path))).orderBy("taxonomy", "seq").collect()
    assert [(r.concept, r.seq, r.val) for r in rows] == [
        ("EntityCommonStockSharesOutstanding", 0, 3.0), ("Revenues", 0, 5.0), ("Revenues", 1, 6.0),
    ]
    assert rows[2].start is None and rows[2].filed is None


def test_nesting_shuffles_the_facts_once(screen):
    nested = nest_facts(screen.facts, ["filing"])
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert nested.count() == screen.facts.select("entity", "filing").distinct().count()
