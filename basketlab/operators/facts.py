"""Filing facts -> annual series -> ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import gated_growth, gated_margin, ratio

# fixed values: line item -> taxonomy concepts in order of preference
LINE_ITEMS = {
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet",
        "RevenuesNetOfInterestExpense",
        "InterestAndDividendIncomeOperating",
        "PremiumsEarnedNet",
    ],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "gross_profit": ["GrossProfit"],
    "cost_of_revenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"],
    "operating_income": ["OperatingIncomeLoss"],
    "equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "cfo": ["NetCashProvidedByUsedInOperatingActivities"],
    "capex": [
        "PaymentsToAcquirePropertyPlantAndEquipment",
        "PaymentsToAcquireProductiveAssets",
    ],
    "eps": ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"],
    "dps": ["CommonStockDividendsPerShareDeclared", "CommonStockDividendsPerShareCashPaid"],
    "lt_debt": ["LongTermDebtNoncurrent", "LongTermDebt"],
}
MERGED_BY_MAX = ("revenue", "capex")
INSTANT = ("equity", "lt_debt")
PER_SHARE = ("eps", "dps")
SHARES = "shares"
SHARES_CONCEPT = "EntityCommonStockSharesOutstanding"

# fixed values: days a fiscal year may span, and the growth anchor's distance
ANNUAL_MIN_DAYS, ANNUAL_MAX_DAYS = 330, 400
ANCHOR_DAYS = 1096

RATIOS = [
    "peRatio", "dividendYield", "grossMargin", "operatingMargin", "netMargin",
    "returnOnEquity", "fcfMargin", "fcfYield", "revenueGrowth", "debtToEquity",
    "marketCap",
]


def line_item_table(spark: SparkSession) -> DataFrame:
    """concept -> item, priority, unit, instant, merged (a couple of dozen rows).

    Share counts are listed too, so one pass over the facts serves every item;
    they come from any form (`annual` false).
    """
    rows = [
        ("us-gaap", c, item, i, "USD/shares" if item in PER_SHARE else "USD",
         item in INSTANT, item in MERGED_BY_MAX, True)
        for item, concepts in LINE_ITEMS.items()
        for i, c in enumerate(concepts)
    ]
    rows.append(("dei", SHARES_CONCEPT, SHARES, 0, "shares", True, True, False))
    return spark.createDataFrame(
        rows,
        "taxonomy STRING, concept STRING, item STRING, priority INT, unit STRING, "
        "instant BOOLEAN, merged BOOLEAN, annual BOOLEAN",
    )


def usable_facts(facts: DataFrame) -> DataFrame:
    """Facts of a known line item: annual filings, flow facts spanning a fiscal
    year; share counts of any form."""
    span = F.datediff("end", "start")
    items = F.broadcast(line_item_table(facts.sparkSession))
    is_annual = F.coalesce(F.col("form").startswith("10-K"), F.lit(False))
    return (
        facts.where(F.col("val").isNotNull() & F.col("end").isNotNull())
        .join(items, ["taxonomy", "concept", "unit"])
        .where(~F.col("annual") | is_annual)
        .where(F.col("instant") | span.between(ANNUAL_MIN_DAYS, ANNUAL_MAX_DAYS))
    )


def annual_filter(facts: DataFrame) -> DataFrame:
    return usable_facts(facts).where("annual")


def filing_order() -> Column:
    """Filing date, then `seq` (an integer below 10^33), as one number: a fixed
    width key keeps the aggregate on hash maps, where a struct would sort."""
    days = F.datediff(F.coalesce("filed", F.lit("1900-01-01").cast("date")), F.lit("1900-01-01").cast("date"))
    shift = F.lit("1" + "0" * 33).cast("decimal(34,0)")
    return (days.cast("decimal(5,0)") * shift).cast("decimal(38,0)") + F.col("seq").cast("decimal(33,0)")


def latest_filed(usable: DataFrame) -> DataFrame:
    """Per (entity, item, concept, end): the value filed last; among equal
    filing dates the later `seq`, and a missing filing date sorts first. Share
    counts take the largest value of an end date instead.

    Rows combine before the shuffle, so an entity with very many facts sends
    one row per cell and task.
    """
    last, largest = F.max_by("val", filing_order()), F.max("val")
    return usable.groupBy(
        "entity", "item", "concept", "priority", "merged", "annual", "end"
    ).agg(F.when(F.col("annual"), last).otherwise(largest).alias("val"))


def first_concept(values: DataFrame) -> DataFrame:
    """(entity, item, end, val): merged items take the largest concept per year;
    others use the first concept, in order of preference, with any data."""
    of_item = Window.partitionBy("entity", "item")
    return (
        values.withColumn("best", F.min("priority").over(of_item))
        .where("merged OR priority = best")
        .groupBy("entity", "item", "end")
        .agg(F.max("val").alias("val"))
    )


def concept_series(facts: DataFrame) -> DataFrame:
    return latest_filed(annual_filter(facts))


def annual_series(facts: DataFrame) -> DataFrame:
    return first_concept(concept_series(facts))


def years_wide(series: DataFrame) -> DataFrame:
    """One row per (entity, end) with every line item as a column."""
    return series.groupBy("entity", "end").agg(
        *[F.max(F.when(F.col("item") == i, F.col("val"))).alias(i) for i in (*LINE_ITEMS, SHARES)]
    )


def with_anchors(wide: DataFrame) -> DataFrame:
    """Adds the last revenue year, the number of revenue years and, for years
    that report both cash flow and capex, their rank from the latest (`fcf_rank`).
    Rows per entity are fiscal years, so these windows stay small."""
    entity = Window.partitionBy("entity")
    newest = entity.orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    has_rev = F.col("revenue").isNotNull()
    matched = F.col("cfo").isNotNull() & F.col("capex").isNotNull()
    return wide.select(
        "*",
        F.max(F.when(has_rev, F.col("end"))).over(entity).alias("rev_end"),
        F.count("revenue").over(entity).alias("rev_n"),
        F.when(matched, F.count(F.when(matched, 1)).over(newest)).alias("fcf_rank"),
    )


def latest(item: str) -> Column:
    known = F.when(F.col(item).isNotNull(), F.col("end"))
    return F.max_by(item, known)


def growth_anchor_aggs() -> list[Column]:
    """Last revenue and the earlier point nearest to three years before it."""
    earlier = F.col("revenue").isNotNull() & (F.col("end") < F.col("rev_end"))
    gap = F.abs(F.datediff("end", F.date_sub("rev_end", ANCHOR_DAYS)))
    nearest = F.min(F.when(earlier, F.struct(gap.alias("gap"), F.col("end"), F.col("revenue"))))
    return [
        F.max("rev_end").alias("rev_end"),
        F.max("rev_n").alias("rev_n"),
        latest("revenue").alias("rev_last"),
        nearest.alias("anchor"),
    ]


def cagr() -> Column:
    years = F.datediff("rev_end", "anchor.end") / 365.25
    valid = (
        (F.col("rev_n") >= 3) & (F.col("rev_last") > 0) & (F.col("anchor.revenue") > 0)
        & (years > 0)
    )
    growth = F.pow(F.col("rev_last") / F.col("anchor.revenue"), 1.0 / years) - 1.0
    return gated_growth(F.when(valid, growth))


def fcf_aggs() -> list[Column]:
    fcf = F.col("cfo") - F.col("capex")
    in_avg = F.col("fcf_rank") <= 3
    with_rev = in_avg & (F.col("revenue") > 0)
    return [
        F.avg(F.when(in_avg, fcf)).alias("avg_fcf"),
        F.avg(F.when(with_rev, fcf)).alias("margin_fcf"),
        F.avg(F.when(with_rev, F.col("revenue"))).alias("margin_rev"),
        F.count(F.when(in_avg, 1)).alias("fcf_years"),
    ]


def revenue_cagr(wide: DataFrame) -> DataFrame:
    return (
        with_anchors(wide)
        .groupBy("entity")
        .agg(*growth_anchor_aggs())
        .withColumn("revenueGrowth", cagr())
    )


def matched_fcf(wide: DataFrame) -> DataFrame:
    return (
        with_anchors(wide)
        .groupBy("entity")
        .agg(*fcf_aggs())
        .where("fcf_years > 0")
    )


def shares_outstanding(facts: DataFrame) -> DataFrame:
    """The largest share count of the latest date."""
    rows = latest_filed(usable_facts(facts).where("NOT annual"))
    return rows.groupBy("entity").agg(F.max_by("val", "end").alias("shares"))


def fundamental_items(facts: DataFrame) -> DataFrame:
    """Latest line items, growth anchor and matched cash flow, one row per entity."""
    items = [latest(i).alias(i) for i in (*LINE_ITEMS, SHARES) if i not in ("cfo", "capex")]
    wide = with_anchors(years_wide(first_concept(latest_filed(usable_facts(facts)))))
    return wide.groupBy("entity").agg(*items, *growth_anchor_aggs(), *fcf_aggs())


def fundamental_ratios(facts: DataFrame, prices: DataFrame) -> DataFrame:
    """Eleven ratios per security of `prices` (security, price, ...), whose other
    columns pass through; a security without filings keeps a row of nulls."""
    rows = prices.join(
        fundamental_items(facts).withColumnRenamed("entity", "security"), "security", "left"
    )
    c = F.col
    revenue = F.when(c("revenue") > 0, c("revenue"))
    gross = F.coalesce("gross_profit", revenue - c("cost_of_revenue"))
    equity = F.when(c("equity") > 0, c("equity"))
    eps = F.when(c("eps") > 0, c("eps"))
    implied = ratio(F.when(c("net_income") > 0, c("net_income")), eps)
    shares = F.coalesce(implied, F.when(c("shares") != 0, c("shares")))
    cap = c("price") * shares
    return rows.select(
        *prices.columns,
        ratio("price", eps).alias("peRatio"),
        ratio("dps", "price").alias("dividendYield"),
        gated_margin(gross, revenue).alias("grossMargin"),
        gated_margin("operating_income", revenue).alias("operatingMargin"),
        gated_margin("net_income", revenue).alias("netMargin"),
        ratio("net_income", equity).alias("returnOnEquity"),
        gated_margin("margin_fcf", "margin_rev").alias("fcfMargin"),
        ratio("avg_fcf", cap).alias("fcfYield"),
        cagr().alias("revenueGrowth"),
        ratio("lt_debt", equity).alias("debtToEquity"),
        cap.alias("marketCap"),
    )


HEALTH_FIELDS = [
    "returnOnEquity", "operatingMargin", "netMargin", "fcfMargin", "revenueGrowth",
    "debtToEquity",
]


def with_health_data(ratios: DataFrame) -> DataFrame:
    """Drops names that report none of the health factors."""
    return ratios.where(F.coalesce(*HEALTH_FIELDS).isNotNull())
