"""Canonical views over the supplied star-schema tables.

The tables hold no prices or filings, so each view is derived from them:
suppliers act as securities, shipped lines as trades and filing facts, orders
as yield prints, events as realised forward returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.sources.schemas import TABLES


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def securities(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    sector = F.when(F.col("n_regionkey") == 3, "Unknown").otherwise(F.col("r_name"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("security"),
            F.col("s_name").alias("name"),
            sector.alias("sector"),
            F.col("n_name").alias("sub_industry"),
            F.col("s_acctbal").alias("balance"),
        )
    )


def bars(lineitem: DataFrame, days: int | None = None) -> DataFrame:
    """Volume-weighted price and shares per supplier, weekly or per `days` days.

    A week has lines of few suppliers, so weekly bars leave no date on which a
    whole pool has returns; estimates that need such dates take longer bars.
    """
    shipped = F.to_date("l_shipdate")
    epoch = F.lit("1970-01-01").cast("date")
    period = (
        F.trunc(shipped, "week") if days is None
        else F.date_add(epoch, (F.floor(F.datediff(shipped, epoch) / days) * days).cast("int"))
    )
    return (
        lineitem.groupBy(F.col("l_suppkey").cast("string").alias("security"), period.alias("date"))
        .agg(
            F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


# fixed values: shipped line number -> the facts it stands for
# (line, taxonomy, concept, unit, instant, share of the line's price, when)
FACTS_OF_LINE = [
    (1, "us-gaap", "Revenues", "USD", False, 1.0, "always"),
    (2, "us-gaap", "SalesRevenueNet", "USD", False, 1.0, "always"),
    (3, "us-gaap", "NetIncomeLoss", "USD", False, 0.1, "always"),
    (3, "us-gaap", "EarningsPerShareDiluted", "USD/shares", False, 0.0001, "always"),
    (3, "us-gaap", "CommonStockDividendsPerShareDeclared", "USD/shares", False, 0.00002, "third"),
    (4, "us-gaap", "StockholdersEquity", "USD", True, 0.5, "always"),
    (4, "us-gaap", "LongTermDebt", "USD", True, 0.2, "odd"),
    (5, "us-gaap", "OperatingIncomeLoss", "USD", False, 0.2, "always"),
    (5, "us-gaap", "GrossProfit", "USD", False, 0.35, "third+1"),
    (5, "us-gaap", "CostOfRevenue", "USD", False, 0.6, "third+2"),
    (6, "us-gaap", "NetCashProvidedByUsedInOperatingActivities", "USD", False, 0.3, "always"),
    (7, "us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", "USD", False, 0.1, "to 1998"),
    (7, "us-gaap", "PaymentsToAcquireProductiveAssets", "USD", False, 0.1, "from 1998"),
    (7, "dei", "EntityCommonStockSharesOutstanding", "shares", True, 0.01, "always"),
]


def facts(lineitem: DataFrame) -> DataFrame:
    """Long filing facts, each shipped line standing for up to three of them.

    `seq` keeps the order of equal filing dates unique: order, line, part and
    quantity side by side in one decimal, which aggregates by hash where a
    struct would need a sort.
    """
    kinds = lineitem.sparkSession.createDataFrame(
        FACTS_OF_LINE,
        "line INT, taxonomy STRING, concept STRING, unit STRING, instant BOOLEAN, "
        "scale DOUBLE, kind STRING",
    )
    shipped = F.to_date("l_shipdate")
    year = F.year(shipped)
    end = F.make_date(year, F.lit(12), F.lit(31))
    applies = (
        F.when(F.col("kind") == "always", True)
        .when(F.col("kind") == "odd", F.col("l_suppkey") % 2 == 1)
        .when(F.col("kind") == "third", F.col("l_suppkey") % 3 == 0)
        .when(F.col("kind") == "third+1", F.col("l_suppkey") % 3 == 1)
        .when(F.col("kind") == "third+2", F.col("l_suppkey") % 3 == 2)
        .when(F.col("kind") == "to 1998", year < 1999)
        .otherwise(year >= 1998)
    )
    low = (
        F.col("l_linenumber").cast("bigint") * 10**14
        + F.col("l_partkey") * 100
        + F.col("l_quantity").cast("bigint")
    )
    seq = F.col("l_orderkey").cast("decimal(18,0)") * F.lit(10**15).cast("decimal(16,0)") + low.cast(
        "decimal(18,0)"
    )
    return (
        lineitem.join(F.broadcast(kinds), F.col("l_linenumber") == F.col("line"))
        .where(applies)
        .select(
            F.col("l_suppkey").cast("string").alias("entity"),
            "taxonomy",
            "concept",
            "unit",
            F.when(
                ~F.col("instant"),
                F.date_sub(end, (300 + 3 * F.col("l_quantity")).cast("int")),
            ).alias("start"),
            end.alias("end"),
            (F.col("l_extendedprice") * F.col("scale")).alias("val"),
            shipped.alias("filed"),
            F.when(F.col("l_linestatus") == "F", "10-K").otherwise("10-Q").alias("form"),
            seq.cast("decimal(33,0)").alias("seq"),
            F.col("l_orderkey").alias("filing"),
        )
    )


def yields(orders: DataFrame) -> DataFrame:
    """Annual yields by publication date."""
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.avg("o_totalprice") / 1e7).alias("rf_annual")
    )


def later_yields(rf: DataFrame) -> DataFrame:
    """The yields end before the events begin, so they are moved on by 25 years."""
    return rf.withColumn("date", F.add_months("date", 300))


# fixed values: event kind -> arm key; a kind not listed stands for the baseline
ARM_OF_EVENT = {
    "view": "greedy", "click": "qubo_classical", "purchase": "qubo_quantum",
    "signup": "qubo_classical", "error": "greedy",
}


def forward_marks(events: DataFrame) -> DataFrame:
    """Realised return per (date, arm), from every event."""
    date = F.to_date("ts")
    arm = None
    for kind, key in ARM_OF_EVENT.items():
        test = F.col("event_type") == kind
        arm = F.when(test, key) if arm is None else arm.when(test, key)
    return events.groupBy(date.alias("date"), arm.otherwise("greedy").alias("arm")).agg(
        ((F.avg("value") - 50.0) / 5000.0).alias("ret")
    )


def gauges(lineitem: DataFrame) -> DataFrame:
    """Index-like closes: one per return flag and week, plus a volatility level."""
    date = F.trunc(F.to_date("l_shipdate"), "week")
    name = (
        F.when(F.col("l_returnflag") == "A", "S&P 500")
        .when(F.col("l_returnflag") == "N", "Nasdaq Composite")
        .otherwise("VIX")
    )
    price = F.avg("l_extendedprice") / F.when(F.col("gauge") == "VIX", 2000.0).otherwise(10.0)
    return (
        lineitem.withColumn("gauge", name)
        .groupBy("gauge", date.alias("date"))
        .agg(price.alias("close"))
    )
