"""Read-side queries and nested result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import iso, ordered_list
from basketlab.operators.forward import ARM_LABELS, arm_ordinal
from basketlab.params import Params


# fixed values: how a fund says it is weighted
BY_SCORE = "score-weighted"
BY_OBJECTIVE = "objective-weighted"
BY_FALLBACK = "score-weighted (fallback)"


def holdings_detail(arms: DataFrame, stocks: DataFrame) -> DataFrame:
    """An arm's names with their published rows; `partial` where there is none."""
    published = stocks.withColumn("_hit", F.lit(True)).withColumnRenamed("fundWeight", "_fw")
    return (
        arms.withColumnRenamed("weight", "_aw")
        .join(published, "security", "left")
        .withColumn("partial", F.col("_hit").isNull())
        .withColumn("weight", F.coalesce("_aw", "_fw"))
        .drop("_hit", "_aw", "_fw")
    )


def holdings_query(
    detail: DataFrame, sector: str | None = None, text: str | None = None,
    sort: str = "weight", ascending: bool = False,
) -> DataFrame:
    """Sector filter, case-insensitive search on ticker or name, any sort
    column with nulls last either way."""
    out = detail
    if sector and sector != "All":
        out = out.where(F.col("sector") == sector)
    if text and text.strip():
        needle = text.strip().lower()
        out = out.where(
            F.lower("security").contains(needle)
            | F.coalesce(F.lower("name").contains(needle), F.lit(False))
        )
    key = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    return out.orderBy(key, "security")


def sector_options(detail: DataFrame) -> DataFrame:
    return detail.where(~F.col("partial")).select("sector").distinct().orderBy("sector")


def top_sectors(breakdown: DataFrame, n: int = 3) -> DataFrame:
    best = Window.partitionBy("portfolio").orderBy(F.desc("weight"), "sector")
    return breakdown.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def nav_overlay(nav: DataFrame, forward: DataFrame) -> DataFrame:
    """In-sample NAV of every portfolio and realised forward NAV on one date axis."""
    # portfolios: a few rows; a forward date stands beside each of them
    each = nav.select("portfolio").distinct()
    names = each.agg(F.array_sort(F.collect_set("portfolio")).alias("names")).scalar()
    ahead = forward.select("date", F.col("nav").alias("forward"), F.explode(names).alias("portfolio"))
    return nav.select("portfolio", "date", "fund", "benchmark").join(
        ahead, ["portfolio", "date"], "full_outer"
    )


def fund_records(
    weights: DataFrame, blended: DataFrame, windows: DataFrame, nav: DataFrame,
    sectors: DataFrame, p: Params, name: str, weighting: DataFrame,
) -> DataFrame:
    """One nested fund record per portfolio (`weighting`: portfolio, weighting). Every collected list is bounded:
    windows by the parameter, NAV by `nav_points`, sectors by their number."""
    key = "portfolio"
    fields = [c for c in windows.columns if c not in (key, "years")]
    metric = F.struct(*fields)
    metrics = windows.groupBy(key).agg(
        *[
            F.max(F.when(F.col("years") == y, metric)).alias(f"metrics{y}Y")
            for y in p.fund_windows
        ]
    )
    point = F.struct(
        iso("date").alias("date"),
        F.round("fund", 4).alias("fund"),
        F.round("benchmark", 4).alias("benchmark"),
    )
    points = nav.groupBy(key).agg(ordered_list("date", point).alias("navSeries"))
    heaviest = F.struct((-F.col("weight")).alias("w"), F.col("sector").alias("s"))
    by_sector = sectors.groupBy(key).agg(
        ordered_list(heaviest, F.struct("sector", "weight")).alias("sectorBreakdown")
    )
    blend = blended.select(
        key, F.struct("pe", "fcfYield", "revenueGrowth", "returnOnEquity", "netMargin").alias("blended")
    )
    return (
        weights.groupBy(key)
        .agg(F.count(F.lit(1)).alias("constituents"))
        .join(blend, key, "left")
        .join(metrics, key, "left")
        .join(points, key, "left")
        .join(by_sector, key, "left")
        .withColumn("name", F.lit(name))
        .join(weighting, key, "left")
        .withColumn("benchmark", F.lit(p.benchmark))
    )


def arm_records(arms: DataFrame, funds: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One nested record per arm with its selection, weights, fund and diagnostics."""
    entry = F.struct(F.col("security"), F.round("weight", 5).alias("weight"))
    label = F.create_map(*[F.lit(v) for kv in ARM_LABELS.items() for v in kv])
    packed = arms.groupBy("arm").agg(
        F.array_sort(F.collect_list("security")).alias("selection"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("weights"),
    )
    fund = funds.select(F.col("portfolio").alias("arm"), F.struct(*[c for c in funds.columns if c != "portfolio"]).alias("fund"))
    told = diagnostics.select("arm", F.struct(*[c for c in diagnostics.columns if c != "arm"]).alias("diagnostics"))
    return packed.join(fund, "arm", "left").join(told, "arm", "left").select(
        F.col("arm").alias("key"),
        F.element_at(label, F.col("arm")).alias("label"),
        (F.col("arm") == "qubo_quantum").alias("isQuantum"),
        "selection", "weights", "fund", "diagnostics",
    )


def research_block(
    arm_rows: DataFrame, overlaps: DataFrame, only: DataFrame, stats: DataFrame,
    points: DataFrame, marks: DataFrame, as_of: Column, p: Params,
) -> DataFrame:
    """The experiment's one-row record. All parts are bounded by the number of
    arms or of logged dates."""
    one = arm_rows.sparkSession.range(1).select(F.lit(1).alias("schemaVersion"))

    def listed(df: DataFrame, order: str) -> Column:
        return df.agg(ordered_list(order, F.struct(*df.columns))).scalar()

    sides = only.groupBy("pair").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("security")))).alias(s)
            for s in ("onlyA", "onlyB")
        ]
    )
    empty = F.array().cast("array<string>")
    compared = overlaps.join(sides, "pair", "left").withColumn(
        "onlyA", F.coalesce("onlyA", empty)
    ).withColumn("onlyB", F.coalesce("onlyB", empty))
    arms = arm_rows.agg(
        ordered_list(arm_ordinal("key"), F.struct(*arm_rows.columns))
    ).scalar()
    return one.select(
        "schemaVersion",
        as_of.cast("string").alias("asOf"),
        F.coalesce(marks.agg(F.min("date").cast("string")).scalar(), as_of.cast("string")).alias("inceptionDate"),
        F.lit(p.baseline_arm).alias("baselineArm"),
        F.array(*[F.lit(k) for k in ARM_LABELS]).alias("armOrder"),
        arms.alias("arms"),
        listed(compared, "pair").alias("selectionComparison"),
        listed(stats, "arm").alias("forwardStats"),
        listed(points.select(iso("date").alias("date"), "nav"), "date").alias("forwardNav"),
    )
