"""The nested result documents of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlab.functions.exprs import ordered_list
from basketlab.operators import facts, forward, market, portfolio, prices, report, scoring
from basketlab.params import Params
from basketlab.plans.screen import Screen
from basketlab.sources import bars as bar_source
from basketlab.sources import forward_log
from basketlab.sources.scratch import materialize

_NUMBERS = [
    "price", "score", "healthScore", "valuationScore", "momentumScore", *facts.RATIOS,
    "return1W", "return1M", "return3M", "return6M", "return1Y", "fundWeight",
]
STOCK = (
    "STRUCT<rank: INT, ticker: STRING, name: STRING, sector: STRING, subIndustry: STRING, "
    + "".join(f"{n}: DOUBLE, " for n in _NUMBERS)
    + "reasons: ARRAY<STRING>, flags: ARRAY<STRING>>"
)
_WINDOW = (
    "STRUCT<annualReturn: DOUBLE, annualVolatility: DOUBLE, sharpeRatio: DOUBLE, "
    "sortinoRatio: DOUBLE, maximumDrawdown: DOUBLE, calmarRatio: DOUBLE, alpha: DOUBLE, "
    "beta: DOUBLE, benchmarkReturn: DOUBLE, alphaTStat: DOUBLE>"
)
FUND = (
    "STRUCT<name: STRING, constituents: BIGINT, weighting: STRING, benchmark: STRING, "
    "blended: STRUCT<pe: DOUBLE, fcfYield: DOUBLE, revenueGrowth: DOUBLE, "
    "returnOnEquity: DOUBLE, netMargin: DOUBLE>, "
    f"metrics3Y: {_WINDOW}, metrics5Y: {_WINDOW}, "
    "navSeries: ARRAY<STRUCT<date: STRING, fund: DOUBLE, benchmark: DOUBLE>>, "
    "sectorBreakdown: ARRAY<STRUCT<sector: STRING, weight: DOUBLE>>>"
)
DIAGNOSTICS = (
    "STRUCT<solver: STRING, isQuantum: BOOLEAN, numReads: INT, bestEnergy: DOUBLE, "
    "energyStd: DOUBLE, lambdas: MAP<STRING, DOUBLE>, targetSize: INT, weighting: STRING, "
    "weightingNote: STRING, weightLambdas: MAP<STRING, DOUBLE>, wSigmaWScore: DOUBLE, "
    "wSigmaW: DOUBLE, maxWeight: DOUBLE, namesAtCap: INT, effectiveN: DOUBLE>"
)
_STATS = "STRUCT<arm: STRING, vsBaseline: STRING, nDays: BIGINT, " + ", ".join(
    f"{c}: DOUBLE"
    for c in (
        "activeReturnCumulative", "activeReturnAnnualised", "trackingError", "informationRatio",
        "sharpe_arm", "sharpe_baseline", "maxDrawdown_arm", "maxDrawdown_baseline", "sortino_arm",
        "sortino_baseline", "calmar_arm", "calmar_baseline", "probSharpe_arm", "probSharpe_baseline",
        "neweyWestT", "difference", "ci_low", "ci_high", "pValue",
    )
) + ">"
RESEARCH = (
    "STRUCT<schemaVersion: INT, asOf: STRING, inceptionDate: STRING, baselineArm: STRING, "
    "armOrder: ARRAY<STRING>, "
    "arms: ARRAY<STRUCT<key: STRING, label: STRING, isQuantum: BOOLEAN, "
    f"selection: ARRAY<STRING>, weights: MAP<STRING, DOUBLE>, fund: {FUND}, diagnostics: {DIAGNOSTICS}>>, "
    "selectionComparison: ARRAY<STRUCT<pair: STRING, jaccard: DOUBLE, overlapCount: BIGINT, "
    "nA: BIGINT, nB: BIGINT, onlyA: ARRAY<STRING>, onlyB: ARRAY<STRING>>>, "
    f"forwardStats: ARRAY<{_STATS}>, "
    "forwardNav: ARRAY<STRUCT<date: STRING, nav: MAP<STRING, DOUBLE>>>>"
)
METHODOLOGY = (
    "STRUCT<weights: MAP<STRING, DOUBLE>, healthFactors: ARRAY<STRING>, "
    "valuationFactors: ARRAY<STRING>, momentumFactors: ARRAY<STRING>, "
    "sectorNeutral: STRUCT<pillars: ARRAY<STRING>, groupBy: STRING, minCount: INT, momentumScope: STRING>>"
)
SNAPSHOT = (
    "success BOOLEAN, date STRING, elapsed_seconds DOUBLE, backend_version STRING, "
    "run_type STRING, portfolio STRUCT<asOf: STRING, universeSize: BIGINT, "
    "screenedCount: BIGINT, scoredCount: BIGINT, excludedCount: BIGINT, "
    "exclusionReasons: MAP<STRING, BIGINT>, minHistoryYears: DOUBLE, "
    f"pricesAsOf: STRING, methodology: {METHODOLOGY}, stocks: ARRAY<{STOCK}>, fund: {FUND}, research: {RESEARCH}, "
    "marketConditions: STRUCT<date: STRING, vix: DOUBLE, sp500Return: DOUBLE, nasdaqReturn: DOUBLE, "
    "treasuryYield: DOUBLE, riskSentiment: STRING, volatilityLevel: STRING>>"
)

VERSION = "1.0.0"
# fixed values: what the document says about ranks
GROUPED_BY = "sector"
MOMENTUM_SCOPE = "universe-wide"
REASONS = (
    "insufficientHistory", "lowLiquidity", "lowPrice", "missingFundamentals", "noHealthData",
)


def methodology(p: Params) -> Column:
    """What the scores were made of."""
    weights = {"health": p.weight_health, "valuation": p.weight_valuation, "momentum": p.weight_momentum}

    def texts(items) -> Column:
        return F.array(*[F.lit(x) for x in items])

    return F.struct(
        F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]).alias("weights"),
        *[texts(members).alias(f"{pillar}Factors") for pillar, members in scoring.FACTORS.items()],
        F.struct(
            texts(scoring.SECTOR_NEUTRAL).alias("pillars"),
            F.lit(GROUPED_BY).alias("groupBy"),
            F.lit(p.sector_min_count).alias("minCount"),
            F.lit(MOMENTUM_SCOPE).alias("momentumScope"),
        ).alias("sectorNeutral"),
    )


def research_document(s: Screen) -> DataFrame:
    """The experiment's one-row record with every arm's fund inside."""
    funds = materialize(s.fund_records(), "funds")
    arm_rows = report.arm_records(s.selections_with_weights, funds, s.diagnostics)
    return report.research_block(
        materialize(arm_rows, "arm_rows"),
        forward.jaccard(s.selections),
        forward.selection_diff(s.selections),
        forward.forward_stats(s.compared, s.p),
        forward.nav_points(forward.forward_nav(s.marks)),
        s.marks,
        s.bars.agg(F.max("date")).scalar(),
        s.p,
    )


def conditions_of(conditions: DataFrame, date: Column) -> Column:
    dated = conditions.select(date.cast("string").alias("date"), *conditions.columns)
    return dated.select(F.struct(*dated.columns)).scalar()


def stock_rows(s: Screen, stocks: DataFrame) -> DataFrame:
    rows = scoring.with_reasons(stocks, s.medians)
    windows = [name for name, _ in s.p.return_windows]
    return rows.select(
        "rank",
        F.col("security").alias("ticker"),
        "name",
        "sector",
        F.col("sub_industry").alias("subIndustry"),
        "price", "score", "healthScore", "valuationScore", "momentumScore",
        *facts.RATIOS, *windows, "fundWeight", "reasons", "flags",
    )


#: what the log keeps of an arm's diagnostics: field -> how it is written
LOGGED = {
    "solver": "%s", "weighting": "%s", "weightingNote": "%s",
    "bestEnergy": "%.6f", "energyStd": "%.6f", "maxWeight": "%.5f", "effectiveN": "%.1f",
}


def rebalance(s: Screen) -> Column:
    """What a run selected, and how, by arm: a few rows."""
    names = s.arms.groupBy("portfolio").agg(F.array_sort(F.collect_list("security")).alias("names"))
    chosen = names.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("portfolio", "names"))))).scalar()
    told = [(F.lit(c), F.when(F.col(c).isNotNull(), F.format_string(how, c))) for c, how in LOGGED.items()]
    fields = F.create_map(*[x for pair in told for x in pair])
    said = s.diagnostics.select("arm", fields.alias("told"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", F.map_entries("told").alias("e")))))
    how = said.agg(entries.alias("how")).select(F.transform_values("how", lambda _, e: F.map_from_entries(e)))
    return F.struct(chosen.alias("selectionByArm"), how.scalar().alias("diagnosticsByArm"))


def weekly_record(s: Screen, run_seq: int) -> DataFrame:
    """The log record of a run that selected anew: the arms' last marks, and what was
    selected."""
    arms = s.arms.select("portfolio", "security", "weight")
    marks = portfolio.latest_marks(arms, prices.daily_returns(s.bars), s.bars)
    rows = marks.select("date", F.col("portfolio").alias("arm"), "ret")
    return forward_log.record(rows, "weekly", run_seq, rebalance=rebalance(s))


def screen_document(s: Screen, stocks: DataFrame) -> DataFrame:
    """The whole result as one row. Only top-n rows, arms and per-date series
    go in; the universe enters as counts."""
    rows = materialize(stock_rows(s, stocks), "stocks")
    listed = rows.agg(ordered_list("rank", F.struct(*rows.columns))).scalar()
    research = materialize(research_document(s), "research")
    funnel = scoring.screen_funnel(s.securities, s.screened, s.names)
    last = s.bars.agg(F.max("date")).scalar()
    newest = s.gauges.agg(F.max("date")).scalar()
    conditions = market.market_summary(
        market.gauge_changes(bar_source.load_gauges(s.gauges, newest)), s.p
    )
    fund = research.select(
        F.filter("arms", lambda a: a["key"] == s.p.baseline_arm)[0]["fund"]
    ).scalar()
    counts = [F.lit(r) for r in REASONS], [F.col(r) for r in REASONS]
    body = F.struct(
        last.cast("string").alias("asOf"),
        F.col("universe_size").alias("universeSize"),
        F.col("screened_count").alias("screenedCount"),
        F.col("scored_count").alias("scoredCount"),
        F.col("excluded_count").alias("excludedCount"),
        F.map_from_arrays(F.array(*counts[0]), F.array(*counts[1])).alias("exclusionReasons"),
        F.lit(s.p.min_history_years).alias("minHistoryYears"),
        last.cast("string").alias("pricesAsOf"),
        methodology(s.p).alias("methodology"),
        listed.alias("stocks"),
        fund.alias("fund"),
        research.select(F.struct(*research.columns)).scalar().alias("research"),
        conditions_of(conditions, newest).alias("marketConditions"),
    )
    return funnel.select(
        F.lit(True).alias("success"),
        last.cast("string").alias("date"),
        F.lit(None).cast("double").alias("elapsed_seconds"),
        F.lit(VERSION).alias("backend_version"),
        F.lit("weekly").alias("run_type"),
        body.alias("portfolio"),
    )
