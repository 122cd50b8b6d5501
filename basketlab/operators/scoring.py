"""Factor percentiles, pillars, the composite, and the words about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import finite, half_even, ratio
from basketlab.functions.ranking import average_rank_pct, exact_median, value_ranks
from basketlab.params import Params

# fixed values: pillar -> factor -> which direction is good
FACTORS = {
    "health": {
        "returnOnEquity": "higher",
        "operatingMargin": "higher",
        "netMargin": "higher",
        "fcfMargin": "higher",
        "revenueGrowth": "higher",
        "debtToEquity": "lower",
    },
    "valuation": {"peRatio": "lower", "fcfYield": "higher"},
    "momentum": {"return6M": "higher", "return3M": "higher"},
}
SECTOR_NEUTRAL = ("health", "valuation")
UNIVERSE = "*"

# fixed values: label of each factor that can be named a strength
STRENGTH_LABELS = {
    "returnOnEquity": "Return on equity",
    "operatingMargin": "Operating margin",
    "netMargin": "Net margin",
    "fcfMargin": "Free-cash-flow margin (3-yr avg)",
    "revenueGrowth": "Revenue growth (3-yr CAGR)",
    "fcfYield": "FCF yield (3-yr avg FCF)",
}
STRONG_PCTL = 80.0


def positive_pe(c="peRatio") -> Column:
    """A P/E of zero or less means no earnings, not a low price."""
    pe = F.col(c)
    return F.when(pe > 0, pe)


def factor_rows(names: DataFrame, factors: dict = FACTORS) -> DataFrame:
    """Wide (security, sector, factor columns) -> long observations.

    One row per (security, factor), so all factors rank in one pass and adding
    a factor adds rows, not plan nodes.
    """
    entries = []
    for pillar, members in factors.items():
        for factor, direction in members.items():
            value = positive_pe() if factor == "peRatio" else F.col(factor)
            entries.append(
                F.struct(
                    F.lit(pillar).alias("pillar"),
                    F.lit(factor).alias("factor"),
                    F.lit(direction).alias("direction"),
                    F.lit(pillar in SECTOR_NEUTRAL).alias("neutral"),
                    finite(value).alias("value"),
                )
            )
    sector = F.coalesce("sector", F.lit("Unknown"))
    return names.select(
        "security", sector.alias("sector"), F.explode(F.array(*entries)).alias("f")
    ).select("security", "sector", "f.*")


def directed(pct: Column) -> Column:
    return F.when(F.col("direction") == "lower", 100.0 - pct).otherwise(pct)


def rank_universe(rows: DataFrame) -> DataFrame:
    """Average-tie percentile over all names, per factor.

    Missing values keep their row without a rank; they pass by the join, so a mostly
    empty factor does not pile its nulls onto one key.
    """
    known = rows.where(F.col("value").isNotNull())
    ranks = value_ranks(known, ["factor"], "value")
    ranked = (
        known.join(ranks, ["factor", "value"])
        .withColumn("pctl", directed(average_rank_pct()))
        .drop("ties", "below", "n")
    )
    missing = rows.where(F.col("value").isNull()).withColumn("pctl", F.lit(None).cast("double"))
    return ranked.unionByName(missing)


def rank_in_scope(rows: DataFrame, p: Params) -> DataFrame:
    """Percentile within sector, or over the universe for thin or unknown
    sectors and for factors that are not sector-neutral; `sectorRanked` says which.

    Each observation counts in both populations but is looked up only in the
    one that applies to it. A missing value keeps its row without a rank.
    """
    known = rows.where(F.col("value").isNotNull())
    sizes = (
        known.groupBy("factor", "sector")
        .agg(F.count(F.lit(1)).alias("peers"))
        .where(F.col("sector") != "Unknown")
    )
    # factors x sectors rows
    scoped = known.join(F.broadcast(sizes), ["factor", "sector"], "left").withColumn(
        "sectorRanked",
        F.col("neutral") & (F.coalesce("peers", F.lit(0)) >= p.sector_min_count),
    ).withColumn(
        "scope", F.when(F.col("sectorRanked"), F.col("sector")).otherwise(UNIVERSE)
    )
    populations = known.select(
        "factor", "value", F.explode(F.array(F.lit(UNIVERSE), F.col("sector"))).alias("scope")
    )
    ranks = value_ranks(populations, ["factor", "scope"], "value")
    ranked = scoped.join(ranks, ["factor", "scope", "value"]).withColumn(
        "pctl", directed(average_rank_pct())
    )
    missing = rows.where(F.col("value").isNull()).withColumns(
        {"pctl": F.lit(None).cast("double"), "sectorRanked": F.lit(False)}
    )
    shown = [
        "security", "sector", "pillar", "factor", "direction", "value", "pctl", "sectorRanked",
    ]
    return ranked.select(*shown).unionByName(missing.select(*shown))


def pillar_aggs(factors: dict = FACTORS) -> list[Column]:
    """Mean percentile shrunk to 50 by the share of factors that are missing."""
    out = []
    for pillar, members in factors.items():
        mine = F.when(F.col("pillar") == pillar, F.col("pctl"))
        coverage = F.count(mine) / F.lit(float(len(members)))
        out.append(
            F.coalesce(50.0 + (F.avg(mine) - 50.0) * coverage, F.lit(50.0)).alias(pillar)
        )
    return out


def pillar_scores(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("security").agg(*pillar_aggs())


def composite(p: Params) -> Column:
    return (
        p.weight_health * F.col("health")
        + p.weight_valuation * F.col("valuation")
        + p.weight_momentum * F.col("momentum")
    )


def score_universe(names: DataFrame, p: Params) -> DataFrame:
    """Scores, per-factor percentiles (1 dp) and scope flags, one row per name."""
    ranked = rank_in_scope(factor_rows(names), p)
    wide = []
    for pillar, members in FACTORS.items():
        for factor in members:
            mine = F.col("factor") == factor
            wide.append(
                half_even(F.max(F.when(mine, F.col("pctl"))), 1).alias(f"{factor}_pctl")
            )
            if pillar in SECTOR_NEUTRAL:
                wide.append(
                    F.coalesce(F.bool_or(mine & F.col("sectorRanked")), F.lit(False)).alias(f"{factor}_sectorRanked")
                )
    rows = ranked.groupBy("security").agg(*pillar_aggs(), *wide)
    # a name without a single factor lands on the neutral 50 everywhere
    rows = names.select("security").join(rows, "security", "left").fillna(
        50.0, list(FACTORS)
    )
    return rows.select(
        "security",
        half_even("health", 2).alias("healthScore"),
        half_even("valuation", 2).alias("valuationScore"),
        half_even("momentum", 2).alias("momentumScore"),
        half_even(composite(p), 2).alias("score"),
        *[c for c in rows.columns if c.endswith("_pctl") or c.endswith("_sectorRanked")],
    )


def sector_pe_median(names: DataFrame) -> DataFrame:
    """Median of the raw P/E per sector."""
    return exact_median(names, ["sector"], "peRatio", "pe_median")


def _fixed(c: Column, digits: int) -> Column:
    """Fixed decimals without thousands separators."""
    return half_even(c, digits).cast(f"decimal(38,{digits})").cast("string")


def strengths() -> Column:
    """Array of (pctl, text), strongest first, at most four."""
    found = []
    for factor, label in STRENGTH_LABELS.items():
        pctl, value = F.col(f"{factor}_pctl"), F.col(factor)
        scope = F.when(F.col(f"{factor}_sectorRanked"), "its sector").otherwise("the universe")
        share = F.greatest(F.lit(1), half_even(100.0 - pctl, 0).cast("int"))
        band = F.when(pctl >= 99.5, F.concat(F.lit("the highest in "), scope)).otherwise(
            F.concat(F.lit("top "), share.cast("string"), F.lit("% of "), scope)
        )
        text = F.concat(
            F.lit(f"{label} of "), _fixed(value * 100.0, 1), F.lit("% — "), band
        )
        found.append(
            F.when((pctl >= STRONG_PCTL) & value.isNotNull(), F.struct(pctl.alias("p"), text.alias("s")))
        )
    ordered = F.sort_array(F.array_compact(F.array(*found)), asc=False)
    return F.slice(ordered, 1, 4)


def relative_pe() -> Column:
    med = F.when(F.col("pe_median") > 0, F.col("pe_median"))
    return ratio("peRatio", med) - 1.0


# fixed values: the wording of reasons and flags, and their thresholds, below


def reasons() -> Column:
    debt = F.col("debtToEquity")
    low_debt = F.when(
        debt.isNotNull() & (F.col("debtToEquity_pctl") >= STRONG_PCTL),
        F.concat(F.lit("Low leverage — debt/equity of "), _fixed(debt, 2)),
    )
    rel = relative_pe()
    cheap = F.when(
        rel <= -0.15,
        F.concat(
            F.lit("Trades at a "), _fixed(F.abs(rel) * 100.0, 0),
            F.lit("% discount to its sector (P/E "), _fixed(F.col("peRatio"), 1),
            F.lit(" vs "), _fixed(F.col("pe_median"), 1), F.lit(" median)"),
        ),
    )
    found = F.concat(
        F.transform(strengths(), lambda e: e["s"]), F.array_compact(F.array(low_debt, cheap))
    )
    fallback = F.array(
        F.lit("Balanced profile — no single standout factor, ranks on consistency")
    )
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def risk_flags() -> Column:
    pe, debt, growth = F.col("peRatio"), F.col("debtToEquity"), F.col("revenueGrowth")
    return F.array_compact(
        F.array(
            F.when(
                relative_pe() >= 0.25,
                F.concat(
                    F.lit("Premium valuation — P/E "), _fixed(pe, 1),
                    F.lit(" vs sector median "), _fixed(F.col("pe_median"), 1),
                ),
            ),
            F.when(
                pe.isNull(),
                F.lit("No positive earnings (P/E not meaningful) — valuation rests on growth"),
            ),
            F.when(F.col("fcfMargin") < 0, F.lit("Currently free-cash-flow negative")),
            F.when(
                debt > 2.0, F.concat(F.lit("Elevated leverage — debt/equity "), _fixed(debt, 1))
            ),
            F.when(
                growth < 0,
                F.concat(
                    F.lit("Revenue declining — "), _fixed(F.abs(growth) * 100.0, 0),
                    F.lit("%/yr over ~3 years"),
                ),
            ),
        )
    )


def with_reasons(names: DataFrame, medians: DataFrame) -> DataFrame:
    # one row per sector
    joined = names.join(
        F.broadcast(medians.select("sector", "pe_median")), "sector", "left"
    )
    return joined.withColumn("reasons", reasons()).withColumn("flags", risk_flags())


def top_by_score(names: DataFrame, n: int) -> DataFrame:
    """The n best by rounded score, ties by security, numbered from 1.

    The ordering window runs over the n rows the top-n already cut, not over
    the universe.
    """
    order = [F.desc("score"), F.asc("security")]
    best = names.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def screen_funnel(securities: DataFrame, screened: DataFrame, names: DataFrame) -> DataFrame:
    """Universe, screened, scored, excluded and the count per reason, one row.

    `names` are the survivors with health data; the others are the last reason.
    """
    counts = screened.agg(
        *[
            F.count(F.when(F.col("reason") == r, 1)).alias(r)
            for r in ("insufficientHistory", "lowLiquidity", "lowPrice")
        ],
        F.count(F.when(F.col("reason").isNull(), 1)).alias("screened_count"),
    )
    row = counts.withColumn(
        "universe_size", securities.agg(F.count(F.lit(1))).scalar()
    ).withColumn("scored_count", names.agg(F.count(F.lit(1))).scalar())
    return row.select(
        "universe_size", "screened_count", "scored_count",
        (F.col("universe_size") - F.col("scored_count")).alias("excluded_count"),
        "insufficientHistory", "lowLiquidity", "lowPrice",
        F.lit(0).cast("bigint").alias("missingFundamentals"),
        (F.col("screened_count") - F.col("scored_count")).alias("noHealthData"),
    )
