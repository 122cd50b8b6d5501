"""The forward record: competing arms compared on realised returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import draw, normal_cdf, ratio
from basketlab.operators.risk import newey_west_mean, with_drawdown
from basketlab.params import Params
from basketlab.sources.rates import mean_filled

# fixed values: arm registry, in display order
ARM_LABELS = {
    "greedy": "Classical (greedy score-weighting)",
    "qubo_classical": "QUBO, classical solver",
    "qubo_quantum": "QUBO, quantum annealer",
}


def arm_ordinal(c="arm") -> Column:
    """Place in the registry; an arm that isn't registered is an error."""
    order = F.array(*[F.lit(k) for k in ARM_LABELS])
    place = F.array_position(order, F.col(c))
    unknown = F.concat(F.lit("unknown arm "), F.coalesce(F.col(c), F.lit("null")))
    return F.when(place > 0, place).otherwise(F.raise_error(unknown).cast("bigint"))


def aligned_marks(marks: DataFrame) -> DataFrame:
    """Marks of the dates on which every arm ever seen reported a return."""
    arms = marks.agg(F.count_distinct("arm")).scalar()
    full = (
        marks.groupBy("date")
        .agg(F.count("ret").alias("have"))
        .where(F.col("have") == arms)
        .select("date")
    )
    return marks.join(full, "date", "left_semi")


def forward_nav(marks: DataFrame) -> DataFrame:
    """Growth of 1 per arm from its own first mark; null days are skipped."""
    run = Window.partitionBy("arm").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return marks.where(F.col("ret").isNotNull()).select(
        "date", "arm", F.product(1.0 + F.col("ret")).over(run).alias("nav")
    )


def nav_points(nav: DataFrame) -> DataFrame:
    """One record per date with a map of arm -> NAV (5 dp)."""
    return nav.groupBy("date").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("arm", F.round("nav", 5).alias("nav"))))
        ).alias("nav")
    )


def sparkline(nav: DataFrame, arm: str) -> DataFrame:
    """One arm's points with their ordinal among all logged dates."""
    dates = nav.select("date").distinct().agg(F.array_sort(F.collect_set("date"))).scalar()
    return nav.where(F.col("arm") == arm).select(
        (F.array_position(dates, F.col("date")) - 1).alias("i"), F.round("nav", 5).alias("v")
    )


def arm_pairs(arms: DataFrame) -> DataFrame:
    """Ordered pairs of the arms present, in registry order."""
    order = arms.select("arm").distinct().withColumn("ord", arm_ordinal())
    # an arm pairs with each later place of the registry, so the join is on equality
    later = order.select(
        F.col("arm").alias("arm_a"),
        F.explode(
            F.filter(
                F.sequence(F.lit(1), F.lit(len(ARM_LABELS))), lambda k: k > F.col("ord")
            )
        ).alias("ord"),
    )
    return (
        later.join(order.withColumnRenamed("arm", "arm_b"), "ord")
        .select("arm_a", "arm_b", F.concat("arm_a", F.lit("_vs_"), "arm_b").alias("pair"))
    )


def membership(selections: DataFrame) -> DataFrame:
    """(pair, security, in_a, in_b): every name of either side of a pair, once.

    Grows with pairs x names; nothing is paired with anything inside an arm.
    """
    pairs = arm_pairs(selections)
    # at most one row per pair of registered arms
    a = selections.join(
        F.broadcast(pairs), selections["arm"] == pairs["arm_a"]
    ).select("pair", "arm_a", "arm_b", "security", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = selections.join(
        F.broadcast(pairs), selections["arm"] == pairs["arm_b"]
    ).select("pair", "arm_a", "arm_b", "security", F.lit(0).alias("a"), F.lit(1).alias("b"))
    return (
        a.unionByName(b)
        .groupBy("pair", "arm_a", "arm_b", "security")
        .agg((F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b"))
    )


def jaccard(selections: DataFrame) -> DataFrame:
    a, b = F.col("in_a"), F.col("in_b")
    return (
        membership(selections)
        .groupBy("pair")
        .agg(
            F.round(
                ratio(F.count_if(a & b), F.count_if(a | b)), 4
            ).alias("jaccard"),
            F.count_if(a & b).alias("overlapCount"),
            F.count_if(a).alias("nA"),
            F.count_if(b).alias("nB"),
        )
    )


def selection_diff(selections: DataFrame) -> DataFrame:
    """(pair, side, security) of the names only one side holds."""
    return (
        membership(selections)
        .where(F.col("in_a") != F.col("in_b"))
        .select("pair", F.when(F.col("in_a"), "onlyA").otherwise("onlyB").alias("side"), "security")
    )


# --- statistics ------------------------------------------------------------------------

def moments(x: str, prefix: str) -> list[Column]:
    """Aggregates from which the Sharpe statistics of a column follow."""
    sd = F.stddev_samp(x)
    return [
        F.count(x).alias(f"{prefix}_n"),
        ratio(F.avg(x), F.when(sd != 0, sd)).alias(f"{prefix}_sr"),
        F.skewness(x).alias(f"{prefix}_g3"),
        (F.kurtosis(x) + 3.0).alias(f"{prefix}_g4"),
    ]


def prob_sharpe(prefix: str, min_n: int = 3) -> Column:
    """Probability that the true Sharpe ratio is positive, from the observed
    one, the sample length and its third and fourth moments (`moments`)."""
    n, sr = F.col(f"{prefix}_n"), F.col(f"{prefix}_sr")
    den = 1.0 - F.col(f"{prefix}_g3") * sr + (F.col(f"{prefix}_g4") - 1.0) / 4.0 * sr * sr
    z = sr * F.sqrt(n - 1) / F.sqrt(F.when(den > 0, den))
    return F.when((n >= min_n) & z.isNotNull(), normal_cdf(z))


def sharpe_excess(x: str, td: int) -> Column:
    sd = F.stddev_samp(x)
    return ratio(F.avg(x), F.when(sd != 0, sd)) * F.lit(float(td) ** 0.5)


def growth_annual(ret: str, td: int) -> Column:
    return F.pow(F.product(1.0 + F.col(ret)), F.lit(float(td)) / F.count(ret)) - 1.0


def forward_sortino(ret: str, rf: str, td: int) -> Column:
    """Null, not 0, when nothing fell below the target."""
    gap = F.col(ret) - F.col(rf)
    dev = F.sqrt(F.avg(F.when(gap < 0, gap * gap))) * F.lit(float(td) ** 0.5)
    return ratio(growth_annual(ret, td) - F.avg(rf) * td, F.when(dev != 0, dev))


def gated(stat: Column, n: Column, minimum: int) -> Column:
    return F.when(n >= minimum, stat)


def against_baseline(marks: DataFrame, p: Params) -> DataFrame:
    """(arm, date, ret, base, active) for every arm but the baseline."""
    aligned = aligned_marks(marks)
    base = aligned.where(F.col("arm") == p.baseline_arm).select(
        "date", F.col("ret").alias("base")
    )
    # one row per logged date
    return (
        aligned.where(F.col("arm") != p.baseline_arm)
        .join(F.broadcast(base), "date")
        .withColumn("active", F.col("ret") - F.col("base"))
    )


def with_both_drawdowns(rows: DataFrame, keys: list[str]) -> DataFrame:
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    base_curve = F.product(1.0 + F.col("base")).over(run)
    dropped = with_drawdown(rows, keys).withColumnRenamed("drawdown", "dd_arm")
    return (
        dropped.withColumn("_c", base_curve)
        .withColumn("dd_base", F.col("_c") / F.max("_c").over(run) - 1.0)
        .drop("_c", "curve", "peak", "underwater")
    )


def comparison_stats(rows: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """The gated panel per group of rows (ret, base, active, daily `rf`)."""
    td = p.trading_days
    year = float(td) ** 0.5
    prepared = (
        with_both_drawdowns(rows, keys)
        .withColumn("_xa", F.col("ret") - F.col("rf"))
        .withColumn("_xb", F.col("base") - F.col("rf"))
    )
    raw = prepared.groupBy(*keys).agg(
        F.count("ret").alias("nDays"),
        F.product(1.0 + F.col("active")).alias("_growth"),
        (F.avg("active") * td).alias("_ann"),
        (F.stddev_samp("active") * F.lit(year)).alias("_te"),
        *moments("_xa", "a"),
        *moments("_xb", "b"),
        F.min("dd_arm").alias("_dda"),
        F.min("dd_base").alias("_ddb"),
        growth_annual("ret", td).alias("_ga"),
        growth_annual("base", td).alias("_gb"),
        forward_sortino("ret", "rf", td).alias("_sa"),
        forward_sortino("base", "rf", td).alias("_sb"),
    )
    n = F.col("nDays")

    def nonzero(c: str) -> Column:
        return F.when(F.col(c) != 0, F.abs(F.col(c)))

    def annualised(stat: Column, digits: int, name: str) -> Column:
        return F.round(gated(stat, n, p.min_annualise_days), digits).alias(name)

    def late(stat: Column, digits: int, name: str) -> Column:
        return F.round(gated(stat, n, p.min_calmar_days), digits).alias(name)

    panel = raw.select(
        *keys,
        "nDays",
        F.round(F.col("_growth") - 1.0, 4).alias("activeReturnCumulative"),
        annualised(F.col("_ann"), 4, "activeReturnAnnualised"),
        annualised(F.col("_te"), 4, "trackingError"),
        annualised(ratio("_ann", nonzero("_te")), 3, "informationRatio"),
        annualised(F.col("a_sr") * year, 3, "sharpe_arm"),
        annualised(F.col("b_sr") * year, 3, "sharpe_baseline"),
        F.round("_dda", 4).alias("maxDrawdown_arm"),
        F.round("_ddb", 4).alias("maxDrawdown_baseline"),
        annualised(F.col("_sa"), 3, "sortino_arm"),
        annualised(F.col("_sb"), 3, "sortino_baseline"),
        late(ratio("_ga", nonzero("_dda")), 3, "calmar_arm"),
        late(ratio("_gb", nonzero("_ddb")), 3, "calmar_baseline"),
        annualised(prob_sharpe("a"), 3, "probSharpe_arm"),
        annualised(prob_sharpe("b"), 3, "probSharpe_baseline"),
    )
    hac = newey_west_mean(rows, keys, "active").select(
        *keys, F.round("t_stat", 3).alias("neweyWestT")
    )
    return panel.join(hac, keys)


def block_start(rep: Column, block: Column, starts: Column) -> Column:
    """Start of a resampled block: a hash of replicate and block, so draws are
    independent, a re-run task draws the same ones and SQL can repeat them."""
    return F.pmod(draw(rep, block, "block"), starts)


def block_bootstrap(rows: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """Moving-block bootstrap of Sharpe(ret) - Sharpe(base), both over `rf`.

    Replicates are rows: each expands to the row numbers of its blocks, joins
    the series, and folds back into three moments before any shuffle.
    """
    td = p.trading_days
    numbered = (
        rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1)
        .select(
            *keys, "_i", (F.col("ret") - F.col("rf")).alias("_xa"),
            (F.col("base") - F.col("rf")).alias("_xb"),
        )
    )
    observed = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (sharpe_excess("_xa", td) - sharpe_excess("_xb", td)).alias("observed"),
    )
    cube = F.round(F.pow(F.col("n"), F.lit(1.0 / 3.0))).cast("bigint")
    plan = (
        observed.where(F.col("n") >= p.min_bootstrap_days)
        .withColumn("block", F.greatest(F.lit(1).cast("bigint"), cube))
        .withColumn("blocks", F.ceil(F.col("n") / F.col("block")))
    )
    draws = (
        plan.select(*keys, "n", "block", "blocks", F.explode(F.sequence(F.lit(0), F.lit(p.n_boot - 1))).alias("rep"))
        .repartition(*keys, "rep")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
        .withColumn("start", block_start(F.col("rep"), F.col("b"), F.col("n") - F.col("block") + 1))
        .select(
            *keys, "rep", "n",
            (F.col("b") * F.col("block")).alias("at"), "start",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block") - 1)).alias("o"),
        )
        .where(F.col("at") + F.col("o") < F.col("n"))
        .select(*keys, "rep", (F.col("start") + F.col("o")).alias("_i"))
    )
    replicates = (
        draws.join(numbered, [*keys, "_i"])
        .groupBy(*keys, "rep")
        .agg((sharpe_excess("_xa", td) - sharpe_excess("_xb", td)).alias("diff"))
    )
    summary = replicates.groupBy(*keys).agg(
        F.percentile("diff", F.lit(0.025)).alias("ci_low"),
        F.percentile("diff", F.lit(0.975)).alias("ci_high"),
        F.least(
            F.avg(F.when(F.col("diff") <= 0, 1.0).otherwise(0.0)),
            F.avg(F.when(F.col("diff") >= 0, 1.0).otherwise(0.0)),
        ).alias("half_p"),
    )
    return observed.join(summary, keys, "left").select(
        *keys,
        "n",
        F.round(F.when(F.col("n") >= p.min_bootstrap_days, F.col("observed")), 4).alias("difference"),
        F.round("ci_low", 4).alias("ci_low"),
        F.round("ci_high", 4).alias("ci_high"),
        F.round(F.when(F.col("half_p").isNotNull(), F.least(F.lit(1.0), 2.0 * F.col("half_p"))), 4).alias("pValue"),
    )


def compared(marks: DataFrame, rf_daily: DataFrame, p: Params) -> DataFrame:
    """`against_baseline` with the daily rate of each date. `rf_daily` is
    (date, rf); a date it lacks takes its mean."""
    rows = against_baseline(marks, p)
    filled = mean_filled(rows.select("date").distinct(), rf_daily)
    # one row per logged date
    return rows.join(F.broadcast(filled), "date")


def forward_stats(rows: DataFrame, p: Params) -> DataFrame:
    """One row per arm other than the baseline, from `compared` rows."""
    boot = block_bootstrap(rows, ["arm"], p).drop("n")
    return (
        comparison_stats(rows, ["arm"], p)
        .join(boot, "arm")
        .withColumn("vsBaseline", F.lit(p.baseline_arm))
    )
