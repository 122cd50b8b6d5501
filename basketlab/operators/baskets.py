"""Basket selection and weighting compared under one quadratic objective:
reward for score, penalty for covariance, for missing the target size and for
same-sector pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import draw, ratio
from basketlab.operators.covariance import pair_index, quadratic_form, variances
from basketlab.operators.portfolio import capped_weights, equal_weights
from basketlab.params import Params


# fixed values: the arms that follow from the objective, and what a fallback says
CLASSICAL, QUANTUM = "qubo_classical", "qubo_quantum"
NOT_COVERED = "selection not fully covered by covariance"
CAP_INFEASIBLE = "cap infeasible"
NONE_FEASIBLE = "no feasible scheme"
N_MIXED = 20


def candidate_pairs(pool: DataFrame) -> DataFrame:
    """All i < j of the numbered pool with a same-sector mark."""
    sector = pool.select("security", "sector")
    return (
        pair_index(pool.select("pos", "security"), diagonal=False)
        .join(sector.select(F.col("security").alias("security_i"), F.col("sector").alias("_si")), "security_i")
        .join(sector.select(F.col("security").alias("security_j"), F.col("sector").alias("_sj")), "security_j")
        .select("i", "j", "security_i", "security_j", (F.col("_si") == F.col("_sj")).alias("same_sector"))
    )


def objective_terms(cov: DataFrame, pool: DataFrame, p: Params, k: int) -> DataFrame:
    """(i, j, coef), i <= j, over the names that have a covariance."""
    biggest = cov.agg(F.max(F.abs("c"))).scalar()
    c = F.col("c") / F.when(biggest != 0, biggest).otherwise(1.0)
    info = pool.select("security", "sector", "score")
    left = info.select(
        F.col("security").alias("security_i"), F.col("sector").alias("_si"), F.col("score").alias("_sc")
    )
    right = info.select(F.col("security").alias("security_j"), F.col("sector").alias("_sj"))
    s = F.greatest(F.col("_sc"), F.lit(0.0)) / 100.0
    diagonal = -p.l1 * s + p.l2 * c + p.l3 * (1.0 - 2.0 * k)
    same = F.when(F.col("_si") == F.col("_sj"), p.l4).otherwise(0.0)
    off = 2.0 * p.l2 * c + 2.0 * p.l3 + same
    # the pool is a top-n cut
    return (
        cov.join(F.broadcast(left), "security_i")
        .join(F.broadcast(right), "security_j")
        .select(
            "i", "j", "security_i", "security_j",
            F.when(F.col("i") == F.col("j"), diagonal).otherwise(off).alias("coef"),
        )
    )


def candidate_baskets(pool: DataFrame, k: int, n_mixed: int = N_MIXED) -> DataFrame:
    """(basket, security): the k best, the best per sector, and repeatable
    random subsets of size k, all drawn from the bounded pool."""
    names = pool.select("security", "sector", "pos")
    best = names.where(F.col("pos") <= k).select(F.lit("top").alias("basket"), "security")
    sectors = names.select("sector").distinct().agg(F.count(F.lit(1))).scalar()
    per_sector = Window.partitionBy("sector").orderBy("pos")
    spread = (
        names.withColumn("_r", F.row_number().over(per_sector))
        .where(F.col("_r") <= F.ceil(F.lit(float(k)) / sectors))
        .select(F.lit("sector").alias("basket"), "security")
    )
    drawn = names.select(
        "security", "pos", F.explode(F.sequence(F.lit(1), F.lit(n_mixed))).alias("rep")
    )
    order = Window.partitionBy("rep").orderBy(draw(F.col("rep"), F.col("pos"), "basket"), "pos")
    subsets = (
        drawn.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= k)
        .select(F.concat(F.lit("mix"), F.col("rep").cast("string")).alias("basket"), "security")
    )
    return best.unionByName(spread).unionByName(subsets)


def basket_components(
    baskets: DataFrame, pool: DataFrame, factors: DataFrame, k: int
) -> DataFrame:
    """Per basket the four parts of the energy, before their multipliers.

    Neither risk nor the same-sector penalty expands pairs: risk is the
    variance of the summed vectors, and a sector with m names has m(m-1)/2.
    """
    var = variances(factors)
    biggest = var.agg(F.max("var")).scalar()
    scale = F.when(biggest != 0, biggest).otherwise(1.0)
    covered = baskets.join(var.select("security"), "security", "left_semi")
    info = pool.select("security", "sector", "score")
    # the pool is a top-n cut
    rows = covered.join(F.broadcast(info), "security")
    by_sector = rows.groupBy("basket", "sector").agg(
        F.count(F.lit(1)).alias("_m"),
        F.sum(F.greatest(F.col("score"), F.lit(0.0)) / 100.0).alias("_s"),
    )
    sums = by_sector.groupBy("basket").agg(
        F.sum("_m").alias("size"),
        F.sum("_s").alias("quality"),
        F.sum(F.col("_m") * (F.col("_m") - 1) / 2.0).alias("same_sector"),
    )
    risk = quadratic_form(covered.withColumn("weight", F.lit(1.0)), factors, "basket")
    m = F.col("size")
    return sums.join(risk, "basket").select(
        "basket",
        "size",
        "quality",
        (F.col("wCw") / scale).alias("risk"),
        (m * m - 2.0 * k * m).alias("size_term"),
        "same_sector",
    )


def energy(l1, l2, l3, l4) -> Column:
    return (
        -l1 * F.col("quality") + l2 * F.col("risk") + l3 * F.col("size_term")
        + l4 * F.col("same_sector")
    )


def score_baskets(components: DataFrame, p: Params) -> DataFrame:
    """Energy per basket, the spread over all baskets, and the lowest marked.

    The baskets are a handful of candidates, so one window holds them.
    """
    every = Window.partitionBy(F.lit(0))
    e = F.round("energy", 9)
    return (
        components.withColumn("energy", energy(p.l1, p.l2, p.l3, p.l4))
        .withColumn("energy_std", F.stddev_pop("energy").over(every))
        .withColumn("_first", F.row_number().over(every.orderBy(e, "basket")))
        .withColumn("is_best", F.col("_first") == 1)
        .drop("_first")
    )


def lambda_sweep(components: DataFrame, grid: list[tuple]) -> DataFrame:
    """The winning basket for each (l1, l2, l3, l4) of a grid. Components are
    computed once; each basket expands over the grid's literals."""
    points = F.array(
        *[
            F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("l1", "l2", "l3", "l4"), g)])
            for g in grid
        ]
    )
    return (
        components.withColumn("g", F.explode(points))
        .withColumn(
            "energy",
            F.round(energy(F.col("g.l1"), F.col("g.l2"), F.col("g.l3"), F.col("g.l4")), 9),
        )
        .groupBy("g.l1", "g.l2", "g.l3", "g.l4")
        .agg(
            F.min(F.struct("energy", "basket", "size")).alias("w"),
            F.stddev_pop("energy").alias("energy_std"),
        )
        .select("l1", "l2", "l3", "l4", "w.basket", "w.energy", "w.size", "energy_std")
    )


def arm_winners(components: DataFrame, p: Params) -> DataFrame:
    """(arm, basket, bestEnergy, energyStd, numReads): each arm takes the lowest energy of
    a candidate table of its own: the best names, the sector spread and the first half
    of the drawn baskets, or the other half. Ties go to the smaller name."""
    number = F.coalesce(F.regexp_extract("basket", r"^mix(\d+)$", 1).try_cast("int"), F.lit(0))
    scored = components.withColumn("energy", energy(p.l1, p.l2, p.l3, p.l4)).withColumn(
        "arm", F.when(number > N_MIXED // 2, QUANTUM).otherwise(CLASSICAL)
    )
    return (
        scored.groupBy("arm")
        .agg(
            F.min(F.struct(F.round("energy", 9).alias("e"), F.col("basket").alias("b"))).alias("w"),
            F.stddev_pop("energy").alias("energyStd"),
            F.count(F.lit(1)).alias("numReads"),
        )
        .select("arm", F.col("w.b").alias("basket"), F.col("w.e").alias("bestEnergy"), "energyStd", "numReads")
    )


def arm_selections(winners: DataFrame, candidates: DataFrame, pool: DataFrame, p: Params) -> DataFrame:
    """(arm, security, sector, score): the baseline's best names and each winner's."""
    best = candidates.where("basket = 'top'").select(F.lit(p.baseline_arm).alias("arm"), "security")
    # one winner an arm
    won = candidates.join(F.broadcast(winners.select("arm", "basket")), "basket").select("arm", "security")
    return best.unionByName(won).join(pool.select("security", "sector", "score"), "security")


def weight_schemes(selection: DataFrame, factors: DataFrame, p: Params) -> DataFrame:
    """(scheme, security, score, weight): score-capped, equal and inverse
    volatility weights of one selection (security, score), or of one an arm
    (arm, security, score), whose schemes are then named arm|scheme."""
    by_arm = "arm" in selection.columns
    rows = selection.select("security", "score", *(["arm"] if by_arm else []))
    vol = variances(factors).withColumn("inv_vol", ratio(F.lit(1.0), F.sqrt("var")))

    def tagged(df: DataFrame, name: str) -> DataFrame:
        label = F.concat_ws("|", "arm", F.lit(name)) if by_arm else F.lit(name)
        return df.withColumn("portfolio", label).drop("arm")

    by_score = capped_weights(tagged(rows, "score_capped"), p.max_weight)
    equal = equal_weights(tagged(rows, "equal"))
    # a name without a variance keeps its row, at weight 0
    by_vol = capped_weights(
        tagged(rows.join(vol.select("security", "inv_vol"), "security", "left"), "inverse_vol"),
        p.max_weight, score="inv_vol",
    ).drop("inv_vol")
    return by_score.unionByName(equal).unionByName(by_vol).withColumnRenamed("portfolio", "scheme")


def weight_report(schemes: DataFrame, factors: DataFrame, p: Params) -> DataFrame:
    """Per scheme: variance, largest weight, names at the cap, effective number
    of names, objective value, and whether the scheme can be used: the cap can be
    met and every name has a variance. Else the whole selection falls back to its
    score weights; no part of it is optimised alone."""
    biggest = variances(factors).agg(F.max("var")).scalar()
    scale = F.when(biggest != 0, biggest).otherwise(1.0)
    w, cap = F.col("weight"), p.max_weight
    known = schemes.join(variances(factors).select("security", F.lit(1).alias("_v")), "security", "left")
    sums = known.groupBy("scheme").agg(
        F.count(F.lit(1)).alias("names"),
        F.count("_v").alias("covered"),
        F.sum(w).alias("total"),
        F.max(w).alias("maxWeight"),
        F.count(F.when(w >= cap - 1e-9, 1)).alias("namesAtCap"),
        ratio(F.lit(1.0), F.sum(w * w)).alias("effectiveN"),
        F.sum(w * F.greatest(F.col("score"), F.lit(0.0)) / 100.0).alias("quality"),
    )
    form = quadratic_form(schemes, factors, "scheme")
    return sums.join(form, "scheme", "left").select(
        "*",
        (p.l2 * F.col("wCw") / scale - p.l1 * F.col("quality")).alias("objective"),
        (
            (F.col("names") * cap >= 1.0 - 1e-12)
            & (F.col("names") == F.col("covered"))
            & (F.abs(F.col("total") - 1.0) <= 1e-8)
            & (F.col("maxWeight") <= cap + 1e-9)
        ).alias("feasible"),
    )


def choose_weights(report: DataFrame) -> DataFrame:
    """One row: the feasible scheme with the lowest objective, or the score
    weights, said to be a fallback."""
    key = F.struct(F.round("objective", 9).alias("o"), F.col("scheme").alias("s"))
    pick = report.agg(
        F.min(F.when(F.col("feasible"), key)).alias("best"),
        F.max(F.when(F.col("scheme") == "score_capped", F.col("wCw"))).alias("wCwScore"),
        F.max(F.when(F.col("scheme") == "score_capped", F.col("objective"))).alias("scoreObjective"),
    )
    fell_back = F.col("best").isNull()
    return pick.select(
        F.coalesce("best.s", F.lit("score_capped")).alias("scheme"),
        F.when(fell_back, "score_fallback").otherwise("objective").alias("weighting"),
        F.coalesce("best.o", "scoreObjective").alias("objective"),
        "wCwScore",
    )


def choose_by_arm(report: DataFrame, p: Params) -> DataFrame:
    """One row per arm: the feasible scheme with the lowest objective, else the score
    weights and why, with what the chosen and the score weights come to."""
    named = F.split("scheme", r"\|")
    rows = report.withColumn("arm", named[0]).withColumn("scheme", named[1])
    key = F.struct(F.round("objective", 9).alias("o"), F.col("scheme").alias("s"))
    fields = ["wCw", "objective", "maxWeight", "namesAtCap", "effectiveN", "names", "covered"]
    # three schemes an arm
    picked = rows.groupBy("arm").agg(
        F.min(F.when(F.col("feasible"), key)).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("scheme", F.struct(*fields)))).alias("of"),
    )
    scheme = F.coalesce("best.s", F.lit("score_capped"))
    x, by_score = F.element_at("of", scheme), F.element_at("of", F.lit("score_capped"))
    note = (
        F.when(x["names"] > x["covered"], NOT_COVERED)
        .when(x["names"] * p.max_weight < 1.0 - 1e-12, CAP_INFEASIBLE)
        .otherwise(NONE_FEASIBLE)
    )
    fell_back = F.col("best").isNull()
    return picked.select(
        "arm",
        scheme.alias("scheme"),
        F.when(fell_back, "score_fallback").otherwise("objective").alias("weighting"),
        F.when(fell_back, note).alias("weightingNote"),
        by_score["wCw"].alias("wSigmaWScore"),
        F.when(~fell_back, x["wCw"]).alias("wSigmaW"),
        x["maxWeight"].alias("maxWeight"),
        F.when(~fell_back, x["namesAtCap"]).alias("namesAtCap"),
        x["effectiveN"].alias("effectiveN"),
    )


def arm_weights(selections: DataFrame, schemes: DataFrame, choice: DataFrame, p: Params) -> DataFrame:
    """(portfolio, security, sector, score, weight): score weights for the baseline, the
    chosen scheme's for every other arm."""
    used = F.when(F.col("arm") == p.baseline_arm, "score_capped").otherwise(F.col("scheme"))
    # one row an arm
    used = F.broadcast(choice.select(F.concat_ws("|", "arm", used).alias("scheme"), F.col("arm").alias("portfolio")))
    weights = schemes.join(used, "scheme").select("portfolio", "security", "weight")
    info = selections.select(F.col("arm").alias("portfolio"), "security", "sector", "score")
    return info.join(weights, ["portfolio", "security"])


def diagnostics(winners: DataFrame, choice: DataFrame, p: Params, k: int) -> DataFrame:
    """One typed row per arm: how its names were found and weighted; for the baseline,
    which neither searches nor optimises, only that."""
    own = F.col("arm") != p.baseline_arm

    def of(column: Column) -> Column:
        return F.when(own, column)

    lambdas = F.create_map(*[x for n in ("l1", "l2", "l3", "l4") for x in (F.lit(n), F.lit(float(getattr(p, n))))])
    weighing = F.create_map(*[x for n in ("l1", "l2") for x in (F.lit(n), F.lit(float(getattr(p, n))))])
    return choice.join(winners, "arm", "left").select(
        "arm",
        F.when(own, "candidates").otherwise("none").alias("solver"),
        (F.col("arm") == QUANTUM).alias("isQuantum"),
        F.col("numReads").cast("int").alias("numReads"),
        F.round("bestEnergy", 6).alias("bestEnergy"),
        F.round("energyStd", 6).alias("energyStd"),
        of(lambdas).alias("lambdas"),
        of(F.lit(k)).alias("targetSize"),
        of(F.col("weighting")).alias("weighting"),
        of(F.col("weightingNote")).alias("weightingNote"),
        of(weighing).alias("weightLambdas"),
        of(F.round("wSigmaWScore", 8)).alias("wSigmaWScore"),
        of(F.round("wSigmaW", 8)).alias("wSigmaW"),
        of(F.round("maxWeight", 5)).alias("maxWeight"),
        of(F.col("namesAtCap")).cast("int").alias("namesAtCap"),
        of(F.round("effectiveN", 1)).alias("effectiveN"),
    )
