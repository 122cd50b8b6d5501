"""Covariance of a bounded pool of names over a bounded window.

Every estimator is written as c_ij = <a_i, a_j> + ridge * [i = j], where a_i is
the name's centred and weighted return vector. A pair is then one inner
product, and a portfolio's variance needs no pairs at all: it is the squared
length of sum_i w_i a_i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import dot, finite, ordered_list, ratio
from basketlab.operators.prices import coverage, tail_dates
from basketlab.params import Params


def complete_rows(returns: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the dates on which every one of `names` has a finite return."""
    n = names.agg(F.count(F.lit(1))).scalar()
    mine = returns.select("security", "date", finite("ret").alias("ret")).where(
        "ret IS NOT NULL"
    ).join(names.select("security"), "security", "left_semi")
    full = mine.groupBy("date").agg(F.count("ret").alias("have")).where(F.col("have") == n)
    return mine.join(full.select("date"), "date", "left_semi")


def estimation_rows(returns: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """Window, coverage filter and complete rows, in that order."""
    dates = tail_dates(calendar, p.cov_window)
    inside = returns.join(F.broadcast(dates), "date", "left_semi")
    kept = coverage(returns, dates, p).where("kept")
    return complete_rows(inside, kept)


def window_rows(rows: DataFrame, p: Params, method: str | None = None) -> DataFrame:
    """(date, k, n, w): the complete dates numbered from the oldest, their
    number, and the weight each date has in the mean.

    EWMA weights halve every `ewma_halflife` rows and sum to 1; their total is
    a geometric series. Bounded by the estimation window.
    """
    dates = rows.select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("d"))
    numbered_dates = dates.select(F.size("d").alias("n"), F.posexplode("d").alias("k", "date"))
    if (method or p.cov_method) == "ewma":
        q = 0.5 ** (1.0 / p.ewma_halflife)
        w = F.pow(F.lit(q), F.col("n") - 1 - F.col("k")) * (1.0 - q) / (1.0 - F.pow(F.lit(q), F.col("n")))
    else:
        w = 1.0 / F.col("n")
    return numbered_dates.select("date", "k", "n", w.alias("w"))


def vectors(rows: DataFrame, p: Params, method: str | None = None) -> DataFrame:
    """(security, k, n, v): one entry per name and complete date.

    Names or rows below the minimum give no vectors, since any estimate would
    be noise.
    """
    method = method or p.cov_method
    names = rows.select("security").distinct().agg(F.count(F.lit(1))).scalar()
    mean = F.sum(F.col("w") * F.col("ret")).over(Window.partitionBy("security"))
    scale = {
        "ewma": F.sqrt("w"),
        "ledoit": 1.0 / F.sqrt("n"),
        "sample": 1.0 / F.sqrt(F.col("n") - 1),
    }[method]
    # one row per date of the window
    return (
        rows.join(F.broadcast(window_rows(rows, p, method)), "date")
        .where((F.col("n") >= p.min_cov_obs) & (names >= 2))
        .withColumn("mu", mean)
        .select("security", "k", "n", (scale * (F.col("ret") - F.col("mu"))).alias("v"))
    )


def pair_index(pool: DataFrame, diagonal: bool = True) -> DataFrame:
    """(i, j, security_i, security_j) with i < j, or i <= j, over a numbered pool.

    The pool is a top-n cut, so the pairs are the N(N+1)/2 cells of a matrix
    whose size is a parameter; each name expands to its own later positions and
    meets the partner by equality.
    """
    n = pool.agg(F.max("pos")).scalar()
    first = F.col("pos") if diagonal else F.col("pos") + 1
    later = pool.select(
        F.col("pos").alias("i"),
        F.col("security").alias("security_i"),
        first.alias("_lo"),
    ).where(F.col("_lo") <= n)
    return (
        later.select("i", "security_i", F.explode(F.sequence(F.col("_lo"), n)).alias("j"))
        .join(pool.select(F.col("pos").alias("j"), F.col("security").alias("security_j")), "j")
        .select("i", "j", "security_i", "security_j")
    )


def pair_products(vecs: DataFrame, pool: DataFrame) -> DataFrame:
    """(i, j, security_i, security_j, c) for i <= j: a name's entries become one
    array as long as the window, so a pair is one row, not one per date."""
    arrays = vecs.groupBy("security").agg(ordered_list("k", "v").alias("a"))
    left = arrays.select(F.col("security").alias("security_i"), F.col("a").alias("_ai"))
    right = arrays.select(F.col("security").alias("security_j"), F.col("a").alias("_aj"))
    return (
        pair_index(pool)
        .join(left, "security_i")
        .join(right, "security_j")
        .select("i", "j", "security_i", "security_j", dot("_ai", "_aj").alias("c"))
    )


def shrinkage(vecs: DataFrame, pool: DataFrame) -> DataFrame:
    """Ledoit-Wolf intensity and target from `ledoit` vectors: one row
    (delta, mu, p, n). Uses three aggregates: squared entries, the trace, and
    the fourth moments of the rows."""
    pairs = pair_products(vecs, pool).agg(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("c") * F.col("c"))
              .otherwise(2.0 * F.col("c") * F.col("c"))).alias("norm2"),
        F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("trace"),
    )
    per_row = (
        vecs.groupBy("k")
        .agg(F.sum(F.col("v") * F.col("v")).alias("q"), F.first("n").alias("n"))
        .agg(
            # vectors carry 1/sqrt(n), so q * n is the row's squared length
            F.sum(F.pow(F.col("q") * F.col("n"), F.lit(2.0))).alias("fourth"),
            F.first("n").alias("n"),
        )
    )
    size = vecs.agg(F.count_distinct("security").alias("p"))
    row = (
        pairs.withColumn("p", size.scalar())
        .withColumn("n", per_row.select("n").scalar())
        .withColumn("fourth", per_row.select("fourth").scalar())
        .withColumn("mu", F.col("trace") / F.col("p"))
    )
    beta = (F.col("fourth") / F.col("n") - F.col("norm2")) / (F.col("p") * F.col("n"))
    spread = (
        F.col("norm2") - 2.0 * F.col("mu") * F.col("trace") + F.col("p") * F.col("mu") * F.col("mu")
    ) / F.col("p")
    return (
        row.withColumn("_b", F.least(beta, spread))
        .withColumn("_d", spread)
        .select(
            F.when(F.col("_b") == 0, 0.0).otherwise(ratio("_b", "_d")).alias("delta"),
            "mu", "p", "n",
        )
    )


def covariance(rows: DataFrame, pool: DataFrame, p: Params, method: str | None = None) -> DataFrame:
    """(i, j, security_i, security_j, c) for i <= j by the chosen estimator.

    `pool` is numbered; names without a vector drop out.
    """
    method = method or p.cov_method
    vecs = vectors(rows, p, method)
    pairs = pair_products(vecs, pool)
    if method != "ledoit":
        return pairs
    shrunk = shrinkage(vecs, pool)
    delta, mu = shrunk.select("delta").scalar(), shrunk.select("mu").scalar()
    c = (1.0 - delta) * F.col("c") + F.when(F.col("i") == F.col("j"), delta * mu).otherwise(0.0)
    return pairs.withColumn("c", c)


def risk_factors(rows: DataFrame, pool: DataFrame, p: Params) -> DataFrame:
    """(security, k, v, ridge): the vectors, with the diagonal addition that a
    shrunk estimate carries."""
    vecs = vectors(rows, p)
    if p.cov_method == "ledoit":
        shrunk = shrinkage(vecs, pool)
        keep = F.sqrt(1.0 - shrunk.select("delta").scalar())
        ridge = shrunk.select(F.col("delta") * F.col("mu")).scalar()
    else:
        keep, ridge = F.lit(1.0), F.lit(0.0)
    return vecs.select(
        "security", "k", (F.col("v") * keep).alias("v"), ridge.alias("ridge")
    )


def variances(factors: DataFrame) -> DataFrame:
    """Diagonal of the matrix: (security, var)."""
    return factors.groupBy("security").agg(
        (F.sum(F.col("v") * F.col("v")) + F.max("ridge")).alias("var")
    )


def quadratic_form(weights: DataFrame, factors: DataFrame, key: str) -> DataFrame:
    """w' C w per group of `weights` (key, security, weight), without pairs."""
    per_row = (
        weights.select(key, "security", "weight")
        .join(factors, "security")
        .groupBy(key, "k")
        .agg(F.sum(F.col("weight") * F.col("v")).alias("s"), F.max("ridge").alias("ridge"))
    )
    squares = weights.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("_w2"))
    return (
        per_row.groupBy(key)
        .agg(F.sum(F.col("s") * F.col("s")).alias("_q"), F.max("ridge").alias("ridge"))
        .join(squares, key)
        .select(key, (F.col("_q") + F.col("ridge") * F.col("_w2")).alias("wCw"))
    )
