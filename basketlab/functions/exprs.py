"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value, or null when it is NaN or infinite."""
    c = col(c).cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def clip(c, low: float, high: float) -> Column:
    """Bounded value; null stays null (greatest and least skip nulls)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def ratio(num, den) -> Column:
    """Division that gives null for a missing operand or a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


# fixed values: gates on implausible ratios
MARGIN_CAP = 1.005
GROWTH_CAP = 10.0


def gated_margin(num, den) -> Column:
    m = ratio(num, den)
    return F.when(m <= MARGIN_CAP, m)


def gated_growth(c) -> Column:
    c = col(c)
    return F.when(c <= GROWTH_CAP, c)


def half_even(c, digits: int) -> Column:
    """Banker's rounding; the inner round absorbs summation-order noise first."""
    return F.bround(F.round(col(c), digits + 6), digits)


def iso(c) -> Column:
    return col(c).cast("date").cast("string")


def newey_west_lags(n, minimum: int = 0) -> Column:
    lags = F.floor(4.0 * F.pow(col(n) / 100.0, F.lit(2.0 / 9.0))).cast("int")
    return F.greatest(F.lit(minimum), lags)


def normal_cdf(x) -> Column:
    """Abramowitz and Stegun 7.1.26 through erf; absolute error below 1.5e-7."""
    # fixed values: published coefficients
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(col(x)) / math.sqrt(2.0)
    t = 1.0 / (1.0 + p * z)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(col(x) >= 0, (1.0 + erf) / 2.0).otherwise((1.0 - erf) / 2.0)


def dot(a, b) -> Column:
    """Inner product of two equally long double arrays."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v
    )


def lagged_dot(values, n, k) -> Column:
    """Sum of x[t] * x[t-k] over an array of n doubles."""
    values, m = col(values), F.greatest(col(n) - k, F.lit(0))
    return dot(F.slice(values, k + 1, m), F.slice(values, 1, m))


def bartlett_sum(values, n, lags) -> Column:
    """Long-run sum: lag 0 once, then every lag twice with Bartlett weights."""
    lags = col(lags)

    def term(acc, k):
        weight = F.when(k == 0, 1.0).otherwise(2.0 * (1.0 - k / (lags + 1.0)))
        return acc + weight * lagged_dot(values, n, k)

    return F.aggregate(F.sequence(F.lit(0), lags), F.lit(0.0), term)


def ordered_list(order, body) -> Column:
    """Aggregate: `body` values as an array in `order`. Only for groups whose
    size is bounded, such as one value per trading date."""
    pairs = F.collect_list(F.struct(col(order).alias("o"), col(body).alias("b")))
    by_order = F.array_sort(
        pairs,
        lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0),
    )
    return F.transform(by_order, lambda e: e["b"])


def draw(*parts: Column | str | int) -> Column:
    """Repeatable independent draw below 2^32: the first 8 digits of a hash of the parts."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
