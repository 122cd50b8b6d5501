"""Exact ranks and quantiles over groups of any size.

A window `partitionBy(group).orderBy(value)` puts a whole group into one task.
Here the values are counted first (ties collapse before the shuffle), split
into buckets that are a pure function of the value, and ranked inside each
bucket. A bucket is a prefix of the value's 64 order-preserving bits: 20 bits
first (256 buckets an octave); a bucket of more than `FULL` values is split by
15 more bits, and one of those by another 15, after which 14 bits are left. So
every window is bounded: 2^20 buckets of a group, 2^15 parts of a bucket, and
`FULL` values, however narrow a factor's range is. A re-run task recomputes
the same buckets, so a lost executor cannot change a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.exprs import col
from basketlab.sources.scratch import materialize

SHIFTS = (44, 29, 14)  # bits below the prefix, by level
FULL = 1 << SHIFTS[-1]


def order_bits(value) -> Column:
    """The bits of a double as a number in the values' order; both zeros are 0."""
    v = col(value)
    a = F.abs(v)
    low, high = F.lit(-1022.0), F.lit(1023.0)
    guess = F.floor(F.least(F.greatest(F.log2(a), low), high)).cast("double")
    # the logarithm may be off by one next to a power of two
    lower = F.greatest(low, guess - F.when(a < F.pow(F.lit(2.0), guess), 1.0).otherwise(0.0))
    exponent = F.least(high, lower + F.when(a >= 2.0 * F.pow(F.lit(2.0), lower), 1.0).otherwise(0.0))
    mantissa = F.least(a / F.pow(F.lit(2.0), exponent), F.lit(2.0))
    bits = (exponent + 1022.0).cast("long") * F.lit(1 << 52) + (mantissa * F.lit(2.0**52)).cast("long")
    return F.when(v > 0, bits).when(v < 0, -bits).otherwise(F.lit(0).cast("long"))


def levels(counts: DataFrame, keys: list[str], full: int) -> int:
    """How many of `SHIFTS` are needed until no bucket has more than `full` values."""
    for level, shift in enumerate(SHIFTS[:-1], 1):
        sizes = counts.groupBy(*keys, F.shiftright("_bits", shift)).agg(F.count(F.lit(1)).alias("_n"))
        if sizes.where(F.col("_n") > full).isEmpty():
            return level
    return len(SHIFTS)


def value_ranks(df: DataFrame, keys: list[str], value: str, full: int = FULL) -> DataFrame:
    """One row per (keys, value): `ties`, `below` (how many are smaller), `n`.

    The counted values are written, as every level reads them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("ties")
    )
    counts = materialize(counts.withColumn("_bits", order_bits(value)), "values")
    rows = counts.withColumn("below", F.lit(0).cast("long"))
    path: list[str] = []
    for level, shift in enumerate(SHIFTS[: levels(counts, keys, full)]):
        bucket = F.shiftright("_bits", shift)
        # only values of buckets that are too full have a bucket on a later level
        rows = rows.withColumn(f"_b{level}", F.when(F.col("_full"), bucket) if level else bucket)
        parent, path = [*keys, *path], [*path, f"_b{level}"]
        place = [*keys, *path]
        before = Window.partitionBy(*parent).orderBy(path[-1]).rowsBetween(
            Window.unboundedPreceding, -1
        )
        starts = (
            rows.where(F.col(path[-1]).isNotNull())
            .groupBy(*place)
            .agg(F.sum("ties").alias("_sum"), (F.count(F.lit(1)) > full).alias("_full"))
            .select(
                *place,
                "_full",
                F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
                *([] if level else [F.sum("_sum").over(Window.partitionBy(*keys)).alias("n")]),
            )
        )
        rows = (
            rows.drop("_full")
            .join(starts, place, "left" if level else "inner")
            .withColumn("below", F.col("below") + F.coalesce("_start", F.lit(0)))
            .drop("_start")
        )
    inside = Window.partitionBy(*keys, *path).orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    smaller = F.coalesce(F.sum("ties").over(inside), F.lit(0))
    return rows.select(*keys, value, "ties", (F.col("below") + smaller).alias("below"), "n")


def average_rank_pct() -> Column:
    """Average-tie percentile 0-100 from the columns of `value_ranks`."""
    return 100.0 * (F.col("below") + (F.col("ties") + 1) / 2.0) / F.col("n")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    ranks = value_ranks(df, keys, value)

    def at(position: Column) -> Column:
        hit = (F.col("below") <= position) & (position < F.col("below") + F.col("ties"))
        return F.max(F.when(hit, F.col(value)))

    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    return ranks.groupBy(*keys).agg(
        ((at(low) + at(high)) / 2.0).alias(out), F.max("n").alias("n")
    )
