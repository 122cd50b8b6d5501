"""Risk-free yields: yearly CSV files, the cached copy and the constant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlab.sources.schemas import YIELD_CSV


def read_yield_csv(spark: SparkSession, path: str) -> DataFrame:
    """A changed header fails the read (`enforceSchema` off) instead of being
    read into the wrong column."""
    return (
        spark.read.schema(YIELD_CSV)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
        .select("Date", "3 Mo", F.input_file_name().alias("file"))
    )


def read_prints(rows: DataFrame, order: str = "file") -> DataFrame:
    """(date, rf_annual, src, cause): percent text as decimal yield, and of a row that is
    no print why: undated or unpriced (gaps as text), else null."""
    date = F.coalesce(F.col("Date").try_cast("date"), F.try_to_date("Date", "MM/dd/yyyy"))
    value = F.col("3 Mo").try_cast("double") / 100.0
    parsed = rows.select(date.alias("date"), value.alias("rf_annual"), F.col(order).alias("src"))
    cause = F.when(F.col("date").isNull(), "undated").when(
        F.col("rf_annual").isNull() | F.isnan("rf_annual"), "unpriced"
    )
    return parsed.withColumn("cause", cause)


def parse_yields(rows: DataFrame, order: str = "file") -> DataFrame:
    """Percent text -> decimal yield, one row per date, the last file winning."""
    parsed = read_prints(rows, order).where("cause IS NULL")
    return parsed.groupBy("date").agg(F.max_by("rf_annual", "src").alias("rf_annual"))


def with_fallback(primary: DataFrame, cached: DataFrame, constant: float) -> DataFrame:
    """Rows of the best source that has any: fetched, cached, then the constant."""
    spark = primary.sparkSession
    flat = spark.range(1).select(
        F.lit("1990-01-01").cast("date").alias("date"), F.lit(constant).alias("rf_annual")
    )
    tagged = [
        d.select("date", "rf_annual", F.lit(i).alias("rank"))
        for i, d in enumerate((primary, cached, flat))
    ]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    best = rows.agg(F.min("rank")).scalar()
    return rows.where(F.col("rank") == best).select("date", "rf_annual")


def refresh_cache(fetched: DataFrame, path: str) -> None:
    """A successful fetch rewrites the cached copy; an empty one leaves it."""
    if not fetched.isEmpty():
        fetched.write.mode("overwrite").parquet(path)


def asof(dates: DataFrame, rf: DataFrame, constant: float) -> DataFrame:
    """(date, rf_annual) with the last print on or before each date.

    `dates` must hold distinct dates: like `rf` it is bounded by the length of
    the calendar, whatever the number of securities, so ordering it is cheap.
    """
    marks = dates.select("date", F.lit(None).cast("double").alias("rf_annual"), F.lit(1).alias("ask"))
    prints = rf.select("date", "rf_annual", F.lit(0).alias("ask"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("date", "ask").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        marks.unionByName(prints)
        .withColumn("rf", F.last("rf_annual", ignorenulls=True).over(so_far))
        .where("ask = 1")
        .select("date", F.coalesce("rf", F.lit(constant)).alias("rf_annual"))
    )


def attach(series: DataFrame, rf: DataFrame, constant: float) -> DataFrame:
    """The series with `rf_annual` joined on its date."""
    calendar = asof(series.select("date").distinct(), rf, constant)
    return series.join(F.broadcast(calendar), "date")


def mean_filled(dates: DataFrame, rf_map: DataFrame) -> DataFrame:
    """Dates the map lacks take the map's mean."""
    mean = rf_map.agg(F.avg("rf")).scalar()
    return dates.join(rf_map, "date", "left").withColumn("rf", F.coalesce("rf", mean))
