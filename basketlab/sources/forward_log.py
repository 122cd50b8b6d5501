"""The append-only forward log: JSON lines in, date-partitioned table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.functions.exprs import finite
from basketlab.sources.schemas import LOG_RECORD

_CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the log, its record's fields and, where it isn't a record, why:
    cause is blank, malformed or undated, else null."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    schema = f"{LOG_RECORD}, {_CORRUPT} STRING"
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    cause = (
        F.when(F.trim("line") == "", "blank")
        .when(F.col(f"r.{_CORRUPT}").isNotNull(), "malformed")
        .when(F.col("r.date").isNull(), "undated")
    )
    return lines.withColumn("r", parsed).select("line", "r.*", cause.alias("cause")).drop(_CORRUPT)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The records; lines that are none are left to `rejected`."""
    return read_lines(spark, path).where("cause IS NULL").drop("line", "cause")


def rejected(lines: DataFrame) -> DataFrame:
    """(cause, n) of `read_lines`: how many lines are records ('kept') and how many not."""
    return lines.groupBy(F.coalesce("cause", F.lit("kept")).alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def explode_marks(log: DataFrame) -> DataFrame:
    """(date, arm, ret), nulls kept: an arm that reported null was still seen."""
    return log.select("date", F.explode("armReturns").alias("arm", "ret"))


def record(
    marks: DataFrame, run_type: str, run_seq: int, nav: DataFrame | None = None,
    rebalance: Column | None = None,
) -> DataFrame:
    """Marks (date, arm, ret) -> one log record per date, with NAV (date, arm, nav) and,
    for a run that selected anew, what it selected."""
    # the inner round absorbs summation-order noise
    def logged(c: str) -> Column:
        return F.round(F.round(finite(c), 12), 6)

    def by_arm(df: DataFrame, c: str, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(F.col("arm"), logged(c).alias("v"))))
        return df.groupBy(F.col("date").cast("string").alias("date")).agg(
            F.map_from_entries(entries).alias(name)
        )

    rows = by_arm(marks, "ret", "armReturns")
    none = F.create_map().cast("map<string,double>")
    if nav is None:
        rows = rows.withColumn("armNav", none)
    else:
        rows = rows.join(by_arm(nav, "nav", "armNav"), "date", "left").withColumn(
            "armNav", F.coalesce("armNav", none)
        )
    if rebalance is None:
        rebalance = F.lit(None)
    kind = "struct<selectionByArm: map<string, array<string>>, diagnosticsByArm: map<string, map<string, string>>>"
    return rows.select(
        "date", F.lit(run_type).alias("runType"), "armReturns", "armNav",
        rebalance.cast(kind).alias("rebalance"), F.lit(run_seq).alias("run_seq"),
    )


def upsert(log: DataFrame, new: DataFrame) -> DataFrame:
    """One record per date: the one of the latest run. Both carry `run_seq`."""
    both = log.unionByName(new, allowMissingColumns=True)
    body = [c for c in both.columns if c != "date"]
    return (
        both.groupBy("date")
        .agg(F.max_by(F.struct(*body), "run_seq").alias("r"))
        .select("date", "r.*")
    )


def write_dates(records: DataFrame, path: str) -> None:
    """Replaces exactly the dates present in `records`."""
    (
        records.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )
