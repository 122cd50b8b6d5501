"""Arm marks from bars that keep landing.

A return needs the previous trading date, which may have come in any earlier
batch or may still come late. So bars are kept by month and batch, and the marks of
every date a batch touches, and of the date after, are computed again from what is
stored and replace those dates. A batch reads only the folders of the months of
those dates and of the one before. A month of more than `FOLDERS` batches is written
again as one folder, so what a batch reads doesn't grow with the number of batches.

Bars of batch n are of order 2n; a month's bars up to batch n, written as one, are of
order 2n + 1 and win over them, so it doesn't matter whether the older folders are gone
already. The dates known after batch n are one file, version n, made from the version
before; older ones are removed. A batch that is run twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.functions.exprs import ratio
from basketlab.operators.prices import daily_returns
from basketlab.sources.schemas import BARS
from basketlab.sources.scratch import scratch_path

MARKS = "portfolio STRING, ret DOUBLE, date DATE"
FOLDERS = 8


def numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers n of the folders `prefix=n` in `folder`, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}="))


def exists(spark: SparkSession, file: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def latest_bars(spark: SparkSession, store: str, months: list[str]) -> DataFrame:
    """One bar per (security, date) of the given months, the latest batch winning.
    Only the folders of these months are listed and read."""
    paths = [f"{store}/month={m}" for m in months]
    rows = spark.read.schema(f"{BARS}, month STRING, batch BIGINT").option("basePath", store).parquet(*paths)
    return rows.groupBy("security", "date").agg(
        F.max_by("close", "batch").alias("close"), F.max_by("volume", "batch").alias("volume")
    )


def stored_bars(spark: SparkSession, store: str, dates: list) -> DataFrame:
    """`latest_bars` of the months of `dates`, from the first of them to the last."""
    months = sorted({f"{d:%Y-%m}" for d in dates})
    return latest_bars(spark, store, months).where(F.col("date").between(dates[0], dates[-1]))


def compact(spark: SparkSession, store: str, month: str) -> None:
    """One folder instead of a month's many."""
    folder = f"{store}/month={month}"
    orders = numbered(spark, folder, "batch")
    if len(orders) <= FOLDERS:
        return
    merged = orders[-1] | 1
    whole = f"{folder}/batch={merged}"
    if merged != orders[-1] or not exists(spark, f"{whole}/_SUCCESS"):
        remove(spark, whole)  # what a failed attempt left; the older folders are all there
        latest_bars(spark, store, [month]).coalesce(1).write.parquet(whole)
    for order in orders:
        if order != merged:
            remove(spark, f"{folder}/batch={order}")


def known_dates(batch: DataFrame, store: str, batch_id: int) -> DataFrame:
    """The dates of all batches up to this one: a row a trading date, one file."""
    spark, folder = batch.sparkSession, f"{store}/dates"
    earlier = [n for n in numbered(spark, folder, "version") if n < batch_id]
    rows = batch.select("date")
    if earlier:
        rows = rows.unionByName(spark.read.schema("date DATE").parquet(f"{folder}/version={earlier[-1]}"))
    rows.distinct().coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
    for n in earlier[:-1]:
        remove(spark, f"{folder}/version={n}")
    return spark.read.schema("date DATE").parquet(f"{folder}/version={batch_id}")


def mark_dates(weights: DataFrame, bars: DataFrame, dates: list) -> DataFrame:
    """Marks of frozen weights on each of `dates`; missing returns are 0, also where a
    portfolio has none at all."""
    totals = weights.groupBy("portfolio").agg(F.sum("weight").alias("_w"))
    share = weights.join(totals, "portfolio").select(
        "portfolio", "security", ratio("weight", "_w").alias("share")
    )
    rets = daily_returns(bars).where(F.col("date").isin(dates))
    sums = (
        share.join(rets, "security")
        .groupBy("portfolio", "date")
        .agg(F.sum(F.col("share") * F.col("ret")).alias("ret"))
    )
    every = F.explode(F.array(*[F.lit(d) for d in dates]))
    return (
        totals.select("portfolio", every.alias("date"))
        .join(sums, ["portfolio", "date"], "left")
        .select("portfolio", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    )


def upsert_batch(weights: DataFrame, store: str, out: str):
    """The foreachBatch function."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        (
            batch.withColumn("month", F.date_format("date", "yyyy-MM"))
            .repartition("month")
            .withColumn("batch", F.lit(2 * batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month", "batch")
            .parquet(f"{store}/bars")
        )
        known = known_dates(batch, store, batch_id)
        touched = batch.agg(
            F.min("date").alias("lo"),
            F.max("date").alias("hi"),
            F.collect_set(F.date_format("date", "yyyy-MM")).alias("months"),
        ).first()
        # the touched range and its neighbours: as many dates as the batch spans
        edge = known.agg(
            F.max(F.when(F.col("date") < touched.lo, F.col("date"))).alias("before"),
            F.min(F.when(F.col("date") > touched.hi, F.col("date"))).alias("after"),
        ).first()
        lo, hi = edge.before or touched.lo, edge.after or touched.hi
        near = known.where(F.col("date").between(lo, hi)).agg(F.array_sort(F.collect_set("date"))).first()[0]
        marked = [d for d in near if d >= touched.lo]
        (
            mark_dates(weights, stored_bars(spark, f"{store}/bars", near), marked)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date")
            .parquet(out)
        )
        for month in sorted(touched.months):
            compact(spark, f"{store}/bars", month)

    return run


def start_marks(spark: SparkSession, landed: str, weights: DataFrame, store: str, out: str,
                checkpoint: str, files_per_batch: int):
    return (
        spark.readStream.schema(BARS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landed)
        .writeStream.foreachBatch(upsert_batch(weights, store, out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replay_marks(s) -> DataFrame:
    """Lands the screen's bars in a few folders by date range, streams them, and
    returns the marks (portfolio, date, ret)."""
    root = scratch_path(s.spark, "stream-marks")
    landed, weights = f"{root}/landed", f"{root}/weights"
    chunk = F.year("date")
    s.bars.withColumn("chunk", chunk).repartition("chunk").write.partitionBy("chunk").parquet(landed)
    s.book.select("portfolio", "security", "weight").write.parquet(weights)
    frozen = s.spark.read.schema("portfolio STRING, security STRING, weight DOUBLE").parquet(weights)
    q = start_marks(
        s.spark, landed, frozen, f"{root}/store", f"{root}/marks", f"{root}/checkpoint", 3
    )
    q.awaitTermination()
    return s.spark.read.schema(MARKS).parquet(f"{root}/marks").select("portfolio", "date", "ret")
