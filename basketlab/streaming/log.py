"""The forward log as a stream: a re-run of a date replaces the date.

`dropDuplicates` would keep the first record; here the latest run wins, also
when an older run arrives after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.sources import forward_log
from basketlab.sources.schemas import LOG_RECORD
from basketlab.sources.scratch import materialize, scratch_path

RECORD = f"{LOG_RECORD}, run_seq INT"


def upsert_batch(path: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        batch = materialize(batch, "log-batch")
        old = stored_log(spark, path).join(
            batch.select("date").distinct(), "date", "left_semi"
        )
        merged = forward_log.upsert(old, batch)
        # read before its own dates are replaced
        forward_log.write_dates(materialize(merged, "log-merged"), path)

    return run


def stored_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def start_log(spark: SparkSession, landed: str, path: str, checkpoint: str):
    spark.createDataFrame([], RECORD).write.mode("ignore").partitionBy("date").parquet(path)
    return (
        spark.readStream.schema(RECORD)
        .option("maxFilesPerTrigger", 8)
        .json(landed)
        .writeStream.foreachBatch(upsert_batch(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replay_log(s) -> DataFrame:
    """Lands three runs of the log, streams them, returns (date, runType, arm, ret)."""
    root = scratch_path(s.spark, "stream-log")
    marks = s.marks
    runs = [
        (marks.where("date >= '2024-01-08'").withColumn("ret", F.col("ret") * 2.0), "daily", 3),
        (marks, "weekly", 1),
        (marks.where("date >= '2024-01-05'").withColumn("ret", F.col("ret") * 1.5), "daily", 2),
    ]
    for rows, kind, seq in runs:
        forward_log.record(rows, kind, seq).write.json(f"{root}/landed/run={seq}")
    q = start_log(s.spark, f"{root}/landed/*", f"{root}/log", f"{root}/checkpoint")
    q.awaitTermination()
    return stored_log(s.spark, f"{root}/log").select(
        F.col("date").cast("string").alias("date"), "runType", F.explode("armReturns").alias("arm", "ret")
    )
