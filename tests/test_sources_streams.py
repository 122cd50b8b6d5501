import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketlab.operators import prices
from basketlab.params import Params
from basketlab.sources import forward_log, rates, scratch
from basketlab.sources.universe import load_universe
from basketlab.streaming import log as log_stream
from basketlab.streaming import marks as mark_stream

LISTING = "ticker STRING, name STRING, sector STRING, sub_industry STRING, cik STRING, line INT"


def test_later_list_overwrites(spark):
    large = spark.createDataFrame([(" brk.b ", "Old", "Fin", "x", "12", 1), ("AA", None, None, None, "n/a", 2)], LISTING)
    small = spark.createDataFrame([("BRK.B", " New ", "Ins", None, "13", 1)], LISTING)
    got = {r.ticker: tuple(r)[1:] for r in load_universe([large, small]).collect()}
    assert got == {"BRK.B": ("New", "Ins", "", 13), "AA": ("AA", "Unknown", "", None)}


def test_log_skips_bad_lines(spark, tmp_path):
    good = '{"date": "2024-01-0%d", "runType": "daily", "armReturns": {"greedy": 0.5, "b": null}}'
    (tmp_path / "log.jsonl").write_text("\n".join([good % 1, "", '{"date": "2024', good % 2]) + "\n")
    rows = forward_log.explode_marks(forward_log.read_log(spark, str(tmp_path))).collect()
    assert sorted((r.date, r.arm, r.ret) for r in rows if r.arm == "b") == [("2024-01-01", "b", None), ("2024-01-02", "b", None)]
    assert len(rows) == 4


def test_yield_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,3 Mo\n01/02/2024,5.00\n01/03/2024,N/A\n2024-01-04,4.5\n")
    (tmp_path / "b.csv").write_text("Date,3 Mo\n01/02/2024,5.25\n")
    got = {str(r.date): r.rf_annual for r in rates.parse_yields(rates.read_yield_csv(spark, str(tmp_path))).collect()}
    assert got == {"2024-01-02": pytest.approx(0.0525), "2024-01-04": pytest.approx(0.045)}
    (tmp_path / "c.csv").write_text("Day,4 Mo\n01/02/2024,5.25\n")
    with pytest.raises(Exception):
        rates.read_yield_csv(spark, str(tmp_path / "c.csv")).collect()


def test_fallback_chain(spark):
    one = spark.createDataFrame([(dt.date(2024, 1, 1), 0.05)], "date DATE, rf_annual DOUBLE")
    none = one.where("false")
    assert rates.with_fallback(one, none, 0.04).first().rf_annual == 0.05
    assert rates.with_fallback(none, one, 0.04).first().rf_annual == 0.05
    assert rates.with_fallback(none, none, 0.04).first().rf_annual == 0.04


def test_scratch_follows_the_session(spark):
    assert scratch.scratch_path(spark, "x").startswith(scratch.scratch_root(spark))


def stream_input(spark, root):
    days = [dt.date(2024, 1, d) for d in (2, 3, 4, 5)]
    rows = [(s, d, float(100 + 7 * i + 3 * k)) for k, s in enumerate("ab") for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "security STRING, date DATE, close DOUBLE").withColumn("volume", F.lit(1.0))
    weights = spark.createDataFrame([("p", "a", 0.6), ("p", "b", 0.2)], "portfolio STRING, security STRING, weight DOUBLE")
    return days, bars, weights


def test_marks_with_a_late_date(spark, tmp_path):
    days, bars, weights = stream_input(spark, tmp_path)
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    run = mark_stream.upsert_batch(weights, store, out)
    late = days[1]
    run(bars.where(F.col("date") != F.lit(late)), 0)
    run(bars.where(F.col("date") == F.lit(late)), 1)
    run(bars.where(F.col("date") == F.lit(late)), 1)  # a batch that is run again
    got = {r.date: r.ret for r in spark.read.schema(mark_stream.MARKS).parquet(out).collect()}
    rets = prices.daily_returns(bars).groupBy("date").pivot("security", ["a", "b"]).agg(F.first("ret")).collect()
    # the first date has no return yet, and a mark of 0
    assert got == {days[0]: 0.0} | {r.date: pytest.approx(0.75 * r.a + 0.25 * r.b) for r in rets}


def test_a_later_batch_reads_only_months_it_touches(spark, tmp_path):
    from datetime import date

    days = [date(2024, m, 5) for m in range(1, 7)]
    rows = [("a", d, 10.0 + i, 1.0) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "security string, date date, close double, volume double")
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    weights = spark.createDataFrame([("p", "a", 1.0), ("q", "other", 1.0)], "portfolio string, security string, weight double")
    run = mark_stream.upsert_batch(weights, store, out)
    run(bars.where("date < '2024-06-01'"), 0)
    near = mark_stream.stored_bars(spark, f"{store}/bars", days[4:5])
    assert {p.split("month=")[1][:7] for p in near.inputFiles()} == {"2024-05"}
    run(bars.where("date >= '2024-06-01'"), 1)
    marks = {(r.portfolio, r.date): r.ret for r in spark.read.schema(mark_stream.MARKS).parquet(out).collect()}
    assert len(marks) == 12 and all(marks["q", d] == 0.0 for d in days)
    assert marks["p", days[5]] == pytest.approx(15 / 14 - 1)


def test_what_a_batch_reads_does_not_grow_with_batches(spark, tmp_path):
    from datetime import date

    days = [date(2024, 1, 2 + i) for i in range(12)]
    rows = [("a", d, 10.0 + i * i, 1.0) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "security string, date date, close double, volume double")
    weights = spark.createDataFrame([("p", "a", 1.0)], "portfolio string, security string, weight double")
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    run = mark_stream.upsert_batch(weights, store, out)
    for n, d in enumerate(days):
        run(bars.where(F.col("date") == F.lit(d)), n)
    run(bars.where(F.col("date") == F.lit(days[-1])), len(days) - 1)  # again
    late = bars.where(F.col("date") == F.lit(days[3])).withColumn("close", F.lit(50.0))
    run(late, len(days))  # corrects a date that was written as one with others
    folders = mark_stream.numbered(spark, f"{store}/bars/month=2024-01", "batch")
    assert len(folders) <= mark_stream.FOLDERS and any(n % 2 for n in folders)
    assert mark_stream.numbered(spark, f"{store}/dates", "version") == [11, 12]
    close = {d: 50.0 if d == days[3] else 10.0 + i * i for i, d in enumerate(days)}
    got = {r.date: r.close for r in mark_stream.stored_bars(spark, f"{store}/bars", days).collect()}
    assert got == close
    marks = {r.date: r.ret for r in spark.read.schema(mark_stream.MARKS).parquet(out).collect()}
    assert marks == {days[0]: 0.0} | {b: pytest.approx(close[b] / close[a] - 1) for a, b in zip(days, days[1:])}


def test_log_upsert_keeps_the_latest_run_whatever_the_order(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([], log_stream.RECORD).write.partitionBy("date").parquet(path)
    run = log_stream.upsert_batch(path)

    def rec(date, value, seq):
        return spark.createDataFrame([(date, "daily", {"greedy": value}, {}, None, seq)], log_stream.RECORD)

    run(rec("2024-01-02", 0.2, 2), 0)
    run(rec("2024-01-02", 0.1, 1).union(rec("2024-01-03", 0.3, 1)), 1)
    got = {str(r.date): r.armReturns["greedy"] for r in log_stream.stored_log(spark, path).collect()}
    assert got == {"2024-01-02": 0.2, "2024-01-03": 0.3}


def test_parameters():
    with pytest.raises(ValueError):
        Params(weight_health=0.9)
    with pytest.raises(ValueError):
        Params(cov_method="other")
    assert Params().min_history_rows == 756


def test_whole_records_survive_upsert_and_stream(spark, tmp_path):
    import json

    line = {
        "date": "2024-02-01", "runType": "weekly", "armReturns": {"greedy": 0.01, "qubo_quantum": None}, "armNav": {"greedy": 1.01},
        "rebalance": {"selectionByArm": {"greedy": ["A", "B"]}, "diagnosticsByArm": {"greedy": {"energy": "-1.5"}}}, "run_seq": 1,
    }
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "one.json").write_text(json.dumps(line) + "\n")
    q = log_stream.start_log(spark, str(tmp_path / "landed"), str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    q.awaitTermination()
    got = log_stream.stored_log(spark, str(tmp_path / "log")).first().asDict(recursive=True)
    assert {**got, "date": str(got["date"])} == line


def test_unknown_arms_are_rejected(spark):
    from basketlab.operators import forward

    frame = spark.createDataFrame([("greedy",), ("someone",)], "arm string")
    with pytest.raises(Exception, match="unknown arm someone"):
        forward.arm_pairs(frame).collect()
