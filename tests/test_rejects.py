"""Lines and rows that are no records, counted by cause."""

from basketlab.sources import forward_log, rates


def test_log_lines_by_cause(spark, tmp_path):
    good = '{"date": "2024-01-0%d", "runType": "daily", "armReturns": {"greedy": 0.01}}'
    lines = [good % 1, "", "   ", good % 2, '{"date": "2024-01-03", "armRet', "not json", '{"runType": "daily"}', '{"date": null}', good % 3]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    read = forward_log.read_lines(spark, str(tmp_path))
    assert {r.cause: r.n for r in forward_log.rejected(read).collect()} == {"kept": 3, "blank": 2, "malformed": 2, "undated": 2}
    assert sorted(r.line for r in read.where("cause = 'malformed'").collect()) == sorted([lines[4], lines[5]])
    records = forward_log.read_log(spark, str(tmp_path))
    assert sorted(r.date for r in records.collect()) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert records.columns == ["date", "runType", "armReturns", "armNav", "rebalance"]


def test_yield_rows_by_cause(spark):
    rows = spark.createDataFrame(
        [("01/02/2024", "5.40", "a"), ("01/03/2024", "N/A", "a"), ("01/04/2024", None, "a"), ("soon", "5.40", "a"), (None, None, "a"), ("2024-01-05", "NaN", "a"), ("01/02/2024", "5.50", "b")],
        "Date string, `3 Mo` string, file string",
    )
    causes = [r.cause for r in rates.read_prints(rows).collect()]
    assert causes == [None, "unpriced", "unpriced", "undated", "undated", "unpriced", None]
    assert [(str(r.date), r.rf_annual) for r in rates.parse_yields(rows).collect()] == [("2024-01-02", 0.055)]
