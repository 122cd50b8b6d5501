"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
        "value DOUBLE, props STRING"
    ),
}

CONSTITUENTS = "ticker STRING, name STRING, sector STRING, sub_industry STRING, cik STRING"

FACT_ITEM = "STRUCT<start: STRING, `end`: STRING, val: DOUBLE, filed: STRING, form: STRING>"
FILING = (
    "cik STRING, facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, "
    f"ARRAY<{FACT_ITEM}>>>>>"
)

YIELD_CSV = "`Date` STRING, `3 Mo` STRING"

LOG_RECORD = (
    "date STRING, runType STRING, armReturns MAP<STRING, DOUBLE>, "
    "armNav MAP<STRING, DOUBLE>, "
    "rebalance STRUCT<selectionByArm: MAP<STRING, ARRAY<STRING>>, "
    "diagnosticsByArm: MAP<STRING, MAP<STRING, STRING>>>"
)

BARS = "security STRING, date DATE, close DOUBLE, volume DOUBLE"
