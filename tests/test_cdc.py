from datetime import timedelta

from pyspark.sql import functions as F

from railpulse.operators.cdc import cdc_pair, final_outcome, latest_by
from tests.conftest import at, by

NOON = at("2024-01-30 12:00:00")
LOG = "request_id bigint, op_name string, op_time timestamp, message string, rc string"


def log(spark, *rows):
    """(request, op, seconds after noon, message, rc)"""
    return spark.createDataFrame(
        [(r, op, NOON + timedelta(seconds=s), m, rc) for r, op, s, m, rc in rows], LOG
    )


def outcomes(df):
    return by(
        final_outcome(df, "request_id", "op_time", F.lower("message") == "success"), "request_id"
    )


def test_latest_by_keeps_one_row_and_breaks_ties(spark):
    df = log(spark, (1, "UPDATE", 1, "a", ""), (1, "UPDATE", 2, "b", ""), (1, "UPDATE", 2, "c", ""),
             (2, "UPDATE", 0, None, ""))
    rows = by(latest_by(df, ["request_id"], "op_time", ["message"]), "request_id")
    assert rows[1]["message"] == "c" and rows[2]["message"] is None
    assert "_rn" not in rows[1]


def test_latest_by_limits_before_the_shuffle(spark):
    plan = latest_by(log(spark, (1, "UPDATE", 1, "a", "")), ["request_id"], "op_time")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_pair_takes_each_column_from_its_side(spark):
    df = log(spark, (1, "INSERT", 0, "in", "00"), (1, "UPDATE", 1, "old", "91"),
             (1, "UPDATE", 2, "new", "92"), (2, "INSERT", 0, "in", "00"), (3, "UPDATE", 0, "x", ""))
    latest = cdc_pair(df, "request_id", {"rc": "rc"}, {"message": "message"}, "op_time")
    assert [tuple(r) for r in latest.collect()] == [(1, "00", "new", 1)]
    every = cdc_pair(df, "request_id", {"rc": "rc"}, {"message": "message"})
    assert sorted(tuple(r) for r in every.collect()) == [(1, "00", "new", 1), (1, "00", "old", 1)]


def test_pair_counts_copies(spark):
    rows = [(1, "INSERT", 0, None, "00")] * 3 + [(1, "UPDATE", 1, "ok", "")] * 2
    pairs = cdc_pair(log(spark, *rows), "request_id", {}, {"message": "message"})
    assert [tuple(r) for r in pairs.collect()] == [(1, "ok", 6)]


def test_final_outcome(spark):
    df = log(
        spark,
        (1, "INSERT", 0, None, ""), (1, "UPDATE", 1, "PENDING", ""), (1, "UPDATE", 2, "SUCCESS", ""),
        (2, "INSERT", 0, None, ""), (2, "INSERT", 0, None, ""), (2, "UPDATE", 1, "success", ""),
        (2, "UPDATE", 2, None, ""),
        (3, "INSERT", 0, None, ""),
        (4, "UPDATE", 0, "success", ""),
        (5, "INSERT", 0, None, ""), (5, "UPDATE", 1, "failed", ""), (5, "UPDATE", 1, "success", ""),
    )
    rows = outcomes(df)
    assert set(rows) == {1, 2, 5}
    assert (rows[1]["inserts"], rows[1]["succeeded"]) == (1, True)
    assert (rows[2]["inserts"], rows[2]["succeeded"]) == (2, False)  # the latest has no message
    assert rows[5]["succeeded"] is True  # same microsecond


def test_final_outcome_is_one_scan_without_sort(spark):
    df = log(spark, (1, "INSERT", 0, None, ""))
    plan = final_outcome(df, "request_id", "op_time", F.col("message") == "success")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Sort" not in text and "Join" not in text
