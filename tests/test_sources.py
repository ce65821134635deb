from datetime import date

import pytest
from pyspark.sql import functions as F

from railpulse.functions.timeparts import DayRange
from railpulse.operators.durable import checkpoint_dir, keep
from railpulse.plans.catalog import dataset, query_days
from railpulse.sources.export import export_csv, export_hourly, export_states
from railpulse.sources.files import publish_csv
from railpulse.sources.tables import (
    SCHEMAS, conform, load_tables, scan_days, write_partitioned,
)

DAYS = DayRange(date(2024, 1, 29), date(2024, 1, 30))


def test_conform_renames_casts_and_checks(spark):
    df = spark.createDataFrame(
        [("7", "2024-01-30 10:00:00", "yes", 1)], "REQUEST_ID string, Log_Date_Time string, msg string, x int"
    )
    out = conform(df, "daily_responses", {"message": "MSG"})
    assert out.schema == SCHEMAS["daily_responses"]
    assert out.first().request_id == 7 and out.first().message == "yes"
    with pytest.raises(ValueError, match="message"):
        conform(df, "daily_responses")


def test_fractional_amounts_round_half_away(spark):
    df = spark.sql(
        "SELECT 1L AS request_id, 1L AS client_id, now() AS log_date_time,"
        " explode(array(2.5D, -2.5D, 2.4D)) AS trans_amt, 'A' AS cust_bank_name"
    )
    assert [r.trans_amt for r in conform(df, "daily_requests").collect()] == [3, -3, 2]


def test_partitioned_tables_round_trip_and_prune(spark, logs, tmp_path):
    for day in (28, 29, 30):
        logs.txn(day, f"2024-01-{day} 10:00:00")
    for name in SCHEMAS:
        if name == "client_locations":
            logs.frame(name).write.parquet(f"{tmp_path}/{name}")
        else:
            write_partitioned(logs.frame(name), name, f"{tmp_path}/{name}", files_per_day=1)
    tables = load_tables(spark, str(tmp_path))
    scan = scan_days(tables.txn_requests, "op_time", DAYS)
    assert sorted(r.request_id for r in scan.collect()) == [29, 30]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_day" in plan
    assert "PushedFilters: [IsNotNull(op_time), GreaterThanOrEqual(op_time" in plan


def test_days_are_written_as_the_given_number_of_files(spark, logs, tmp_path):
    for i in range(60):
        logs.txn(i % 2, f"2024-01-{29 + i % 2} 10:{i // 2:02}:00")
    write_partitioned(logs.frame("txn_requests"), "txn_requests", f"{tmp_path}/t", files_per_day=2)
    for day in (29, 30):
        assert len(list((tmp_path / "t" / f"log_day=2024-01-{day}").glob("*.parquet"))) <= 2
    assert spark.read.parquet(f"{tmp_path}/t").count() == 60


def test_files_per_day_must_be_chosen(logs, tmp_path):
    with pytest.raises(TypeError):
        write_partitioned(logs.frame("txn_requests"), "txn_requests", f"{tmp_path}/t")


def test_other_zones_are_refused(spark, logs, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        with pytest.raises(ValueError, match="UTC"):
            load_tables(spark, str(tmp_path))
        with pytest.raises(ValueError, match="UTC"):
            write_partitioned(logs.frame("txn_requests"), "txn_requests", f"{tmp_path}/t", 1)
        with pytest.raises(ValueError, match="UTC"):
            dataset("bank_yesterday", logs.tables(), date(2024, 1, 30))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unknown_table(logs):
    with pytest.raises(AttributeError):
        logs.tables().nonsense


def test_bound_dates(logs):
    for day in (28, 29, 30):
        logs.daily(day, f"2024-01-{day} 10:00:00")
    text = "SELECT count(*) AS n FROM daily_requests WHERE to_date(log_date_time) BETWEEN :a AND :b"
    row = query_days(logs.tables(), text, {"a": DAYS.first, "b": DAYS.last}, "daily_requests").first()
    assert row.n == 2


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b, c", None)], "name string, x double")
    path = export_csv(df, str(tmp_path), "report", date(2024, 1, 30))
    assert path.endswith("/report_2024-01-30.csv")
    back = spark.read.schema(df.schema).option("header", True).csv(path)
    assert sorted(map(tuple, back.collect())) == [("a", 1.5), ("b, c", None)]
    names = export_hourly(df, df, str(tmp_path), date(2024, 1, 30)) + export_states(
        df, df, str(tmp_path), date(2024, 1, 30)
    )
    assert [n.rsplit("/", 1)[1] for n in names] == [
        "transaction_data_2024-01-30.csv", "bio_auth_data_2024-01-30.csv",
        "state_metrics_20240130.csv", "state_metrics_all_20240130.csv",
    ]


def test_reports_are_one_file_with_a_header(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n, {i}") for i in range(50)], "x int, name string").repartition(5).orderBy("x")
    path = export_csv(df, str(tmp_path), "report", date(2024, 1, 30), single=True)
    lines = (tmp_path / "report_2024-01-30.csv").read_text().splitlines()
    assert lines[0] == "x,name" and lines[1:] == [f'{i},"n, {i}"' for i in range(50)]
    # written again it is replaced; without rows it has its header
    for empty in (df.where("x < 0"), spark.createDataFrame([], df.schema)):
        assert publish_csv(empty, path) == path
        assert (tmp_path / "report_2024-01-30.csv").read_text().strip() == "x,name"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["report_2024-01-30.csv"]


def test_a_failed_export_leaves_the_old_file(spark, tmp_path):
    path = publish_csv(spark.range(3).toDF("x"), f"{tmp_path}/r.csv")
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        publish_csv(broken, path)
    assert (tmp_path / "r.csv").read_text().split() == ["x", "0", "1", "2"]
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["r.csv"]


def test_keep_cuts_the_plan(spark):
    kept = keep(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and kept.count() == 3
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
