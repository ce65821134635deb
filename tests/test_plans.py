"""What the physical plans must and must not contain."""

import re

import pytest

from checks.registry import QUERIES
from checks.sample_tables import DAILY_AS_OF, HOURLY_AS_OF
from railpulse.plans import daily, hourly
from railpulse.sources.tables import SCHEMAS, PaymentTables, conform, write_partitioned

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Empty but real Parquet tables, so that plans show scans of the real layout."""
    root = tmp_path_factory.mktemp("tables")
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame([], schema)
        if name == "client_locations":
            df.write.parquet(f"{root}/{name}")
        else:
            write_partitioned(
                spark.createDataFrame([tuple([None] * len(schema))], schema), name, f"{root}/{name}",
                files_per_day=1,
            )
    return PaymentTables(
        spark, lambda name: conform(spark.read.parquet(f"{root}/{name}"), name)
    )


@pytest.mark.parametrize("build", [
    lambda t: hourly.txn_hourly_health(t, HOURLY_AS_OF),
    lambda t: hourly.bio_hourly_health(t, HOURLY_AS_OF),
    lambda t: daily.state_metrics(t, DAILY_AS_OF),
    lambda t: daily.bank_health(t, DAILY_AS_OF, DAILY_AS_OF),
])
def test_date_filters_reach_the_scans(stored, build):
    plan = plan_of(build(stored))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    dated = [line for line in scans if "retailer_id" not in line]
    assert dated and all("GreaterThanOrEqual(" in line for line in dated)
    assert all("PartitionFilters: [isnotnull(log_day" in line for line in dated)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "csv_"))))
def test_no_cross_joins_row_expansion_or_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "ArrowEvalPython", "MapInPandas"):
        assert node not in plan
    if not name.endswith("aggregator_long"):  # a reshape to long rows is an expansion
        assert "Expand" not in plan


def test_scans_read_only_what_they_need(stored):
    stored.spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(hourly.txn_hourly_health(stored, HOURLY_AS_OF))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    read = {frozenset(re.findall(r"(\w+):", s)) for s in schemas}
    assert read == {
        frozenset({"op_time", "request_id", "trans_amt", "master_trans_type", "aggregator"}),
        frozenset({"op_time", "op_name", "request_id", "message"}),
        frozenset({"op_time", "request_id"}),
    }


def test_one_scan_per_table_and_no_join_with_the_history(stored):
    plan = plan_of(hourly.txn_hourly_health(stored, HOURLY_AS_OF))
    assert plan.count("FileScan") == 3
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", plan)) == 2
    plan = plan_of(daily.state_metrics(stored, DAILY_AS_OF))
    assert plan.count("FileScan") == 3
    plan = plan_of(daily.bank_health(stored, DAILY_AS_OF, DAILY_AS_OF))
    assert plan.count("FileScan") == 3 and "WindowGroupLimit" in plan


def test_the_location_join_is_not_forced_to_broadcast(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(daily.state_metrics(stored, DAILY_AS_OF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan
