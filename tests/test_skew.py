"""One request id or client may hold a third of all rows."""

from datetime import date

from pyspark.sql import functions as F

from railpulse.functions.timeparts import days_before
from railpulse.operators.cdc import count_copies
from railpulse.plans import daily, hourly
from railpulse.sources.tables import PaymentTables
from tests.conftest import by

N = 60_000
HOT = N // 3


def frames(spark):
    """Every third row carries request 0, client 0 and bank A."""
    row = spark.range(N)
    key = F.when(row.id % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    hour = F.expr("timestamp'2024-01-30 10:00:00'")
    op = F.explode(F.array(F.lit("INSERT"), F.lit("UPDATE"))).alias("op_name")
    base = row.select(key.alias("request_id"), key.alias("client_id"), hour.alias("op_time"))
    logged = base.withColumnRenamed("op_time", "log_date_time")
    nothing = F.lit(None).cast("string")
    return PaymentTables.of(
        spark,
        txn_requests=base.select(
            "*", F.lit("INSERT").alias("op_name"), F.lit(10**10).alias("trans_amt"),
            F.lit("CW").alias("master_trans_type"), nothing.alias("trans_mode"),
            F.lit("ybl").alias("aggregator"),
        ),
        txn_responses=base.select(
            "*", op, nothing.alias("rc"), F.lit("Success").alias("message"),
            F.lit(1).alias("amount"), nothing.alias("response_message"),
        ),
        txn_devices=base.select("*", nothing.alias("dpid"), nothing.alias("rdsid")),
        bio_log=base.select(
            "*", op, F.lit("NSDL").alias("aggregator"), F.lit("00").alias("rc"), nothing.alias("rm")
        ),
        daily_requests=logged.select(
            "*", F.lit(1).alias("trans_amt"), F.lit("A").alias("cust_bank_name")
        ),
        daily_responses=logged.select("*", F.lit("SUCCESS").alias("message")),
        client_locations=spark.range(N).select(
            F.col("id").alias("retailer_id"), F.lit("X").alias("final_state")
        ),
    )


def test_hourly_counts_with_a_hot_request(spark):
    row = by(hourly.txn_hourly_health(frames(spark), date(2024, 1, 30)), "hour")["10:00"]
    # the hot request: requests × INSERT rows × device rows, far too many to list
    assert row["total_txns"] == HOT**3 + (N - HOT)
    assert row["overall_success_rate"] == 100.0
    # their amount is beyond 64 bits
    assert row["total_amount_cr"] == (HOT**3 + N - HOT) * 10**10 / 1e7


def test_authentication_with_a_hot_request(spark):
    row = by(hourly.bio_hourly_health(frames(spark), date(2024, 1, 30)), "hour")["10:00"]
    assert row["total_attempts"] == HOT**2 + (N - HOT)
    assert row["nsdl_rate_yesterday"] == 100.0
    assert row["per_user_rate_yesterday"] == round((HOT**2 + N - HOT) / (N - HOT + 1), 2)


def test_daily_counts_with_a_hot_request_client_and_bank(spark):
    tables, after = frames(spark), date(2024, 1, 31)
    pairs = HOT**2 + (N - HOT)
    row = by(daily.state_metrics(tables, after), "final_state")["X"]
    assert row["yesterday_transactions"] == pairs and row["yesterday_gtv"] == pairs / 1e7
    assert daily.bank_yesterday(tables, after).first().transaction_count == pairs


def test_a_hot_client_is_split_where_the_locations_are_not_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    many = 5 * N
    row = spark.range(many, numPartitions=8)
    client = F.when(row.id % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    rows = row.select(
        F.col("id").alias("request_id"), client.alias("client_id"),
        F.expr("timestamp'2024-01-30 10:00:00'").alias("log_date_time"),
        F.col("id").alias("trans_amt"), F.lit("A").alias("cust_bank_name"),
        F.lit("SUCCESS").alias("message"),
    )
    tables = PaymentTables.of(
        spark, daily_requests=rows, daily_responses=rows,
        client_locations=spark.range(many).select(
            F.col("id").alias("retailer_id"), F.concat(F.lit("X"), F.col("id") % 30).alias("final_state")
        ),
    )
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        states = daily.state_days(tables, [days_before(date(2024, 1, 31), 1)])
        assert sum(row.txns for row in states.collect()) == many - 1  # request 0 has no amount
        assert "SortMergeJoin(skew=true)" in states._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_hot_request_of_many_clients_costs_a_row_per_task_and_state(spark):
    """Two windows, no broadcasts: behind the partial sums the hot id has few rows."""
    row = spark.range(3 * N, numPartitions=8)
    rows = row.select(
        F.when(row.id % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("request_id"),
        F.col("id").alias("client_id"),
        F.when(row.id % 2 == 0, F.expr("timestamp'2024-01-30 10:00:00'"))
        .otherwise(F.expr("timestamp'2024-01-10 10:00:00'")).alias("log_date_time"),
        F.lit(1).alias("trans_amt"), F.lit("A").alias("cust_bank_name"),
        F.lit("SUCCESS").alias("message"),
    )
    tables = PaymentTables.of(
        spark, daily_requests=rows, daily_responses=rows,
        client_locations=spark.range(3 * N).select(
            F.col("id").alias("retailer_id"), F.concat(F.lit("X"), F.col("id") % 30).alias("final_state")
        ),
    )
    windows = [days_before(date(2024, 1, 31), 1), days_before(date(2024, 1, 31), 30, 2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = daily.daily_pairs(tables, windows)
        per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert max(per_task) < 1.5 * sum(per_task) / len(per_task)
        assert daily.total(pairs, ["window"]).agg(F.sum("txns")).first()[0] == 2 * (N // 2) ** 2 + 2 * N
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_authentication_pairs_of_a_hot_request_are_split(spark):
    """One request with many clients and hours: AQE splits the join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    row = spark.range(3 * N, numPartitions=8)
    log = row.select(
        F.when(row.id % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("request_id"),
        F.col("id").alias("client_id"),
        F.when((row.id % 3 != 0) | (row.id % 1000 == 0), F.lit("UPDATE")).otherwise("INSERT").alias("op_name"),
        F.expr("timestamp'2024-01-30 10:00:00'").alias("op_time"),
        F.lit("NSDL").alias("aggregator"), F.lit("00").alias("rc"), F.lit(None).cast("string").alias("rm"),
    )
    log = log.unionByName(log.where("request_id != 0").withColumn("op_name", F.lit("INSERT")))
    tables = PaymentTables.of(spark, bio_log=log)
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        cells = hourly.bio_cells(tables, days_before(date(2024, 1, 31), 1))
        assert cells.count() == 1
        cells.collect()
        assert "SortMergeJoin(skew=true)" in cells._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_rows_are_combined_before_the_shuffle(spark):
    """Every map task sends at most one row for the hot request."""
    requests = frames(spark).txn_requests
    plan = count_copies(requests, ["request_id"])._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.index("partial_count"), plan.index("Exchange")
    assert exchange < partial  # printed top down: the exchange reads the partial counts
