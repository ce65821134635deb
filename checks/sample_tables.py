"""The payment tables, derived from the events, customer and nation test tables.

All moduli are coprime, so the derived dimensions are independent of each other.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.sources.tables import PaymentTables, conform

HOURLY_AS_OF = date(2024, 1, 30)
DAILY_AS_OF = date(2024, 4, 22)
BANK_RANGE = (date(2024, 3, 23), date(2024, 4, 21))

# Read as zoned timestamps (the session is UTC), so that date filters reach the scan.
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


AGGREGATOR = {0: "ybl", 1: "NSDL", 2: "YBLN"}


def _amount() -> Column:
    return F.round(F.col("value") * 100).cast("bigint") * 1000


def _aggregator() -> Column:
    return F.element_at(F.array(*map(F.lit, AGGREGATOR.values())), (F.col("event_id") % 3 + 1).cast("int"))


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _logged() -> Column:
    return F.expr(
        "timestampadd(MINUTE, cast(event_id % 1439 as int),"
        " timestampadd(DAY, cast(event_id % 113 as int), timestamp'2024-01-01 00:00:00'))"
    )


def txn_requests(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("ts").alias("op_time"),
        F.lit("INSERT").alias("op_name"),
        F.col("event_id").alias("request_id"),
        _amount().alias("trans_amt"),
        F.col("user_id").alias("client_id"),
        F.when(F.col("event_type") == "signup", "BE").otherwise("CW").alias("master_trans_type"),
        _nothing().alias("trans_mode"),
        _aggregator().alias("aggregator"),
    )


def txn_responses(ev: DataFrame) -> DataFrame:
    def row(op: str, delay_ms: int, message: Column) -> Column:
        return F.struct(
            F.expr(f"timestampadd(MILLISECOND, {delay_ms}, ts)").alias("op_time"),
            F.lit(op).alias("op_name"),
            F.lit("00").alias("rc"),
            message.alias("message"),
        )

    final = F.when(F.col("event_type") == "error", "FAILED").otherwise("Success")
    rows = F.array(row("INSERT", 0, _nothing()), row("UPDATE", 1000, final))
    stale = F.array(row("UPDATE", 500, F.lit("PENDING")))
    return ev.select(
        F.col("event_id").alias("request_id"),
        _amount().alias("amount"),
        _nothing().alias("response_message"),
        F.inline(F.when(F.col("event_id") % 10 == 0, F.concat(rows, stale)).otherwise(rows)),
    )


def txn_devices(ev: DataFrame) -> DataFrame:
    device = F.array(F.concat(F.lit("DP"), (F.col("event_id") % 5).cast("string")))
    both = F.concat(device, F.array(F.lit("DPX")))
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("op_time"),
        _nothing().alias("rdsid"),
        F.explode(F.when(F.col("event_id") % 50 == 0, both).otherwise(device)).alias("dpid"),
    )


def bio_log(ev: DataFrame) -> DataFrame:
    def row(op: str, delay_s: int, rc: Column) -> Column:
        return F.struct(
            F.expr(f"timestampadd(SECOND, {delay_s}, ts)").alias("op_time"),
            F.lit(op).alias("op_name"),
            rc.alias("rc"),
        )

    accepted = F.get_json_object("props", "$.k").cast("int") >= 20
    answer = F.when(accepted, "00").otherwise("U1")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("client_id"),
        F.upper(_aggregator()).alias("aggregator"),
        _nothing().alias("rm"),
        F.inline(F.array(row("INSERT", 0, _nothing()), row("UPDATE", 2, answer))),
    )


def daily_requests(ev: DataFrame) -> DataFrame:
    free = F.col("event_id") % 29 == 0
    named = F.col("event_id") % 41 != 0
    bank = F.concat(F.lit("BANK_"), (F.col("event_id") % 37).cast("string"))
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("client_id"),
        _logged().alias("log_date_time"),
        F.when(free, F.lit(0).cast("bigint")).otherwise(_amount()).alias("trans_amt"),
        F.when(named, bank).alias("cust_bank_name"),
    )


def daily_responses(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_id").alias("request_id"),
        _logged().alias("log_date_time"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("message"),
    )


# The log tables, each a function of the events, which may be a stream.
LOGS = {
    build.__name__: build
    for build in (
        txn_requests, txn_responses, txn_devices, bio_log, daily_requests, daily_responses
    )
}


def client_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.schema("c_custkey bigint, c_nationkey int").parquet(
        f"{sf_dir}/customer.parquet"
    )
    nation = spark.read.schema("n_nationkey int, n_name string").parquet(f"{sf_dir}/nation.parquet")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("retailer_id"),
        F.when(F.col("c_nationkey") != 24, F.col("n_name")).alias("final_state"),
    )


def sample_tables(spark: SparkSession, sf_dir: str) -> PaymentTables:
    def read(name: str) -> DataFrame:
        if name == "client_locations":
            return conform(client_locations(spark, sf_dir), name)
        return conform(LOGS[name](events(spark, sf_dir)), name)

    return PaymentTables(spark, read)
