"""Hour-of-day health of transactions and of biometric authentication.

The datasets are sorted for reading; ``ordered=False`` leaves the sort, and its
shuffle, out for reports that go on from them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions.flags import band_flag
from railpulse.functions.measures import in_crore, rate, sum_where, times, whole
from railpulse.functions.timeparts import (
    DayRange, days_before, hour_label, hour_start, single_day, within,
)
from railpulse.operators.baseline import Stat, against_history
from railpulse.operators.cdc import INSERT, UPDATE, count_copies, final_outcome
from railpulse.sources.tables import PaymentTables, scan_days

# Aggregators with a rate of their own, response code of a success,
# kind of transaction that is monitored.
AGGREGATORS = ("ybl", "nsdl", "ybln")
BIO_SUCCESS_CODE = "00"
CASH_WITHDRAWAL = "CW"


def _by_hour(df: DataFrame) -> DataFrame:
    """Sort one row per hour: 24 at most, so one task does it without a shuffle."""
    return df.coalesce(1).sortWithinPartitions("hour")


def _day_and_label(cells: DataFrame) -> DataFrame:
    return cells.withColumn("date", F.to_date("hour_ts")).withColumn(
        "hour", hour_label("hour_ts")
    )


def txn_cells(tables: PaymentTables, days: DayRange) -> DataFrame:
    """Cash withdrawals per hour: counts and successful amount.

    A request counts once per INSERT row of its response and per device row. Each
    input is reduced to counted rows per request before the join, so the join has one
    row per request on two of its sides and cannot fan out.
    """
    # Free text that no rate asks for is one group, so an id has four rows an hour at most.
    named = F.lower("aggregator")
    requests = count_copies(
        scan_days(tables.txn_requests, "op_time", days)
        .where(F.col("master_trans_type") == CASH_WITHDRAWAL)
        .select(
            "request_id",
            hour_start("op_time").alias("hour_ts"),
            F.when(named.isin(*AGGREGATORS), named).otherwise("other").alias("aggregator"),
            "trans_amt",
        ),
        ["request_id", "hour_ts", "aggregator"],
        "requests",
        [F.sum(whole(F.col("trans_amt"))).alias("amount")],
    )
    outcomes = final_outcome(
        scan_days(tables.txn_responses, "op_time", days),
        "request_id",
        "op_time",
        F.lower("message") == "success",
    )
    devices = count_copies(
        scan_days(tables.txn_devices, "op_time", days), ["request_id"], "devices"
    )
    copies = times(F.col("inserts"), F.col("devices"))
    joined = (
        outcomes.join(devices, "request_id")
        .join(requests, "request_id")
        .select(
            "hour_ts",
            "aggregator",
            "succeeded",
            times(F.col("requests"), copies).alias("txns"),
            times(F.col("amount"), copies).alias("amount"),
        )
    )
    succeeded = F.col("succeeded")

    def count_of(condition: Column) -> Column:
        return F.coalesce(sum_where(condition, F.col("txns")), F.lit(0))

    measures = [
        sum_where(succeeded, F.col("amount")).alias("success_amount"),
        F.sum("txns").alias("total_txns"),
        count_of(succeeded).alias("success_txns"),
    ]
    for name in AGGREGATORS:
        mine = F.col("aggregator") == name
        measures += [
            count_of(succeeded & mine).alias(f"{name}_success"),
            count_of(mine).alias(f"{name}_total"),
        ]
    return _day_and_label(joined.groupBy("hour_ts").agg(*measures))


def bio_cells(tables: PaymentTables, days: DayRange) -> DataFrame:
    """Authentication attempts per hour of the answer: counts and distinct clients.

    Every INSERT counts with every UPDATE of its request. Distinct clients are
    counted in two steps, per client and then per hour, which needs no row
    expansion however many distinct counts there are.
    """
    log = scan_days(tables.bio_log, "op_time", days)
    kind = (
        F.when(F.col("aggregator") == "NSDL", "nsdl")
        .when(F.col("aggregator").isin("YBL", "YBLN"), "ybl")
        .otherwise("other")
    )
    attempts = count_copies(
        log.where(F.col("op_name") == INSERT).select(
            "request_id", "client_id", kind.alias("kind")
        ),
        ["request_id", "client_id", "kind"],
        "inserts",
    )
    answers = count_copies(
        log.where(F.col("op_name") == UPDATE).select(
            "request_id",
            hour_start("op_time").alias("hour_ts"),
            F.coalesce(F.col("rc") == BIO_SUCCESS_CODE, F.lit(False)).alias("succeeded"),
        ),
        ["request_id", "hour_ts", "succeeded"],
        "updates",
    )
    pairs = attempts.join(answers, "request_id").withColumn(
        "attempts", times(F.col("inserts"), F.col("updates"))
    )
    succeeded = F.col("succeeded")

    def seen(condition: Column) -> Column:
        return F.max(condition.cast("int"))

    by_client = pairs.groupBy("hour_ts", "client_id").agg(
        F.sum("attempts").alias("attempts"),
        F.coalesce(sum_where(succeeded, F.col("attempts")), F.lit(0)).alias("successes"),
        seen(succeeded).alias("any_success"),
        *[
            column
            for name in ("nsdl", "ybl")
            for column in (
                seen(F.col("kind") == name).alias(name),
                seen((F.col("kind") == name) & succeeded).alias(f"{name}_success"),
            )
        ],
    )
    known = F.col("client_id").isNotNull()

    def total(column: str) -> Column:
        return F.sum(F.when(known, F.col(column)).otherwise(0)).alias(column)

    columns = ("attempts", "successes", "any_success", "nsdl", "nsdl_success", "ybl", "ybl_success")
    return _day_and_label(by_client.groupBy("hour_ts").agg(*[total(c) for c in columns]))


def txn_hourly_median(tables: PaymentTables, as_of: date, ordered: bool = True) -> DataFrame:
    """Today's hours against 7-day medians; rate flag at median ± 1 σ of the population.

    Center and spread are rounded before they are compared. Hours seen only in the
    history are listed with an empty current side.
    """
    past = days_before(as_of, 7)
    cells = txn_cells(tables, DayRange(past.first, as_of))
    rates = {
        "overall_success_rate": ("success_txns", "total_txns"),
        **{f"{a}_success_rate": (f"{a}_success", f"{a}_total") for a in AGGREGATORS},
    }
    amount = in_crore(F.col("success_amount"))
    today = {
        "date": F.col("date"),
        "total_amount_cr": amount,
        "success_txns": F.col("success_txns"),
        **{n: rate(F.col(s), F.col(t), digits=2) for n, (s, t) in rates.items()},
    }
    exact = {n: rate(F.col(part), F.col(whole)) for n, (part, whole) in rates.items()}
    history = {
        "median_amount_cr": Stat(amount, "median", 2),
        "median_success_txns": Stat(F.col("success_txns").cast("double"), "median", 0),
        "stddev_success_rate": Stat(exact["overall_success_rate"], "pop", 2),
        **{
            f"median_{name.removeprefix('overall_')}": Stat(value, "median", 2)
            for name, value in exact.items()
        },
    }
    day = F.col("date")
    out = against_history(
        cells, "hour", within(day, single_day(as_of)), within(day, past), today, history
    )
    out = out.select(
        "date",
        "hour",
        *[c for c in today if c != "date"],
        "median_amount_cr",
        "median_success_txns",
        "median_success_rate",
        *[f"median_{a}_success_rate" for a in AGGREGATORS],
        band_flag(
            F.col("overall_success_rate"),
            F.col("median_success_rate"),
            F.col("stddev_success_rate"),
            low="lower anomaly ↓",
            high="upper anomaly ↑",
        ).alias("success_rate_anomaly"),
    )
    return _by_hour(out) if ordered else out


def txn_hourly_health(
    tables: PaymentTables, as_of: date, k: float = 2.0, ordered: bool = True
) -> DataFrame:
    """Hours seen today against 7-day means; rate and value flags at mean ± k σ.

    Rates are rounded, and 0 where there is nothing to count, before they are averaged.
    """
    past = days_before(as_of, 7)
    cells = txn_cells(tables, DayRange(past.first, as_of))

    def rounded(part: str, whole: str) -> Column:
        return rate(F.col(part), F.col(whole), digits=2, empty=0.0)

    overall = rounded("success_txns", "total_txns")
    amount = in_crore(F.col("success_amount"))
    day = F.col("date")
    out = against_history(
        cells,
        "hour",
        within(day, single_day(as_of)),
        within(day, past),
        {
            "overall_success_rate": overall,
            "total_amount_cr": amount,
            "total_txns": F.col("total_txns"),
            "success_txns": F.col("success_txns"),
            **{f"{a}_success_rate": rounded(f"{a}_success", f"{a}_total") for a in AGGREGATORS},
        },
        {
            "avg_success_rate": Stat(overall, "mean"),
            "stddev_success_rate": Stat(overall, "samp"),
            "avg_amount_cr": Stat(amount, "mean"),
            "stddev_amount_cr": Stat(amount, "samp"),
        },
        only_today=True,
    )

    def flag(value: str, what: str) -> Column:
        return band_flag(F.col(value), F.col(f"avg_{what}"), F.col(f"stddev_{what}"), k)

    out = out.select(
        "*",
        flag("overall_success_rate", "success_rate").alias("success_rate_anomaly"),
        flag("total_amount_cr", "amount_cr").alias("amount_cr_anomaly"),
    )
    return _by_hour(out) if ordered else out


def _bio_hourly(
    tables: PaymentTables, as_of: date, depth: int, normal: str, missing: str | None,
    with_counts: bool, ordered: bool,
) -> DataFrame:
    past = days_before(as_of, depth)
    cells = bio_cells(tables, DayRange(past.first, as_of))
    rates = {
        "fa2_succ_rate": ("successes", "attempts", 100.0),
        "fa2_succ_rate_nsdl": ("nsdl_success", "nsdl", 100.0),
        "fa2_succ_rate_ybl": ("ybl_success", "ybl", 100.0),
        "fa2_per_user_rate": ("successes", "any_success", 1.0),
    }
    shown = {
        "fa2_succ_rate": "fa2_rate_yesterday",
        "fa2_succ_rate_nsdl": "nsdl_rate_yesterday",
        "fa2_succ_rate_ybl": "ybl_rate_yesterday",
        "fa2_per_user_rate": "per_user_rate_yesterday",
    }

    def of(name: str, digits: int | None = None) -> Column:
        part, whole, scale = rates[name]
        return rate(F.col(part), F.col(whole), scale, digits)

    exact = {name: of(name) for name in rates}
    day = F.col("date")
    out = against_history(
        cells,
        "hour",
        within(day, single_day(as_of)),
        within(day, past),
        {
            "date": day,
            "total_attempts": F.col("attempts"),
            "successful_attempts": F.col("successes"),
            **{shown[name]: of(name, 2) for name in rates},
        },
        {
            **{f"median_{name}": Stat(value, "median", 2) for name, value in exact.items()},
            "stddev_succ_rate": Stat(exact["fa2_succ_rate"], "samp"),
        },
    )
    flag = band_flag(
        F.col("fa2_rate_yesterday"),
        F.col("median_fa2_succ_rate"),
        F.col("stddev_succ_rate"),
        low="Lower Anomaly ↓",
        high="Upper Anomaly ↑",
        normal=normal,
        missing=missing,
    )
    columns = ["date", "hour"]
    for name in rates:
        columns += [shown[name], f"median_{name}"]
    if with_counts:
        columns += ["total_attempts", "successful_attempts"]
    out = out.select(*columns, flag.alias("fa2_succ_flag"))
    return _by_hour(out) if ordered else out


def bio_hourly_8d(tables: PaymentTables, as_of: date, ordered: bool = True) -> DataFrame:
    """Authentication hours against 8-day medians; hours without answers are ``No Data``."""
    return _bio_hourly(tables, as_of, 8, "Normal", "No Data", False, ordered)


def bio_hourly_health(tables: PaymentTables, as_of: date, ordered: bool = True) -> DataFrame:
    """Authentication hours with counts against 7-day medians, flagged at ± 1 σ."""
    return _bio_hourly(tables, as_of, 7, "normal", None, True, ordered)
