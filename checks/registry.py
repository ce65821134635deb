"""The checked queries: every dataset, report and building block over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.sample_tables import (
    BANK_RANGE, DAILY_AS_OF, EVENTS, HOURLY_AS_OF, LOGS, sample_tables,
)
from railpulse.functions.measures import median_of
from railpulse.functions.timeparts import DayRange, days_before
from railpulse.operators.cdc import cdc_pair, latest_by
from railpulse.operators.durable import checkpoint_dir, keep
from railpulse.plans import banks, daily, hourly, overview, states, statistics
from railpulse.plans.catalog import dataset, query_days
from railpulse.plans.kept import KeptFact
from railpulse.session import configure
from railpulse.sources.export import export_hourly, export_states
from railpulse.streaming import hourly as live
from railpulse.streaming import latest, pages
from railpulse.sources.tables import SCHEMAS, PaymentTables, scan_days

Query = Callable[[SparkSession, str], DataFrame]

HOURLY_DAYS = DayRange(days_before(HOURLY_AS_OF, 7).first, HOURLY_AS_OF)
NINETY_DAYS = days_before(DAILY_AS_OF, 90)
DETAIL_STATE = "NATION_10"


def settled(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round floating-point columns, whose last bits depend on the engine, and give whole
    numbers the 64 bits they have in SQL; one that does not fit is an error."""

    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, digits)
        elif isinstance(field.dataType, T.DecimalType) and field.dataType.scale == 0:
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select([plain(f) for f in df.schema.fields])


def _new_folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}/{uuid4().hex}"


def _on_tables(build: Callable[[PaymentTables], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settled(build(sample_tables(configure(spark), sf_dir)))

    return query


def _q1(t: PaymentTables) -> DataFrame:
    return hourly.txn_hourly_median(t, HOURLY_AS_OF, ordered=False)


def _q2(t: PaymentTables) -> DataFrame:
    return hourly.bio_hourly_8d(t, HOURLY_AS_OF, ordered=False)


def _q3(t: PaymentTables) -> DataFrame:
    return hourly.txn_hourly_health(t, HOURLY_AS_OF, ordered=False)


def _q4(t: PaymentTables) -> DataFrame:
    return hourly.bio_hourly_health(t, HOURLY_AS_OF, ordered=False)


def _states(t: PaymentTables) -> DataFrame:
    return daily.state_metrics(t, DAILY_AS_OF, ordered=False)


def _trend(depth: int) -> Callable[[PaymentTables], DataFrame]:
    return lambda t: daily.state_trend(t, DAILY_AS_OF, depth, ordered=False)


def _by_state(t: PaymentTables) -> DataFrame:
    return daily.bank_yesterday_by_state(t, DAILY_AS_OF, ordered=False)


def _state_detail(t: PaymentTables) -> DataFrame:
    fact = keep(daily.daily_state_fact(t, NINETY_DAYS))
    return states.state_detail(
        daily.state_trend_from_fact(fact, DAILY_AS_OF, 30, ordered=False),
        daily.state_metrics_from_fact(fact, DAILY_AS_OF, ordered=False),
        DETAIL_STATE,
    )


def _hourly_log(t: PaymentTables) -> DataFrame:
    return scan_days(t.txn_responses, "op_time", HOURLY_DAYS)


def _latest_update(t: PaymentTables) -> DataFrame:
    updates = _hourly_log(t).where("op_name = 'UPDATE'")
    return latest_by(updates, ["request_id"], "op_time", ["message"]).select(
        "request_id", F.unix_micros("op_time").alias("op_micros"), "message"
    )


def _cdc_pairs(t: PaymentTables) -> DataFrame:
    return cdc_pair(
        _hourly_log(t), "request_id", {"rc": "rc"}, {"message": "message"},
        latest_update="op_time", ties=["message"],
    )


def _cdc_all_pairs(t: PaymentTables) -> DataFrame:
    return cdc_pair(_hourly_log(t), "request_id", {"rc": "rc"}, {"message": "message"})


def _bound_dates(t: PaymentTables) -> DataFrame:
    text = """
        SELECT cust_bank_name, count(*) AS requests, sum(trans_amt) AS amount
        FROM daily_requests
        WHERE to_date(log_date_time) BETWEEN :start_date AND :end_date
        GROUP BY cust_bank_name
    """
    days = {"start_date": BANK_RANGE[0], "end_date": BANK_RANGE[1]}
    return query_days(t, text, days, "daily_requests")


def _table_counts(t: PaymentTables) -> DataFrame:
    """Rows and distinct keys of every source table."""
    parts = []
    for name in SCHEMAS:
        df = getattr(t, name)
        key = "retailer_id" if name == "client_locations" else "request_id"
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_key.agg(F.sum("n").alias("row_count"), F.count(key).alias("distinct_keys"))
            .select(F.lit(name).alias("table_name"), "row_count", "distinct_keys")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _csv_hourly(t: PaymentTables) -> DataFrame:
    """Both hourly exports, written and read back."""
    spark = t.spark
    txn, bio = keep(_q3(t)), keep(_q4(t))
    paths = export_hourly(txn, bio, _new_folder(spark, "exports"), HOURLY_AS_OF)
    txn_back, bio_back = (
        spark.read.schema(df.schema).option("header", True).csv(path)
        for df, path in zip((txn, bio), paths)
    )
    return txn_back.select(
        F.lit("txn").alias("source"), "hour", F.col("success_rate_anomaly").alias("flag"),
        F.col("overall_success_rate").alias("rate"),
    ).unionByName(
        bio_back.select(
            F.lit("bio").alias("source"), "hour", F.col("fa2_succ_flag").alias("flag"),
            F.col("fa2_rate_yesterday").alias("rate"),
        )
    )


def _csv_states(t: PaymentTables) -> DataFrame:
    """The filtered and the full state export, written and read back."""
    spark = t.spark
    full = keep(_states(t))
    filtered = states.filter_states(full, min_gtv=1.0, only_active=True)
    paths = export_states(filtered, full, _new_folder(spark, "exports"), DAILY_AS_OF)
    few, every = (
        spark.read.schema(full.schema).option("header", True).csv(path) for path in paths
    )
    return every.withColumn("export", F.lit("all")).unionByName(
        few.withColumn("export", F.lit("filtered"))
    )


def _arrived(t: PaymentTables, late: bool) -> PaymentTables:
    """The daily logs without the rows that arrive late, or these alone."""
    recent = F.to_date("log_date_time") >= F.lit(days_before(DAILY_AS_OF, 3).first)
    rule = {
        "daily_requests": (F.col("request_id") % 13 == 0) & recent,
        "daily_responses": F.col("request_id") % 101 == 0,
    }

    def read(name: str) -> DataFrame:
        df = getattr(t, name)
        return df.where(rule[name] if late else ~rule[name]) if name in rule else df

    return PaymentTables(t.spark, read)


def _kept(name: str) -> Callable[[PaymentTables], DataFrame]:
    """A dataset from a stored fact that late rows have been added to."""
    def build(t: PaymentTables) -> DataFrame:
        fact = KeptFact(t.spark, _new_folder(t.spark, "facts"))
        fact.build(_arrived(t, late=False), NINETY_DAYS)
        fact.refresh(t, _arrived(t, late=True), NINETY_DAYS)
        return fact.dataset(name, DAILY_AS_OF)

    return build


def _users_from_sketches(t: PaymentTables) -> DataFrame:
    """Distinct clients by day, exact, and whether 24 stored hourly sketches give them within 3 percent."""
    path = _new_folder(t.spark, "sketches")
    statistics.write_sketches(statistics.user_sketches(t, HOURLY_DAYS), path)
    about = statistics.distinct_users(t.spark.read.parquet(path)).withColumnRenamed("day", "d")
    exact = scan_days(t.bio_log, "op_time", HOURLY_DAYS).groupBy(F.to_date("op_time").alias("day")).agg(
        F.count_distinct("client_id").alias("clients")
    )
    near = F.abs(F.col("users") - F.col("clients")) <= 0.03 * F.col("clients")
    return exact.join(about, F.col("day") == F.col("d")).select("day", "clients", near.alias("near"))


def _coverage_observed(t: PaymentTables) -> DataFrame:
    coverage, path = statistics.Coverage(), _new_folder(t.spark, "pages")
    for name, df in zip(("txn", "bio"), coverage.watch(_q3(t), _q4(t))):
        df.write.parquet(f"{path}/{name}")
    return coverage.result(t.spark)


_ON_TABLES: dict[str, Callable[[PaymentTables], DataFrame]] = {
    # named datasets
    "txn_hourly_median": lambda t: dataset("txn_hourly_median", t, HOURLY_AS_OF),
    "bio_hourly_8d": lambda t: dataset("bio_hourly_8d", t, HOURLY_AS_OF),
    "txn_hourly_health": lambda t: dataset("txn_hourly_health", t, HOURLY_AS_OF),
    "bio_hourly_health": lambda t: dataset("bio_hourly_health", t, HOURLY_AS_OF),
    "state_metrics": lambda t: dataset("state_metrics", t, DAILY_AS_OF),
    "state_10d_trend": lambda t: dataset("state_10d_trend", t, DAILY_AS_OF),
    "state_30d_trend": lambda t: dataset("state_30d_trend", t, DAILY_AS_OF),
    "bank_health": lambda t: dataset("bank_health", t, start=BANK_RANGE[0], end=BANK_RANGE[1]),
    "bank_yesterday": lambda t: dataset("bank_yesterday", t, DAILY_AS_OF),
    "bank_yesterday_by_state": lambda t: dataset("bank_yesterday_by_state", t, DAILY_AS_OF),
    "bank_state_90d_trend": lambda t: dataset("bank_state_90d_trend", t, DAILY_AS_OF),
    # facts and building blocks
    "table_counts": _table_counts,
    "date_scan": lambda t: scan_days(t.txn_requests, "op_time", HOURLY_DAYS).select(
        "request_id", "client_id", "trans_amt", "aggregator"
    ),
    "approx_medians": lambda t: daily.state_days(t, [NINETY_DAYS]).groupBy("final_state").agg(
        median_of("success_amount", exact=False).alias("median_amount"),
        median_of("txns", exact=False).alias("median_txns"),
    ),
    "txn_cells": lambda t: hourly.txn_cells(t, HOURLY_DAYS).drop("hour_ts"),
    "bio_cells": lambda t: hourly.bio_cells(t, HOURLY_DAYS).drop("hour_ts"),
    "latest_update": _latest_update,
    "cdc_pairs": _cdc_pairs,
    "cdc_all_pairs": _cdc_all_pairs,
    "daily_state_fact": lambda t: daily.daily_state_fact(t, NINETY_DAYS),
    "daily_bank_fact": lambda t: daily.daily_bank_fact(t, DayRange(*BANK_RANGE)),
    "state_metrics_from_fact": lambda t: daily.state_metrics_from_fact(
        daily.daily_state_fact(t, NINETY_DAYS), DAILY_AS_OF
    ),
    "state_metrics_per_day": lambda t: daily.state_metrics(t, DAILY_AS_OF, per_day=True),
    "bound_dates": _bound_dates,
    **{f"kept_{name}": _kept(name) for name in (
        "state_metrics", "state_10d_trend", "state_30d_trend", "bank_state_90d_trend",
    )},
    # in rupees: the last digits of eight decimals are beyond a double here
    "amount_statistics": lambda t: settled(statistics.amount_statistics(t, HOURLY_DAYS), 3),
    "users_from_sketches": _users_from_sketches,
    "data_coverage_observed": _coverage_observed,
    "csv_hourly": _csv_hourly,
    "csv_states": _csv_states,
    # overview reports
    "health_score": lambda t: overview.health_score(_q3(t), _q4(t)),
    "health_bands": lambda t: overview.health_bands(_q3(t), _q4(t)),
    "health_bands_basic": lambda t: overview.health_bands(
        _q1(t), _q2(t), overview.BASIC_BIO_LIMITS
    ),
    "gtv_pace": lambda t: overview.gtv_pace(_q1(t)),
    "anomaly_count": lambda t: overview.anomaly_count(_q1(t), _q2(t)),
    "aggregator_means": lambda t: overview.aggregator_means(_q3(t), _q4(t)),
    "txn_totals": lambda t: overview.txn_totals(_q3(t)),
    "bio_totals": lambda t: overview.bio_totals(_q4(t)),
    "data_coverage": lambda t: overview.data_coverage(_q3(t), _q4(t)),
    "hour_range": lambda t: overview.hour_range(_q3(t), 9, 17),
    "txn_anomalies": lambda t: overview.txn_anomalies(_q3(t)),
    "bio_anomalies": lambda t: overview.bio_anomalies(_q4(t)),
    "bio_anomalies_basic": lambda t: overview.bio_anomalies(_q2(t), keep_no_data=True),
    "gtv_anomaly_k": lambda t: overview.gtv_anomaly_k(_q3(t), 1.0),
    "volume_status": lambda t: overview.volume_status(_q3(t)),
    "failed_txns": lambda t: overview.failed_txns(_q3(t)),
    "failed_summary": lambda t: overview.failed_summary(_q3(t)),
    "success_range": lambda t: overview.success_range(_q3(t)),
    "txn_detail": lambda t: overview.txn_detail(_q3(t)),
    "bio_detail": lambda t: overview.bio_detail(_q4(t)),
    "aggregator_long": lambda t: overview.aggregator_long(_q3(t), overview.TXN_SERIES),
    "bio_aggregator_long": lambda t: overview.aggregator_long(
        _q4(t), overview.BIO_SERIES, ["NSDL"]
    ),
    "txn_vs_mean_series": lambda t: overview.current_vs_baseline(_q3(t), overview.HEALTH_PAIRS),
    "txn_vs_median_series": lambda t: overview.current_vs_baseline(_q1(t), overview.MEDIAN_PAIRS),
    "bio_vs_median_series": lambda t: overview.current_vs_baseline(_q4(t), overview.BIO_PAIRS),
    # state reports
    "top_gainers": lambda t: states.top_gainers(_states(t)),
    "top_decliners": lambda t: states.top_decliners(_states(t)),
    "gainer_table": lambda t: states.mover_table(states.top_gainers(_states(t))),
    "share_table": lambda t: states.share_table(keep(_states(t))),
    "top10_state_trend": lambda t: states.top_state_trend(_trend(10)(t)),
    "available_states": lambda t: states.available_states(_trend(10)(t)),
    "state_detail_30d": _state_detail,
    "state_summary": lambda t: states.state_summary(_states(t)),
    "top_states": lambda t: states.top_states(_states(t)),
    "state_share_others": lambda t: states.state_share_others(keep(_states(t))),
    "state_variation": lambda t: states.state_variation(_states(t)),
    "above_median": lambda t: states.above_median(_states(t)),
    "below_median": lambda t: states.below_median(_states(t)),
    "state_threshold": lambda t: states.state_threshold(_states(t)),
    "below_one_sigma": lambda t: states.below_one_sigma(_states(t)),
    "above_one_sigma": lambda t: states.above_one_sigma(_states(t)),
    "state_filter": lambda t: states.filter_states(
        _states(t), min_gtv=1.0, min_success=75.0, only_active=True
    ),
    "state_table": lambda t: states.state_table(_states(t)),
    # bank reports
    "bank_table": lambda t: banks.bank_table(daily.bank_yesterday(t, DAILY_AS_OF)),
    "default_state_banks": lambda t: banks.state_banks(keep(_by_state(t))),
    "state_90d_series": lambda t: banks.state_90d_series(
        daily.bank_state_90d_trend(t, DAILY_AS_OF, ordered=False), _by_state(t)
    ),
}


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir)


def _streamed(
    build: Callable[[Callable[[], DataFrame]], DataFrame], settings: dict[str, str] | None = None
) -> Query:
    """Run a streaming query over all events to its end and read what it wrote."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        run = _new_folder(spark, "streams")
        stream = build(lambda: _event_stream(spark, sf_dir))
        live.start(
            stream, f"{run}/rows", f"{run}/progress", every=None, settings=settings
        ).awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(f"{run}/rows")
        if "hour_start" in rows.columns:
            rows = rows.withColumn("hour_start", F.date_format("hour_start", "yyyy-MM-dd HH:mm"))
        return settled(rows)

    return query


_STREAMED: dict[str, Callable[[Callable[[], DataFrame]], DataFrame]] = {
    "stream_hourly_metrics": lambda ev: live.hourly_metrics(
        LOGS["txn_requests"](ev()), LOGS["txn_responses"](ev()), answer_hours=1
    ),
    "stream_hourly_latest_update": lambda ev: live.latest_update(LOGS["txn_responses"](ev())).drop(
        "last_time"
    ),
    "stream_active_users": lambda ev: live.active_users(LOGS["bio_log"](ev())),
}

def _latest(ev: Callable[[], DataFrame]) -> DataFrame:
    answers = latest.latest_per_request(LOGS["txn_responses"](ev()))
    return answers.withColumn("op_micros", F.unix_micros("last_time")).drop("last_time")


def _page(name: str) -> Query:
    """A page refreshed by a stream of all logs, as it stands after the last batch."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        run = _new_folder(spark, "pages")
        logs = {log: LOGS[log](_event_stream(spark, sf_dir)) for log in pages.PAGE_LOGS}
        pages.start_pages(logs, run, f"{run}/progress", HOURLY_AS_OF, every=None).awaitTermination()
        return settled(pages.current_page(spark, run, name))

    return query


QUERIES: dict[str, Query] = {name: _on_tables(build) for name, build in _ON_TABLES.items()}
QUERIES |= {name: _streamed(build) for name, build in _STREAMED.items()}
QUERIES["stream_latest_update"] = _streamed(_latest, latest.KEYED_STATE)
QUERIES |= {
    "stream_txn_page": _page("txn_hourly_health"), "stream_bio_page": _page("bio_hourly_health"),
}
