"""Hourly metrics over the change log as it arrives.

The functions take streaming or static frames and give the same rows for closed
hours. On streams rows later than ``delay`` are dropped and hours are emitted once
they are closed (append mode).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from railpulse.functions.measures import in_crore, sum_where, whole
from railpulse.operators.cdc import UPDATE
from railpulse.plans.hourly import AGGREGATORS, CASH_WITHDRAWAL
from railpulse.sources.tables import SCHEMAS

# Fixed value: the established refresh interval.
REFRESH = "5 minutes"


def read_stream(
    spark: SparkSession, path: str, table: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Follow a folder of Parquet files of one of the log tables."""
    reader = spark.readStream.schema(SCHEMAS[table])
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def latest_update(responses: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The last UPDATE of every request per hour; of equal times the greater message, as in ``latest_by``.

    One row per request, whatever the hour, is ``latest.latest_per_request``.
    """
    return (
        responses.where(F.col("op_name") == UPDATE)
        .withWatermark("op_time", delay)
        .groupBy(F.window("op_time", "1 hour"), "request_id")
        .agg(F.max(F.struct("op_time", "message")).alias("last"))
        .select(
            F.col("window.start").alias("hour_start"), "request_id", "last.message",
            F.col("last.op_time").alias("last_time"),
        )
    )


def hourly_metrics(
    requests: DataFrame,
    responses: DataFrame,
    delay: str = "10 minutes",
    answer_hours: int | None = None,
) -> DataFrame:
    """Cash withdrawals per hour of the request: counts, successes and amount by aggregator.

    The earliest row of a request in an hour counts; a repeat in another hour counts there.
    The latest UPDATE at or after the request decides. Both sides are reduced to one row per
    hour and request, combined map-side, before they are joined, so an id that repeats costs
    each map task a row. A stream has to forget: it needs ``answer_hours``, the number of hours
    after the request's own whose answers still count (0: its own hour alone), and emits an
    hour once those are closed as well; without it, as in the batch form, all answers count.
    """
    if answer_hours is None and (requests.isStreaming or responses.isStreaming):
        raise ValueError("a stream needs answer_hours, the bound on its state")
    hour = F.window("op_time", "1 hour")
    asked = (
        requests.where(F.col("master_trans_type") == CASH_WITHDRAWAL)
        .withWatermark("op_time", delay)
        .groupBy(hour.alias("hour"), "request_id")
        .agg(F.min(F.struct("op_time", F.lower("aggregator").alias("aggregator"), "trans_amt")).alias("first"))
        .select(F.window_time("hour").alias("asked_in"), "request_id", "first")
    )
    succeeded = F.coalesce(F.lower("message") == "success", F.lit(False))
    answered = (
        responses.where(F.col("op_name") == UPDATE)
        .withWatermark("op_time", delay)
        .groupBy(hour.alias("hour"), F.col("request_id").alias("answer_id"))
        .agg(F.max(F.struct("op_time", succeeded.alias("succeeded"))).alias("last"))
        .select(F.window_time("hour").alias("answered_in"), "answer_id", "last")
    )
    in_time = (
        (F.col("request_id") == F.col("answer_id"))
        & (F.col("answered_in") >= F.col("asked_in"))
        & (F.col("last.op_time") >= F.col("first.op_time"))
    )
    if answer_hours is not None:
        in_time &= F.col("answered_in") <= F.col("asked_in") + F.expr(f"INTERVAL {answer_hours} HOURS")
    outcome = (
        asked.join(answered, in_time)
        .groupBy(F.window("asked_in", "1 hour"), "request_id", "first")
        .agg(F.max("last").alias("last"))
        .select(
            "window", F.col("first.aggregator").alias("aggregator"),
            F.col("first.trans_amt").alias("trans_amt"), F.col("last.succeeded").alias("succeeded"),
        )
    )

    succeeded = F.col("succeeded")

    def measures(prefix: str, mine: Column) -> list[Column]:
        return [
            F.count_if(mine).alias(f"{prefix}_txns"),
            F.count_if(mine & succeeded).alias(f"{prefix}_success"),
            in_crore(
                F.coalesce(sum_where(mine & succeeded, whole(F.col("trans_amt"))), F.lit(0))
            ).alias(f"{prefix}_gtv"),
        ]

    columns = measures("total", F.lit(True))
    for name in AGGREGATORS:
        columns += measures(name, F.col("aggregator") == name)
    hours = outcome.groupBy(F.window("window", "1 hour").alias("hour")).agg(*columns)
    return hours.select(F.col("hour.start").alias("hour_start"), *hours.columns[1:])


def active_users(bio_log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Number of distinct clients per hour, exact: one row of state per client and open hour."""
    clients = (
        bio_log.where(F.col("client_id").isNotNull())
        .withWatermark("op_time", delay)
        .groupBy(F.window("op_time", "1 hour"), "client_id").agg(F.count(F.lit(1)).alias("rows"))
    )
    return (
        clients.groupBy(F.window("window", "1 hour").alias("hour"))
        .agg(F.count(F.lit(1)).alias("active_users"))
        .select(F.col("hour.start").alias("hour_start"), "active_users")
    )


@contextmanager
def _settings(
    spark: SparkSession, partitions: int | None, settings: Mapping[str, str] | None
) -> Iterator[None]:
    """Session settings that a query takes over when it starts."""
    wanted = dict(settings or {})
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def start(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = REFRESH,
    partitions: int | None = None,
    settings: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Write closed hours to Parquet every ``every``; with None take what is there and stop.

    ``partitions`` is the number of state partitions, by default the session's number
    of shuffle partitions. It stays as it was when the checkpoint was begun. ``settings`` hold
    for this query alone, such as the state store it needs.
    """
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if every is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=every)
    with _settings(stream.sparkSession, partitions, settings):
        return writer.format("parquet").start(path)
