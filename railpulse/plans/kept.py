"""The daily state fact in storage, kept up to date by the days that new rows touch.

The fact is partitioned by the day of the request. An answer may come days after its request, so a day
changes when requests of that day arrive, or answers to them on any day. Only such days are computed
again and replaced; the others stay as they are, and a 90-day page reads the fact instead of 90 days of logs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.timeparts import DayRange, within
from railpulse.plans import daily
from railpulse.sources.tables import PaymentTables, scan_days

_FACT = "answer_day date, final_state string, txns decimal(38,0), successes decimal(38,0), success_amount decimal(38,0), day date"

# Datasets that the fact answers, from (fact, as_of).
FROM_FACT: dict[str, Callable[[DataFrame, date], DataFrame]] = {
    "state_metrics": daily.state_metrics_from_fact,
    "state_10d_trend": lambda fact, as_of: daily.state_trend_from_fact(fact, as_of, 10),
    "state_30d_trend": lambda fact, as_of: daily.state_trend_from_fact(fact, as_of, 30),
    "bank_state_90d_trend": lambda fact, as_of: daily.as_percentage(
        daily.state_trend_from_fact(fact, as_of, 90)
    ),
}


def touched_days(tables: PaymentTables, new: PaymentTables, days: DayRange) -> list[date]:
    """The days of requests, at most those of ``days``, whose totals new rows may change.

    ``tables`` are all logs, the new rows included; ``new`` has the new rows alone. Of the old
    requests only ids and times are read.
    """
    day = F.to_date("log_date_time").alias("day")
    asked = scan_days(new.daily_requests, "log_date_time", days).select(day)
    answered = scan_days(new.daily_responses, "log_date_time", days).select("request_id").distinct()
    late = scan_days(tables.daily_requests, "log_date_time", days).join(answered, "request_id", "left_semi").select(day)
    found = asked.union(late).distinct().collect()  # a row per day of the range at most
    return sorted(row.day for row in found)


class KeptFact:
    """A daily state fact under ``path``, one partition per day of request."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _replace(self, fact: DataFrame) -> None:
        # A day has one row per state and day of answer; a few days fill one task.
        (
            fact.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("day").parquet(self.path)
        )

    def build(self, tables: PaymentTables, days: DayRange) -> None:
        """Compute all of ``days``."""
        self._replace(daily.daily_state_fact(tables, days))

    def refresh(self, tables: PaymentTables, new: PaymentTables, days: DayRange) -> list[date]:
        """Bring the fact up to date with the rows of ``new`` and return the days that were replaced.

        Running it again changes nothing. Rows are only ever added to the logs; if clients
        move to other states, or rows go, ``build`` the days again.
        """
        touched = touched_days(tables, new, days)
        if touched:
            self._replace(daily.daily_state_fact(tables, days, touched))
        return touched

    def read(self, days: DayRange | None = None) -> DataFrame:
        fact = self.spark.read.schema(_FACT).parquet(self.path)
        if days is not None:
            fact = fact.where(within(F.col("day"), days) & within(F.col("answer_day"), days))
        return fact.select("day", "answer_day", "final_state", "txns", "successes", "success_amount")

    def dataset(self, name: str, as_of: date) -> DataFrame:
        """One of the datasets of ``FROM_FACT``, equal to the one from the logs."""
        days = DayRange(as_of - timedelta(days=90), as_of)
        return FROM_FACT[name](self.read(days), as_of)

