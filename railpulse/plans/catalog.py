"""Named datasets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame

from railpulse.plans import daily, hourly
from railpulse.session import require_utc
from railpulse.sources.tables import PaymentTables

DATASETS: dict[str, Callable[..., DataFrame]] = {
    "txn_hourly_median": hourly.txn_hourly_median,
    "txn_hourly_health": hourly.txn_hourly_health,
    "bio_hourly_8d": hourly.bio_hourly_8d,
    "bio_hourly_health": hourly.bio_hourly_health,
    "state_metrics": daily.state_metrics,
    "state_10d_trend": daily.state_10d_trend,
    "state_30d_trend": daily.state_30d_trend,
    "bank_yesterday": daily.bank_yesterday,
    "bank_yesterday_by_state": daily.bank_yesterday_by_state,
    "bank_state_90d_trend": daily.bank_state_90d_trend,
}

# Other names the same datasets are asked for by.
ALIASES = {
    "transaction_success": "txn_hourly_health",
    "bio_authentication": "bio_hourly_health",
    "bio_auth_success": "bio_hourly_8d",
}


def today_utc() -> date:
    return datetime.now(timezone.utc).date()


def dataset(
    name: str,
    tables: PaymentTables,
    as_of: date | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Build a named dataset; an unknown name raises ``KeyError``.

    ``as_of`` is today (UTC) unless given. ``bank_health`` takes a range of days
    instead, by default the last 30 days up to ``as_of``.
    """
    require_utc(tables.spark)
    as_of = as_of or today_utc()
    if name == "bank_health":
        end = end or as_of
        return daily.bank_health(tables, start or as_of - timedelta(days=30), end)
    key = ALIASES.get(name, name)
    if key not in DATASETS:
        raise KeyError(f"unknown dataset: {name}")
    return DATASETS[key](tables, as_of)


def query_days(
    tables: PaymentTables, text: str, days: Mapping[str, date], *names: str
) -> DataFrame:
    """Run SQL over the named tables (all by default) with ``:name`` markers bound to dates."""
    tables.as_views(*names)
    return tables.spark.sql(text, args=dict(days))
