"""CSV export."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from railpulse.sources.files import publish_csv


def export_path(root: str, name: str, as_of: date, compact_date: bool = False) -> str:
    stamp = as_of.strftime("%Y%m%d") if compact_date else as_of.isoformat()
    return f"{root}/{name}_{stamp}.csv"


def export_csv(
    df: DataFrame, root: str, name: str, as_of: date, compact_date: bool = False, single: bool = False
) -> str:
    """Write ``df`` as CSV with a header under ``<root>/<name>_<date>.csv`` and return the path.

    The target is a folder, as Spark writers make it: every task writes its own part. With ``single`` it
    is one file, which replaces an older one when it is complete.
    """
    path = export_path(root, name, as_of, compact_date)
    if single:
        return publish_csv(df, path)
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_hourly(txn: DataFrame, bio: DataFrame, root: str, as_of: date) -> list[str]:
    """Both hourly datasets, each as one file."""
    return [
        export_csv(txn, root, "transaction_data", as_of, single=True),
        export_csv(bio, root, "bio_auth_data", as_of, single=True),
    ]


def export_states(filtered: DataFrame, states: DataFrame, root: str, as_of: date) -> list[str]:
    """The filtered and the full state table, each as one file."""
    return [
        export_csv(filtered, root, "state_metrics", as_of, compact_date=True, single=True),
        export_csv(states, root, "state_metrics_all", as_of, compact_date=True, single=True),
    ]
