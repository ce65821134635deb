"""Shares of a total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.functions.measures import safe_ratio


def fold_small(
    df: DataFrame,
    key: str,
    value: str,
    min_share: float,
    label: str = "Others (%d states)",
    digits: int = 2,
) -> DataFrame:
    """Share of each key in the total, keys below ``min_share`` % folded into one row.

    The share is rounded before it is compared. Keys without a value take no part.
    The total is a scalar subquery: no join and no single-partition window. Large
    rows and the folded one come from one grouping instead of a union.
    """
    total = df.agg(F.sum(value)).scalar()

    def share(amount):
        return F.bround(safe_ratio(amount, total) * 100, digits)

    small = share(F.col(value)) < min_share
    return (
        df.select(key, value)
        .where(share(F.col(value)).isNotNull())
        .withColumn("_group", F.when(small, F.lit(None)).otherwise(F.col(key)))
        .withColumn("_small", small)
        .groupBy("_small", "_group")
        .agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("_members"))
        .select(
            F.when(F.col("_small"), F.format_string(label, F.col("_members")))
            .otherwise(F.col("_group"))
            .alias(key),
            value,
            share(F.col(value)).alias("percentage"),
        )
        .orderBy(F.desc(value), key)
    )
