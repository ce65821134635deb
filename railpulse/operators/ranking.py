"""Top rows, top groups and movers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame, by: Sequence[str], order: Column, n: int, ties: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group; ``rank`` keeps ties, ``row_number`` does not."""
    position = {"rank": F.rank, "row_number": F.row_number}[ties]()
    placed = df.withColumn("_place", position.over(Window.partitionBy(*by).orderBy(order)))
    return placed.where(F.col("_place") <= n).drop("_place")


def top_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """A global top-n: every task keeps n rows, the n best of these are returned."""
    return df.orderBy(*order).limit(n)


def movers(
    df: DataFrame,
    key: str,
    ratio: str,
    n: int,
    at_least: Column | None = None,
    above: float | None = None,
    below: float | None = None,
) -> DataFrame:
    """The ``n`` rows furthest above or below a ratio, among rows of enough size."""
    if (above is None) == (below is None):
        raise ValueError("give either above or below")
    kept = df if at_least is None else df.where(at_least)
    if above is not None:
        return top_rows(kept.where(F.col(ratio) > above), n, F.desc(ratio), key)
    return top_rows(kept.where(F.col(ratio) < below), n, F.asc(ratio), key)
