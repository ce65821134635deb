"""Today's values next to statistics of earlier days."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions.measures import mean_of, median_of, spread_of


class Stat(NamedTuple):
    """A statistic over the earlier days of a key."""

    of: Column
    how: str  # mean, median, approx_median, samp, pop, sum
    digits: int | None = None


def _statistic(column: str, stat: Stat) -> Column:
    if stat.how == "mean":
        value = mean_of(column)
    elif stat.how == "sum":
        value = F.sum(column)
    elif stat.how == "median":
        value = median_of(column)
    elif stat.how == "approx_median":
        value = median_of(column, exact=False)
    else:
        value = spread_of(column, stat.how)
    return value if stat.digits is None else F.round(value, stat.digits)


def against_history(
    cells: DataFrame,
    key: str,
    is_today: Column,
    is_history: Column,
    today: Mapping[str, Column],
    history: Mapping[str, Stat],
    only_today: bool = False,
) -> DataFrame:
    """Today's cell of every key with statistics of its earlier cells.

    ``cells`` has one row per key and day. A key is kept when it has a cell today or
    earlier (a full outer join of the two), or only when it has one today (a left
    join). Both halves come out of one aggregation: ``cells`` is computed once and
    joined with nothing.
    """
    # Statistics of the same Column share its values.
    earlier = {id(s.of): s.of for s in history.values()}
    column_of = {ref: f"_h{i}" for i, ref in enumerate(earlier)}
    masked = cells.select(
        key,
        is_today.alias("_today"),
        *[F.when(is_today, c).alias(f"_t{i}") for i, c in enumerate(today.values())],
        *[F.when(is_history, c).alias(column_of[ref]) for ref, c in earlier.items()],
    )
    out = masked.groupBy(key).agg(
        F.max("_today").alias("_has_today"),
        *[F.max(f"_t{i}").alias(name) for i, name in enumerate(today)],
        *[_statistic(column_of[id(s.of)], s).alias(name) for name, s in history.items()],
    )
    if only_today:
        out = out.where("_has_today")
    return out.drop("_has_today")
