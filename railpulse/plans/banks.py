"""Bank reports for the state with the largest value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.operators.columns import round_numbers


def default_state(by_state: DataFrame) -> Column:
    """The state whose banks had the largest value yesterday, as a scalar subquery."""
    totals = by_state.groupBy("final_state").agg(F.sum("gtv").alias("gtv"))
    return totals.orderBy(F.desc("gtv"), "final_state").limit(1).select("final_state").scalar()


def state_banks(by_state: DataFrame, state: str | Column | None = None) -> DataFrame:
    """Bank rows of one state, the one with the largest value unless named.

    Without a name ``by_state`` is read twice: ``keep`` it first.
    """
    chosen = default_state(by_state) if state is None else state
    return by_state.where(F.col("final_state") == chosen).orderBy(F.desc("gtv"), "cust_bank_name")


def state_90d_series(
    trend: DataFrame, by_state: DataFrame, state: str | Column | None = None
) -> DataFrame:
    """Daily rows of the same state, oldest first."""
    chosen = default_state(by_state) if state is None else state
    return trend.where(F.col("final_state") == chosen).orderBy("date")


def bank_table(banks: DataFrame) -> DataFrame:
    return round_numbers(banks)
