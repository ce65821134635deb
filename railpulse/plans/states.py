"""Reports on states.

``states`` is the result of ``daily.state_metrics`` (one row per state), ``trend``
of one of the state trends (one row per state and day).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.functions.flags import band_flag
from railpulse.functions.measures import sum_or_zero
from railpulse.functions.timeparts import days_before
from railpulse.operators.columns import rename_columns, round_numbers
from railpulse.operators.durable import keep
from railpulse.operators.ranking import movers, top_rows
from railpulse.operators.shares import fold_small
from railpulse.plans import daily
from railpulse.sources.tables import PaymentTables

# The headers of the established tables.
STATE_TABLE_HEADERS = {
    "final_state": "State",
    "yesterday_gtv": "Yesterday GTV (Cr)",
    "yesterday_transactions": "Transactions",
    "yesterday_success_rate": "Success Rate (%)",
    "median_90d_gtv": "90d Median GTV (Cr)",
    "median_90d_success_rate": "90d Median Success (%)",
    "gtv_vs_median_ratio": "GTV vs Median Ratio",
}
MOVER_HEADERS = {
    "final_state": "State",
    "yesterday_gtv": "Yesterday (Cr)",
    "median_90d_gtv": "90d Median (Cr)",
    "gtv_vs_median_ratio": "% vs Median",
}
SHARE_HEADERS = {"final_state": "State", "yesterday_gtv": "GTV (Cr)", "percentage": "Share (%)"}


def _mover_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "final_state",
        F.bround("yesterday_gtv", 2).alias("yesterday_gtv"),
        F.bround("median_90d_gtv", 2).alias("median_90d_gtv"),
        F.bround(F.col("gtv_vs_median_ratio") * 100, 1).alias("gtv_vs_median_ratio"),
    )


def top_gainers(states: DataFrame, n: int = 5) -> DataFrame:
    """States above 1 crore with the highest ratio to their median, ratio over 1.1."""
    busy = F.col("yesterday_gtv") > 1.0
    return _mover_columns(
        movers(states, "final_state", "gtv_vs_median_ratio", n, busy, above=1.1)
    )


def top_decliners(states: DataFrame, n: int = 5) -> DataFrame:
    """States above 1 crore with the lowest ratio to their median, ratio under 0.9."""
    busy = F.col("yesterday_gtv") > 1.0
    return _mover_columns(
        movers(states, "final_state", "gtv_vs_median_ratio", n, busy, below=0.9)
    )


def top_state_trend(trend: DataFrame, n: int = 10) -> DataFrame:
    """All daily rows of the ``n`` states with the highest mean daily value.

    A state's days, at most one entry per day of the trend, travel with its mean
    through the top-n, so the trend is computed once.
    """
    rest = [c for c in trend.columns if c != "final_state"]
    states = trend.groupBy("final_state").agg(
        F.avg("gtv").alias("_mean"), F.collect_list(F.struct(*rest)).alias("_days")
    )
    best = top_rows(states, n, F.desc("_mean"), "final_state")
    return best.select("final_state", F.inline("_days")).select(trend.columns)


def available_states(trend: DataFrame) -> DataFrame:
    return trend.select("final_state").distinct().orderBy("final_state")


def state_detail(trend: DataFrame, states: DataFrame, state: str) -> DataFrame:
    """Daily rows of one state with its 90-day median (0 if it has none) as reference."""
    median = states.where(F.col("final_state") == state).agg(F.max("median_90d_gtv")).scalar()
    return (
        trend.where(F.col("final_state") == state)
        .withColumn("median_90d_gtv", F.coalesce(median, F.lit(0.0)))
        .orderBy("date")
    )


def state_summary(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count(F.lit(1)).alias("total_states"),
        F.count_if(F.col("yesterday_gtv") > 0).alias("active_states"),
        sum_or_zero(F.col("yesterday_gtv")).cast("double").alias("total_gtv"),
        F.avg("yesterday_success_rate").alias("avg_success"),
    )


def top_states(states: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(
        states.select("final_state", "yesterday_gtv"), n, F.desc("yesterday_gtv"), "final_state"
    )


def state_share_others(states: DataFrame, min_share: float = 2.0) -> DataFrame:
    """Each state's share of yesterday's value, small states folded into one row.

    ``states`` is read twice, for the total and for the shares: ``keep`` it first.
    """
    return fold_small(states, "final_state", "yesterday_gtv", min_share)


def share_table(states: DataFrame) -> DataFrame:
    return rename_columns(round_numbers(state_share_others(states)), SHARE_HEADERS)


def mover_table(movers_of: DataFrame) -> DataFrame:
    """Gainers or decliners under their report headers."""
    return rename_columns(movers_of, MOVER_HEADERS)


def state_variation(states: DataFrame, beyond: float = 10.0) -> DataFrame:
    """States more than ``beyond`` % off their median, with the side they are on."""
    gtv, median = F.col("yesterday_gtv"), F.col("median_90d_gtv")
    varied = states.select(
        "final_state",
        "yesterday_gtv",
        "median_90d_gtv",
        F.bround(F.try_divide(gtv - median, median) * 100, 1).alias("variation"),
    )
    side = F.when(F.col("variation") > beyond, "above").when(
        F.col("variation") < -beyond, "below"
    )
    return (
        varied.withColumn("side", side)
        .where(F.col("side").isNotNull())
        .orderBy("side", F.desc(F.abs("variation")), "final_state")
    )


def above_median(states: DataFrame) -> DataFrame:
    above = state_variation(states).where("side = 'above'").drop("side")
    return round_numbers(above).orderBy(F.desc("variation"), "final_state")


def below_median(states: DataFrame) -> DataFrame:
    below = state_variation(states).where("side = 'below'").drop("side")
    return round_numbers(below).orderBy("variation", "final_state")


def state_threshold(states: DataFrame) -> DataFrame:
    """Median ± 1 σ bounds and on which side of them yesterday lies."""
    median, spread = F.col("median_90d_gtv"), F.col("stddev_90d_gtv")
    return states.select(
        "final_state",
        "yesterday_gtv",
        "median_90d_gtv",
        "stddev_90d_gtv",
        (median - spread).alias("lower_threshold"),
        (median + spread).alias("upper_threshold"),
        band_flag(
            F.col("yesterday_gtv"), median, spread,
            low="Below 1σ", high="Above 1σ", normal="Normal",
        ).alias("status"),
    )


def below_one_sigma(states: DataFrame) -> DataFrame:
    below = state_threshold(states).where("status = 'Below 1σ'")
    return round_numbers(
        below.select("final_state", "yesterday_gtv", "lower_threshold", "median_90d_gtv")
    ).orderBy("yesterday_gtv", "final_state")


def above_one_sigma(states: DataFrame) -> DataFrame:
    above = state_threshold(states).where("status = 'Above 1σ'")
    return round_numbers(
        above.select("final_state", "yesterday_gtv", "upper_threshold", "median_90d_gtv")
    ).orderBy(F.desc("yesterday_gtv"), "final_state")


def filter_states(
    states: DataFrame,
    min_gtv: float = 0.0,
    min_success: float = 0.0,
    only_active: bool = False,
) -> DataFrame:
    """Each condition applies only when its parameter is set."""
    if min_gtv > 0:
        states = states.where(F.col("yesterday_gtv") >= min_gtv)
    if min_success > 0:
        states = states.where(F.col("yesterday_success_rate") >= min_success)
    if only_active:
        states = states.where(F.col("yesterday_gtv") > 0)
    return states


def state_table(states: DataFrame) -> DataFrame:
    """The state table under its report headers."""
    return rename_columns(round_numbers(states), STATE_TABLE_HEADERS)


def state_reports(tables: PaymentTables, as_of: date) -> dict[str, DataFrame]:
    """All state reports of a day from one pass over the logs.

    The fact has one row per state and pair of days; it is kept on reliable storage,
    and so are the state metrics, because many reports start from them.
    """
    fact = keep(daily.daily_state_fact(tables, days_before(as_of, 90)))
    states = keep(daily.state_metrics_from_fact(fact, as_of, ordered=False))
    trend = daily.state_trend_from_fact(fact, as_of, 10, ordered=False)
    return {
        "state_metrics": states.orderBy(F.desc("yesterday_gtv"), "final_state"),
        "state_10d_trend": daily.state_trend_from_fact(fact, as_of, 10),
        "state_30d_trend": daily.state_trend_from_fact(fact, as_of, 30),
        "bank_state_90d_trend": daily.as_percentage(
            daily.state_trend_from_fact(fact, as_of, 90)
        ),
        "top_gainers": top_gainers(states),
        "top_decliners": top_decliners(states),
        "gainer_table": mover_table(top_gainers(states)),
        "decliner_table": mover_table(top_decliners(states)),
        "top10_state_trend": top_state_trend(trend),
        "state_summary": state_summary(states),
        "top_states": top_states(states),
        "state_share_others": state_share_others(states),
        "share_table": share_table(states),
        "state_variation": state_variation(states),
        "state_threshold": state_threshold(states),
        "state_table": state_table(states),
    }
