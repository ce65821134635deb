"""Daily value, volume and success by state and bank.

The datasets are sorted for reading; ``ordered=False`` leaves the sort, and its
shuffle, out for reports that go on from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions.measures import (
    in_crore, rate, safe_ratio, sum_or_zero, sum_where, times,
)
from railpulse.functions.timeparts import DayRange, days_before, within
from railpulse.operators.baseline import Stat, against_history
from railpulse.operators.cdc import count_copies
from railpulse.operators.ranking import top_n_per_group, top_rows
from railpulse.sources.tables import PaymentTables, scan_days

SUCCESS = "SUCCESS"


def _window_of(day: Column, windows: Sequence[DayRange]) -> Column:
    """Number of the range that ``day`` lies in, NULL outside of all."""
    number = F.when(within(day, windows[0]), F.lit(0))
    for i, days in enumerate(windows[1:], start=1):
        number = number.when(within(day, days), F.lit(i))
    return number


def _hull(windows: Sequence[DayRange]) -> DayRange:
    return DayRange(min(w.first for w in windows), max(w.last for w in windows))


def _request_side(scan: DataFrame, keys: Sequence[str], copies: Column) -> DataFrame:
    """Requests that ask for money and their amount per ``keys``; a row counts ``copies`` times."""
    paid = F.col("trans_amt") > 0
    return scan.groupBy(*keys).agg(
        sum_or_zero(F.when(paid, times(copies))).alias("paid"),
        sum_where(paid, times(F.col("trans_amt"), copies)).alias("amount"),
    )


def _response_side(scan: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scan.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(F.col("message") == SUCCESS).alias("good_answers"),
    )


def _paired(requests: DataFrame, responses: DataFrame, on: Sequence[str]) -> DataFrame:
    """Counts and amount of all request × response pairs, from counts of each side."""
    successes = times(F.col("paid"), F.col("good_answers"))
    return (
        responses.join(requests, list(on))
        .withColumn("txns", times(F.col("paid"), F.col("answers")))
        .withColumn("successes", successes)
        .withColumn(
            "success_amount",
            F.when(successes > 0, times(F.col("amount"), F.col("good_answers"))),
        )
        .drop("paid", "answers", "good_answers", "amount", "request_id")
    )


def at_location(requests: DataFrame, tables: PaymentTables) -> DataFrame:
    """Requests with the state of their client and ``places``, the number of times it is
    listed there; clients without a state drop out.

    The join carries no broadcast hint: the location table grows with the network.
    Spark broadcasts it while its size is under the session's threshold and shuffles
    by client beyond, where AQE splits a client with very many rows.
    """
    places = count_copies(
        tables.client_locations.where(F.col("final_state").isNotNull()),
        ["retailer_id", "final_state"],
        "places",
    )
    return requests.join(places, F.col("client_id") == F.col("retailer_id"))


def daily_pairs(
    tables: PaymentTables,
    windows: Sequence[DayRange],
    by_state: bool = True,
    by_bank: bool = False,
) -> DataFrame:
    """Requests joined with their responses where both days lie in one of ``windows``.

    Request and response have clocks of their own: an answer after midnight of the
    last day leaves the window. Clients are replaced by their states first, and both sides are
    counted per request before they are joined: a request id has at most one row per day, state
    and bank, whatever number of clients and rows share it.
    """
    hull = _hull(windows)
    day = F.to_date("log_date_time")
    keys = ["request_id", "window", "day"]
    requests = scan_days(tables.daily_requests, "log_date_time", hull)
    requests = requests.withColumn("day", day).withColumn("window", _window_of(F.col("day"), windows))
    requests = requests.where(F.col("window").isNotNull())
    responses = scan_days(tables.daily_responses, "log_date_time", hull)
    responses = responses.withColumn("window", _window_of(day, windows))
    if by_bank:
        keys.append("cust_bank_name")
        requests = requests.where(F.col("cust_bank_name").isNotNull())
    copies = F.lit(1)
    if by_state:
        requests = at_location(requests, tables)
        keys.append("final_state")
        copies = F.col("places")
    return _paired(
        _request_side(requests, keys, copies),
        _response_side(responses.where(F.col("window").isNotNull()), ["request_id", "window"]),
        ["request_id", "window"],
    )


def total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up the measures; they are whole numbers, so any order gives the same sums."""
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in ("txns", "successes", "success_amount")])


def state_days(tables: PaymentTables, windows: Sequence[DayRange]) -> DataFrame:
    """(window, day, final_state) with transactions, successes and successful amount."""
    return total(daily_pairs(tables, windows), ["window", "day", "final_state"])


def daily_state_fact(
    tables: PaymentTables, days: DayRange, request_days: Sequence[date] | None = None
) -> DataFrame:
    """State totals by day of request *and* day of answer, for any range inside ``days``.

    One pass over the logs that every state report of a run can share. With ``request_days``
    only the requests of these days are read and counted, with their answers of all ``days``.
    """
    day = F.to_date("log_date_time")
    asked = days if request_days is None else DayRange(min(request_days), max(request_days))
    requests = scan_days(tables.daily_requests, "log_date_time", asked).withColumn("day", day)
    if request_days is not None:
        requests = requests.where(F.col("day").isin(list(request_days)))
    responses = scan_days(tables.daily_responses, "log_date_time", days)
    pairs = _paired(
        _request_side(
            at_location(requests, tables), ["request_id", "day", "final_state"], F.col("places")
        ),
        _response_side(responses.withColumn("answer_day", day), ["request_id", "answer_day"]),
        ["request_id"],
    )
    return total(pairs, ["day", "answer_day", "final_state"])


def windows_of_fact(fact: DataFrame, windows: Sequence[DayRange]) -> DataFrame:
    """The same rows as ``state_days``, cut from a daily state fact."""
    window = _window_of(F.col("day"), windows)
    inside = fact.withColumn("window", window).where(
        F.col("window") == _window_of(F.col("answer_day"), windows)
    )
    return total(inside, ["window", "day", "final_state"])


def _metrics_windows(as_of: date) -> list[DayRange]:
    return [days_before(as_of, 90, 2), days_before(as_of, 1)]


def _success_rate(part: str = "successes", whole: str = "txns") -> Column:
    return rate(F.col(part), F.col(whole))


def state_metrics_of(
    days: DataFrame, as_of: date, per_day: bool = False, ordered: bool = True
) -> DataFrame:
    """State metrics from ``state_days`` rows of the 90-day window and of yesterday."""
    yesterday = days_before(as_of, 1).last
    amount, success = in_crore(F.col("success_amount")), _success_rate()
    history = {
        "median_90d_gtv": Stat(amount, "median"),
        "median_90d_success_rate": Stat(success, "median"),
        "stddev_90d_gtv": Stat(amount, "samp"),
        "stddev_90d_success_rate": Stat(success, "samp"),
    }
    alike = {
        "same_weekday": F.dayofweek("day") == F.dayofweek(F.lit(yesterday)),
        "same_day_month": F.dayofmonth("day") == F.lit(yesterday.day),
    }
    for name, same in alike.items():
        if per_day:
            history[f"{name}_median_gtv"] = Stat(F.when(same, amount), "median")
            history[f"{name}_median_success_rate"] = Stat(F.when(same, success), "median")
        else:
            # One group per weekday (or day of month): its total, not a median of days.
            for measure in ("txns", "successes", "success_amount"):
                history[f"_{name}_{measure}"] = Stat(F.when(same, F.col(measure)), "sum")
    out = against_history(
        days,
        "final_state",
        F.col("window") == 1,
        F.col("window") == 0,
        {
            "yesterday_gtv": amount,
            "yesterday_transactions": F.col("txns"),
            "yesterday_success_rate": success,
        },
        history,
        only_today=True,
    )
    if not per_day:
        for name in alike:
            out = out.withColumn(
                f"{name}_median_gtv", in_crore(F.col(f"_{name}_success_amount"))
            ).withColumn(
                f"{name}_median_success_rate",
                _success_rate(f"_{name}_successes", f"_{name}_txns"),
            )
    out = out.select(
        "final_state", "yesterday_gtv", "yesterday_transactions", "yesterday_success_rate",
        "median_90d_gtv", "median_90d_success_rate", "stddev_90d_gtv", "stddev_90d_success_rate",
        "same_weekday_median_gtv", "same_weekday_median_success_rate",
        "same_day_month_median_gtv", "same_day_month_median_success_rate",
        safe_ratio(F.col("yesterday_gtv"), F.col("median_90d_gtv")).alias("gtv_vs_median_ratio"),
        safe_ratio(F.col("yesterday_success_rate"), F.col("median_90d_success_rate")).alias(
            "success_vs_median_ratio"
        ),
    )
    return out.orderBy(F.desc("yesterday_gtv"), "final_state") if ordered else out


def state_metrics(
    tables: PaymentTables, as_of: date, per_day: bool = False, ordered: bool = True
) -> DataFrame:
    """Yesterday per state against the 89 days before it.

    ``same_weekday_*`` and ``same_day_month_*`` are totals over all such days of the
    window, which is what their established definition amounts to; ``per_day=True``
    gives medians of the single days instead.
    """
    days = state_days(tables, _metrics_windows(as_of))
    return state_metrics_of(days, as_of, per_day, ordered)


def state_metrics_from_fact(
    fact: DataFrame, as_of: date, per_day: bool = False, ordered: bool = True
) -> DataFrame:
    days = windows_of_fact(fact, _metrics_windows(as_of))
    return state_metrics_of(days, as_of, per_day, ordered)


def state_trend_of(days: DataFrame, ordered: bool = True) -> DataFrame:
    out = days.select(
        F.col("day").alias("date"),
        "final_state",
        in_crore(F.col("success_amount")).alias("gtv"),
        F.col("txns").alias("transactions"),
        _success_rate().alias("success_rate"),
    )
    return out.orderBy(F.desc("date"), F.desc("gtv"), "final_state") if ordered else out


def state_trend(
    tables: PaymentTables, as_of: date, depth: int, ordered: bool = True
) -> DataFrame:
    """Value, volume and success rate per state and day, the last ``depth`` days."""
    return state_trend_of(state_days(tables, [days_before(as_of, depth)]), ordered)


def state_trend_from_fact(
    fact: DataFrame, as_of: date, depth: int, ordered: bool = True
) -> DataFrame:
    return state_trend_of(windows_of_fact(fact, [days_before(as_of, depth)]), ordered)


def state_10d_trend(tables: PaymentTables, as_of: date) -> DataFrame:
    return state_trend(tables, as_of, 10)


def state_30d_trend(tables: PaymentTables, as_of: date) -> DataFrame:
    return state_trend(tables, as_of, 30)


def as_percentage(trend: DataFrame) -> DataFrame:
    """A trend under the names of the bank page, without the volume."""
    return trend.select(
        "date", "final_state", "gtv", F.col("success_rate").alias("trans_percentage")
    )


def bank_state_90d_trend(
    tables: PaymentTables, as_of: date, ordered: bool = True
) -> DataFrame:
    """Value and success rate per state and day, 90 days."""
    return as_percentage(state_trend(tables, as_of, 90, ordered))


def daily_bank_fact(tables: PaymentTables, days: DayRange) -> DataFrame:
    """(day, final_state, bank) totals of requests made and answered inside ``days``."""
    pairs = daily_pairs(tables, [days], by_bank=True)
    return total(pairs, ["day", "final_state", "cust_bank_name"])


def bank_health(tables: PaymentTables, start: date, end: date, top: int = 5) -> DataFrame:
    """Daily rows of the ``top`` banks of every state by value, ties kept.

    A bank's days (at most one entry per day of the range) travel with its total
    through the ranking, so the daily fact is computed once and not joined back.
    """
    banks = (
        daily_bank_fact(tables, DayRange(start, end))
        .groupBy("final_state", "cust_bank_name")
        .agg(
            F.sum("success_amount").alias("amount"),
            F.sum("txns").alias("bank_txns"),
            F.sum("successes").alias("bank_successes"),
            F.collect_list(F.struct("day", "txns", "successes", "success_amount")).alias("days"),
        )
        .where(F.col("amount") > 0)
    )
    best = top_n_per_group(banks, ["final_state"], F.desc("amount"), top)
    return (
        best.withColumn("active_days", F.size("days").cast("bigint"))
        .withColumn("d", F.explode("days"))
        .select(
            "final_state",
            F.col("d.day").alias("date"),
            "cust_bank_name",
            F.col("d.txns").alias("transaction_count"),
            in_crore(F.col("d.success_amount")).alias("gtv"),
            rate(F.col("d.successes"), F.col("d.txns")).alias("trans_percentage"),
            in_crore(F.col("amount")).alias("bank_total_gtv"),
            F.col("bank_txns").alias("bank_total_transactions"),
            rate(F.col("bank_successes"), F.col("bank_txns")).alias("bank_success_rate"),
            "active_days",
        )
        .orderBy(F.desc("date"), "final_state", F.desc("gtv"))
    )


def bank_yesterday(tables: PaymentTables, as_of: date, n: int = 25) -> DataFrame:
    """The ``n`` banks with the largest value yesterday, clients without a state included."""
    yesterday = days_before(as_of, 1)
    pairs = daily_pairs(tables, [yesterday], by_state=False, by_bank=True)
    banks = total(pairs, ["cust_bank_name"]).select(
        "cust_bank_name",
        F.col("txns").alias("transaction_count"),
        in_crore(F.col("success_amount")).alias("gtv"),
        _success_rate().alias("trans_percentage"),
    )
    return top_rows(banks, n, F.desc("gtv"), "cust_bank_name")


def bank_yesterday_by_state(
    tables: PaymentTables, as_of: date, ordered: bool = True
) -> DataFrame:
    """Banks of every state yesterday."""
    pairs = daily_pairs(tables, [days_before(as_of, 1)], by_bank=True)
    out = total(pairs, ["final_state", "cust_bank_name"]).select(
        "final_state",
        "cust_bank_name",
        F.col("txns").alias("transaction_count"),
        F.col("successes").alias("success_count"),
        F.col("txns").alias("total_count"),
        in_crore(F.col("success_amount")).alias("gtv"),
        _success_rate().alias("trans_percentage"),
    )
    return out.orderBy(F.desc("gtv"), "final_state", "cust_bank_name") if ordered else out
