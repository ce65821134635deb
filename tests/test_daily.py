from datetime import date

import pytest

from railpulse.functions.timeparts import DayRange, days_before
from railpulse.plans import banks, daily, states
from railpulse.plans.catalog import dataset
from tests.conftest import by

TODAY = date(2024, 4, 22)


def test_answer_after_midnight(logs):
    logs.place(1, "X").daily(1, "2024-04-20 23:59:00", answered="2024-04-21 00:01:00")
    tables = logs.tables()
    assert len(daily.state_10d_trend(tables, TODAY).collect()) == 1
    assert daily.bank_yesterday_by_state(tables, date(2024, 4, 21)).collect() == []


def test_answer_between_history_and_yesterday_counts_in_neither(logs):
    logs.place(1, "X").daily(1, "2024-04-20 23:59:00", answered="2024-04-21 00:01:00")
    logs.daily(2, "2024-04-21 10:00:00").daily(3, "2024-04-19 10:00:00", amount=20_000_000)
    row = by(daily.state_metrics(logs.tables(), TODAY), "final_state")["X"]
    assert row["yesterday_transactions"] == 1 and row["median_90d_gtv"] == 2.0


def test_success_is_exact_by_day(logs):
    logs.place(1, "X").daily(1, "2024-04-21 10:00:00", message="success")
    row = by(daily.state_metrics(logs.tables(), TODAY), "final_state")["X"]
    assert row["yesterday_gtv"] is None and row["yesterday_success_rate"] == 0.0


def test_requests_without_amount_keep_the_group(logs):
    logs.place(1, "X").daily(1, "2024-04-21 10:00:00", amount=0)
    row = by(daily.state_metrics(logs.tables(), TODAY), "final_state")["X"]
    assert row["yesterday_transactions"] == 0 and row["yesterday_success_rate"] is None


def test_same_weekday_is_a_total(logs):
    logs.place(1, "X").daily(1, "2024-04-21 10:00:00")  # a Sunday
    logs.daily(2, "2024-04-14 10:00:00").daily(3, "2024-04-07 10:00:00", amount=30_000_000)
    tables = logs.tables()
    row = by(daily.state_metrics(tables, TODAY), "final_state")["X"]
    assert row["same_weekday_median_gtv"] == 4.0 and row["same_day_month_median_gtv"] is None
    row = by(daily.state_metrics(tables, TODAY, per_day=True), "final_state")["X"]
    assert row["same_weekday_median_gtv"] == 1.0


def test_location_rows_multiply_and_missing_states_drop_out(logs):
    logs.place(1, "X").place(1, "X").place(1, "Y").place(2, None)
    logs.daily(1, "2024-04-21 10:00:00").daily(2, "2024-04-21 10:00:00", client=2)
    logs.daily(3, "2024-04-21 10:00:00", client=3)
    rows = by(daily.state_metrics(logs.tables(), TODAY), "final_state")
    assert {s: r["yesterday_transactions"] for s, r in rows.items()} == {"X": 2, "Y": 1}


def test_client_without_state_is_in_the_bank_list_only(logs):
    logs.place(1, "X").daily(1, "2024-04-21 10:00:00", bank="A")
    logs.daily(2, "2024-04-21 10:00:00", client=9, bank="B").daily(3, "2024-04-21 10:00:00", bank=None)
    tables = logs.tables()
    assert set(by(daily.bank_yesterday(tables, TODAY), "cust_bank_name")) == {"A", "B"}
    assert set(by(daily.bank_yesterday_by_state(tables, TODAY), "cust_bank_name")) == {"A"}


def test_bank_list_is_limited(logs):
    for i in range(30):
        logs.daily(i, "2024-04-21 10:00:00", bank=f"B{i:02}", amount=(i + 1) * 10)
    names = [r.cust_bank_name for r in daily.bank_yesterday(logs.tables(), TODAY).collect()]
    assert names == [f"B{i:02}" for i in range(29, 4, -1)]


def test_rank_keeps_ties_and_drops_banks_without_value(logs):
    logs.place(1, "X")
    for i, amount in enumerate((90, 80, 70, 60, 50, 50, 40)):
        logs.daily(i, "2024-04-21 10:00:00", bank=f"B{i}", amount=amount)
    logs.daily(50, "2024-04-20 10:00:00", bank="B0", amount=10)
    logs.daily(60, "2024-04-20 10:00:00", bank="ZERO", amount=0)
    logs.daily(61, "2024-04-20 10:00:00", bank="FAIL", message="FAILED")
    rows = by(
        daily.bank_health(logs.tables(), date(2024, 4, 1), date(2024, 4, 21)),
        "cust_bank_name", "date",
    )
    assert {bank for bank, _ in rows} == {f"B{i}" for i in range(6)}
    first = rows["B0", date(2024, 4, 20)]
    assert first["active_days"] == 2 and first["bank_total_gtv"] == 100 / 1e7
    assert first["bank_total_transactions"] == 2 and first["bank_success_rate"] == 100.0


def test_few_banks_rank_when_no_value(logs):
    logs.place(1, "X").daily(1, "2024-04-21 10:00:00", message="FAILED")
    assert daily.bank_health(logs.tables(), date(2024, 4, 1), date(2024, 4, 21)).collect() == []


def test_shared_fact_gives_the_same_reports(spark, logs):
    for i in range(300):
        day = 1 + i % 21
        late = i % 17 == 0
        logs.daily(
            i, f"2024-04-{day:02} 23:50:00", client=i % 5, amount=(i % 7) * 1_000_000,
            message="FAILED" if i % 4 == 0 else "SUCCESS",
            answered=f"2024-04-{day + late:02} 23:55:00",
        )
    for client in range(4):
        logs.place(client, f"S{client % 3}")
    tables = logs.tables()
    fact = daily.daily_state_fact(tables, days_before(TODAY, 90))
    assert (
        daily.state_metrics_from_fact(fact, TODAY).collect()
        == daily.state_metrics(tables, TODAY).collect()
    )
    for depth in (10, 30, 90):
        assert (
            daily.state_trend_from_fact(fact, TODAY, depth).collect()
            == daily.state_trend(tables, TODAY, depth).collect()
        )
    reports = states.state_reports(tables, TODAY)
    assert reports["state_metrics"].collect() == daily.state_metrics(tables, TODAY).collect()
    assert reports["state_summary"].first().total_states == 3


def test_banks_of_a_state_add_up_to_the_state(logs):
    for i in range(40):
        logs.daily(i, "2024-04-21 10:00:00", client=i % 3, bank=f"B{i % 4}", amount=i * 1000,
                   message="FAILED" if i % 5 == 0 else "SUCCESS")
    logs.place(0, "S0").place(1, "S1").place(2, "S0")
    tables = logs.tables()
    per_state = by(daily.state_metrics(tables, TODAY), "final_state")
    per_bank = daily.bank_yesterday_by_state(tables, TODAY)
    for row in per_bank.groupBy("final_state").sum("total_count", "gtv").collect():
        assert row["sum(total_count)"] == per_state[row.final_state]["yesterday_transactions"]
        assert abs(row["sum(gtv)"] - per_state[row.final_state]["yesterday_gtv"]) < 1e-9


def test_default_state(logs):
    logs.place(1, "X").place(2, "Y")
    logs.daily(1, "2024-04-21 10:00:00", client=1, amount=10).daily(2, "2024-04-20 10:00:00", client=2)
    logs.daily(3, "2024-04-21 10:00:00", client=2, amount=20, bank="B")
    logs.daily(4, "2024-04-21 11:00:00", client=2, amount=30, bank="C")
    tables = logs.tables()
    by_state = daily.bank_yesterday_by_state(tables, TODAY)
    assert [r.cust_bank_name for r in banks.state_banks(by_state).collect()] == ["C", "B"]
    assert [r.cust_bank_name for r in banks.state_banks(by_state, "X").collect()] == ["A"]
    series = banks.state_90d_series(daily.bank_state_90d_trend(tables, TODAY), by_state)
    assert [r.date.day for r in series.collect()] == [20, 21]


def test_catalog(logs):
    logs.place(1, "X").daily(1, "2024-04-21 10:00:00")
    tables = logs.tables()
    assert dataset("state_metrics", tables, TODAY).count() == 1
    assert dataset("bank_health", tables, TODAY).count() == 1
    assert dataset("bank_health", tables, start=date(2024, 1, 1), end=date(2024, 1, 2)).count() == 0
    assert dataset("transaction_success", tables, TODAY).count() == 0
    with pytest.raises(KeyError):
        dataset("nonsense", tables, TODAY)


def test_day_ranges():
    assert days_before(TODAY, 90, 2) == DayRange(date(2024, 1, 23), date(2024, 4, 20))
