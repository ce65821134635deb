"""The stored daily fact: late rows, replaced days, equality with a run over all logs."""

from datetime import date
from pathlib import Path

import pytest

from railpulse.functions.timeparts import DayRange
from railpulse.plans import daily
from railpulse.plans.catalog import DATASETS
from railpulse.plans.kept import FROM_FACT, KeptFact, touched_days
from tests.conftest import Logs

AS_OF = date(2024, 4, 22)
DAYS = DayRange(date(2024, 1, 23), date(2024, 4, 21))


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def early(spark):
    logs = Logs(spark).place(1, "A").place(2, "B")
    for i, day in enumerate(("2024-04-10", "2024-04-12", "2024-04-20", "2024-04-21")):
        logs.daily(i, f"{day} 10:00:00", client=1 + i % 2, amount=10_000_000 * (i + 1))
        logs.daily(10 + i, f"{day} 11:00:00", client=1, message="FAILED")
    logs.add("daily_requests", request_id=50, client_id=2, log_date_time=None, trans_amt=5, cust_bank_name="A")
    return logs


@pytest.fixture
def late(spark):
    """Answers to requests of two days, and a request of a third one."""
    logs = Logs(spark)
    for request_id in (0, 2):
        row = {"request_id": request_id, "message": "SUCCESS"}
        logs.rows["daily_responses"].append(row | {"log_date_time": Logs(spark).daily(0, "2024-04-21 23:00:00").rows["daily_requests"][0]["log_date_time"]})
    return logs.daily(90, "2024-04-15 09:00:00", client=2)


def both(spark, *parts):
    logs = Logs(spark)
    for part in parts:
        for name, rows in part.rows.items():
            logs.rows[name] += rows
    return logs.tables()


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_late_rows_rewrite_their_days_only(spark, tmp_path, early, late):
    fact = KeptFact(spark, f"{tmp_path}/fact")
    fact.build(early.tables(), DAYS)
    before = files(tmp_path)
    everything = both(spark, early, late)
    assert touched_days(everything, late.tables(), DAYS) == [date(2024, 4, 10), date(2024, 4, 15), date(2024, 4, 20)]
    assert fact.refresh(everything, late.tables(), DAYS) == [date(2024, 4, 10), date(2024, 4, 15), date(2024, 4, 20)]
    after = files(tmp_path)
    same = {f.parent.name for f in before if after.get(f) == before[f]}
    assert same == {"day=2024-04-12", "day=2024-04-21"}
    assert shown(fact.read()) == shown(daily.daily_state_fact(everything, DAYS))
    for name in FROM_FACT:
        assert shown(fact.dataset(name, AS_OF)) == shown(DATASETS[name](everything, AS_OF)), name
    # again: nothing changes
    fact.refresh(everything, late.tables(), DAYS)
    assert shown(fact.read()) == shown(daily.daily_state_fact(everything, DAYS))


def test_nothing_new(spark, tmp_path, early):
    fact = KeptFact(spark, f"{tmp_path}/fact")
    fact.build(early.tables(), DAYS)
    before = files(tmp_path)
    assert fact.refresh(early.tables(), Logs(spark).tables(), DAYS) == []
    assert files(tmp_path) == before


def test_answers_after_the_range_wait(spark, tmp_path, early):
    """An answer outside the days of the reports does not count, as in a run over all logs."""
    fact = KeptFact(spark, f"{tmp_path}/fact")
    late = Logs(spark)
    late.daily(0, "2024-04-22 00:00:30")
    late.rows["daily_requests"].clear()
    everything = both(spark, early, late)
    wider = DayRange(DAYS.first, date(2024, 4, 22))
    fact.build(early.tables(), wider)
    assert fact.refresh(everything, late.tables(), wider) == [date(2024, 4, 10)]
    for name in FROM_FACT:
        assert shown(fact.dataset(name, AS_OF)) == shown(DATASETS[name](everything, AS_OF)), name


def test_only_the_days_of_a_page_are_read(spark, tmp_path, early):
    fact = KeptFact(spark, f"{tmp_path}/fact")
    fact.build(early.tables(), DAYS)
    plan = fact.read(DayRange(date(2024, 4, 20), date(2024, 4, 21)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(answer_day)" in plan
