from datetime import date

from railpulse.plans import hourly, overview
from tests.conftest import by

TODAY = date(2024, 1, 30)


def q3(logs):
    return by(hourly.txn_hourly_health(logs.tables(), TODAY), "hour")


def q1(logs):
    return by(hourly.txn_hourly_median(logs.tables(), TODAY), "hour")


def q4(logs):
    return by(hourly.bio_hourly_health(logs.tables(), TODAY), "hour")


def q2(logs):
    return by(hourly.bio_hourly_8d(logs.tables(), TODAY), "hour")


def test_hour_without_history_is_normal(logs):
    logs.txn(1, "2024-01-30 05:10:00")
    row = q3(logs)["05:00"]
    assert row["avg_success_rate"] is None and row["success_rate_anomaly"] == "normal"
    row = q1(logs)["05:00"]
    assert row["median_success_rate"] is None and row["date"] == TODAY


def test_hour_only_in_history(logs):
    logs.txn(1, "2024-01-29 20:10:00").txn(2, "2024-01-30 05:10:00")
    assert set(q3(logs)) == {"05:00"}
    row = q1(logs)["20:00"]
    assert row["date"] is None and row["median_success_rate"] == 100.0
    assert row["success_rate_anomaly"] == "normal"


def test_hour_of_authentication_only_in_history(logs):
    logs.bio(1, "2024-01-29 20:10:00").bio(2, "2024-01-30 05:10:00")
    assert q2(logs)["20:00"]["fa2_succ_flag"] == "No Data"
    assert q4(logs)["20:00"]["fa2_succ_flag"] == "normal"
    assert q2(logs)["05:00"]["fa2_succ_flag"] == "Normal"


def test_one_historical_day(logs):
    logs.txn(1, "2024-01-29 05:10:00", amount=20_000_000)
    logs.txn(2, "2024-01-30 05:10:00", message="FAILED")
    row = q3(logs)["05:00"]
    assert row["stddev_success_rate"] is None and row["success_rate_anomaly"] == "normal"
    # the population spread of one value is 0, so any deviation is flagged
    assert q1(logs)["05:00"]["success_rate_anomaly"] == "lower anomaly ↓"


def test_low_value_flag(logs):
    for i, day in enumerate(range(23, 30)):
        logs.txn(i, f"2024-01-{day} 05:10:00", amount=100_000_000 + i)
    logs.txn(99, "2024-01-30 05:10:00", amount=10)
    row = q3(logs)["05:00"]
    assert row["amount_cr_anomaly"] == "low" and row["success_rate_anomaly"] == "normal"


def test_empty_denominators(logs):
    logs.txn(1, "2024-01-30 05:10:00", aggregator="YBL")
    logs.bio(1, "2024-01-30 05:10:00", aggregator="YBL")
    assert q3(logs)["05:00"]["nsdl_success_rate"] == 0.0
    assert q1(logs)["05:00"]["nsdl_success_rate"] is None
    assert q1(logs)["05:00"]["ybl_success_rate"] == 100.0
    assert q4(logs)["05:00"]["nsdl_rate_yesterday"] is None


def test_duplicate_rows_multiply(logs):
    logs.txn(1, "2024-01-30 05:10:00", inserts=2, devices=3)
    row = q3(logs)["05:00"]
    assert row["total_txns"] == 6 and row["total_amount_cr"] == 6.0


def test_request_without_response_or_device_drops_out(logs):
    logs.txn(1, "2024-01-30 05:10:00").txn(2, "2024-01-30 05:10:00", devices=0)
    logs.txn(3, "2024-01-30 05:10:00", inserts=0).txn(4, "2024-01-30 05:10:00", kind="BE")
    assert q3(logs)["05:00"]["total_txns"] == 1


def test_two_authentication_answers_count_twice(logs):
    logs.bio(1, "2024-01-30 05:10:00", updates=2)
    row = q4(logs)["05:00"]
    assert (row["total_attempts"], row["successful_attempts"]) == (2, 2)
    assert row["per_user_rate_yesterday"] == 2.0 and row["nsdl_rate_yesterday"] == 100.0


def test_success_is_case_insensitive_by_hour(logs):
    logs.txn(1, "2024-01-30 05:10:00", message="success")
    assert q3(logs)["05:00"]["overall_success_rate"] == 100.0


def test_authentication_aggregator_is_case_sensitive(logs):
    logs.bio(1, "2024-01-30 05:10:00", aggregator="nsdl")
    assert q4(logs)["05:00"]["nsdl_rate_yesterday"] is None


def test_unknown_clients_are_not_counted(logs):
    logs.bio(1, "2024-01-30 05:10:00", client=None)
    row = q4(logs)["05:00"]
    assert (row["total_attempts"], row["fa2_rate_yesterday"]) == (0, None)


def test_history_depths(logs):
    # 22 January is the eighth day before, in the history of the 8-day form alone
    logs.bio(1, "2024-01-22 05:10:00").txn(1, "2024-01-22 05:10:00")
    assert "05:00" in q2(logs)
    assert "05:00" not in q4(logs) and "05:00" not in q1(logs)


def test_hour_belongs_to_the_answer(logs):
    logs.bio(1, "2024-01-30 05:59:00")
    logs.rows["bio_log"][1]["op_time"] = logs.rows["bio_log"][1]["op_time"].replace(hour=6)
    assert set(q4(logs)) == {"06:00"}


def test_all_health_reports(logs):
    logs.txn(1, "2024-01-30 05:10:00").bio(1, "2024-01-30 05:10:00")
    reports = overview.health_reports(logs.tables(), TODAY)
    assert reports["health_score"].first().overall_score == 100.0
    assert reports["txn_totals"].first().total_transactions == 1
