import random
from datetime import date, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from railpulse.operators.cdc import latest_by
from railpulse.streaming import hourly as live
from railpulse.streaming import latest, pages
from tests.conftest import Logs, at, by


def write(logs, folder, *tables):
    for name in tables:
        logs.frame(name).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(stream, folder):
    live.start(
        stream, f"{folder}/out", f"{folder}/progress", every=None, partitions=2
    ).awaitTermination(120)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def hours(df):
    return by(df.withColumn("hour_start", F.date_format("hour_start", "HH:mm")), "hour_start")


def test_stream_equals_batch_for_closed_hours(spark, logs, tmp_path):
    for i in range(60):
        logs.txn(i, f"2024-01-30 {8 + i // 20:02}:{i % 20:02}:00", amount=i * 1000,
                 message="Success" if i % 3 else "FAILED", aggregator=("ybl", "NSDL", "YBLN")[i % 3])
    # a stale answer that must lose against the later one
    logs.add("txn_responses", op_time=logs.rows["txn_requests"][1]["op_time"], op_name="UPDATE",
             request_id=1, message="PENDING")
    logs.txn(99, "2024-01-30 13:30:00")
    write(logs, tmp_path, "txn_requests", "txn_responses")
    stream = live.hourly_metrics(
        *[live.read_stream(spark, f"{tmp_path}/{t}", t) for t in ("txn_requests", "txn_responses")],
        answer_hours=1,
    )
    batch = live.hourly_metrics(logs.frame("txn_requests"), logs.frame("txn_responses"))
    streamed, expected = hours(run(stream, tmp_path)), hours(batch)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert {p.name for p in (tmp_path / "progress" / "state" / "0").iterdir()} >= {"0", "1"}
    assert not (tmp_path / "progress" / "state" / "0" / "2").exists()
    assert set(expected) == {"08:00", "09:00", "10:00", "13:00"}
    assert streamed == {h: r for h, r in expected.items() if h != "13:00"}
    assert streamed["08:00"]["total_txns"] == 20 and streamed["08:00"]["nsdl_success"] == 7


def test_late_rows_are_dropped(spark, tmp_path):
    first = Logs(spark).bio(1, "2024-01-30 08:10:00", client=1).bio(2, "2024-01-30 10:30:00", client=2)
    late = Logs(spark).bio(3, "2024-01-30 08:20:00", client=3).bio(4, "2024-01-30 12:30:00", client=4)
    for part in (first, late):
        write(part, tmp_path, "bio_log")
        stream = live.active_users(live.read_stream(spark, f"{tmp_path}/bio_log", "bio_log"))
        counts = hours(run(stream, tmp_path))
    assert {h: r["active_users"] for h, r in counts.items()} == {"08:00": 1, "10:00": 1}


def test_latest_update_per_request(spark, logs, tmp_path):
    logs.txn(1, "2024-01-30 08:10:00", message="Success").txn(2, "2024-01-30 12:00:00")
    logs.add("txn_responses", op_time=logs.rows["txn_requests"][0]["op_time"], op_name="UPDATE",
             request_id=1, message="PENDING")
    write(logs, tmp_path, "txn_responses")
    stream = live.latest_update(
        live.read_stream(spark, f"{tmp_path}/txn_responses", "txn_responses", files_per_trigger=1)
    )
    rows = run(stream, tmp_path).collect()
    assert [(r.request_id, r.message) for r in rows] == [(1, "Success")]


def test_repeats_count_once_an_hour_in_stream_and_batch(spark, logs, tmp_path):
    logs.txn(1, "2024-01-30 08:10:00").txn(1, "2024-01-30 08:11:00").txn(1, "2024-01-30 10:30:00")
    for i in range(200):  # a hot id: one of its repeats comes before the delay, others after it
        logs.txn(7, f"2024-01-30 12:{i % 60:02}:00", aggregator="nsdl")
    logs.txn(99, "2024-01-30 20:00:00")
    batch = live.hourly_metrics(logs.frame("txn_requests"), logs.frame("txn_responses"))
    expected = {h: r["total_txns"] for h, r in hours(batch).items()}
    assert expected == {"08:00": 1, "10:00": 1, "12:00": 1, "20:00": 1}
    write(logs, tmp_path, "txn_requests", "txn_responses")
    stream = live.hourly_metrics(
        *[live.read_stream(spark, f"{tmp_path}/{t}", t) for t in ("txn_requests", "txn_responses")],
        answer_hours=1,
    )
    counted = {h: r["total_txns"] for h, r in hours(run(stream, tmp_path)).items()}
    assert counted == {h: n for h, n in expected.items() if h != "20:00"}


def test_late_answers_count_in_the_batch_form(logs):
    logs.txn(1, "2024-01-30 08:10:00", message="FAILED")
    logs.add("txn_responses", op_time=at("2024-01-30 15:00:00"), op_name="UPDATE", request_id=1,
             message="Success")
    row = live.hourly_metrics(logs.frame("txn_requests"), logs.frame("txn_responses")).first()
    assert (row.total_txns, row.total_success) == (1, 1)


def test_a_stream_needs_a_bound_on_answers(spark, tmp_path, logs):
    write(logs.txn(1, "2024-01-30 08:10:00"), tmp_path, "txn_requests", "txn_responses")
    streams = [live.read_stream(spark, f"{tmp_path}/{t}", t) for t in ("txn_requests", "txn_responses")]
    with pytest.raises(ValueError, match="answer_hours"):
        live.hourly_metrics(*streams)


def test_timed_refresh(spark, logs, tmp_path):
    write(logs.bio(1, "2024-01-30 08:10:00").bio(2, "2024-01-30 10:30:00"), tmp_path, "bio_log")
    stream = live.active_users(live.read_stream(spark, f"{tmp_path}/bio_log", "bio_log"))
    query = live.start(stream, f"{tmp_path}/out", f"{tmp_path}/progress", every="1 second", partitions=2)
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert set(hours(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"))) == {"08:00"}


def answers(spark, rows):
    logs = Logs(spark)
    for request_id, when, message in rows:
        logs.add("txn_responses", op_time=at(when), op_name="UPDATE", request_id=request_id, message=message)
    return logs


def run_latest(spark, folder, **more):
    stream = latest.latest_per_request(
        live.read_stream(spark, f"{folder}/txn_responses", "txn_responses", files_per_trigger=1), **more
    )
    live.start(
        stream, f"{folder}/out", f"{folder}/progress", every=None, partitions=2, settings=latest.KEYED_STATE
    ).awaitTermination(120)
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()
    return sorted((r.request_id, r.message, f"{r.last_time:%H:%M:%S}") for r in rows)


def test_one_row_per_request_over_hours_and_batches(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    first = [
        (1, "2024-01-30 08:55:00", "PENDING"), (1, "2024-01-30 09:02:00", "FAILED"),  # over the hour
        (2, "2024-01-30 09:01:00", "FAILED"), (2, "2024-01-30 09:01:00", "Success"), (2, "2024-01-30 09:01:00", None),
        (3, "2024-01-30 09:00:00", None), (None, "2024-01-30 09:00:00", "Success"),
    ]
    # the next run goes on from the state of the first one
    second = [(1, "2024-01-30 09:09:00", "Success"), (3, "2024-01-30 08:59:59", "FAILED"), (4, "2024-01-30 12:00:00", "Success")]
    closed = [(1, "Success", "09:09:00"), (2, "Success", "09:01:00"), (3, None, "09:00:00")]
    for rows, expected in ((first, []), (second, closed)):
        write(answers(spark, rows), tmp_path, "txn_responses")
        assert run_latest(spark, tmp_path) == expected
    assert spark.conf.get(provider, None) == before


def test_latest_per_request_equals_the_batch_form(spark, logs, tmp_path):
    pick = random.Random(1)
    for i in range(400):
        start = pick.randrange(0, 6 * 3600)
        for _ in range(pick.randint(1, 4)):
            start += pick.randrange(0, 500)
            logs.add("txn_responses", op_time=at("2024-01-30 00:00:00") + timedelta(seconds=start), op_name="UPDATE",
                     request_id=i if i % 3 else 0, message=pick.choice(["Success", "FAILED", None]))
    logs.add("txn_responses", op_time=at("2024-01-31 00:00:00"), op_name="UPDATE", request_id=999, message="x")
    write(logs, tmp_path, "txn_responses")
    batch = latest_by(logs.frame("txn_responses"), ["request_id"], "op_time", ["message"])
    expected = sorted((r.request_id, r.message, f"{r.op_time:%H:%M:%S}") for r in batch.collect() if r.request_id != 999)
    # the hot id 0 is never quiet for long
    assert run_latest(spark, tmp_path, quiet=timedelta(hours=2)) == expected


def test_open_requests_share_state(spark, tmp_path):
    """Many open requests cost a bounded number of state rows and timers, and none is lost."""
    many = 2 * latest.GROUPS * 3
    for rows in ([(i, "2024-01-30 08:55:00", f"m{i}") for i in range(many)], [(-1, "2024-01-30 12:00:00", None)]):
        write(answers(spark, rows), tmp_path, "txn_responses")
        stream = latest.latest_per_request(live.read_stream(spark, f"{tmp_path}/txn_responses", "txn_responses"))
        query = live.start(stream, f"{tmp_path}/out", f"{tmp_path}/progress", every=None, partitions=2, settings=latest.KEYED_STATE)
        query.awaitTermination(120)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert 0 < max(held) <= 3 * latest.GROUPS + 3  # a table, and a timer by group and by time
    closed = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
    assert {r.request_id: r.message for r in closed} == {i: f"m{i}" for i in range(many)} and len(closed) == many


def test_batches_are_reduced_before_the_state(spark):
    rows = pa.table({
        "request_id": [7, 7, 8, 7, 8], "op_time": pa.array([1, 3, 5, 3, 5], pa.timestamp("us", "UTC")),
        "message": ["a", None, "b", "c", "d"],
    })
    out = pa.Table.from_batches(latest.latest_in_batch(iter(rows.to_batches()))).to_pylist()
    assert [(r["request_id"], r["message"]) for r in out] == [(7, "c"), (8, "d")]
    assert list(latest.latest_in_batch(iter(rows.slice(0, 0).to_batches()))) == []


PAGE_DAY = date(2024, 1, 30)


def page_logs(spark, day, n, base=0):
    logs = Logs(spark)
    for i in range(base, base + n):
        logs.txn(i, f"{day} {8 + i % 4:02}:{i % 50:02}:00", message="Success" if i % 3 else "FAILED",
                 aggregator=("ybl", "NSDL", "YBLN")[i % 3])
        logs.bio(10_000 + i, f"{day} {8 + i % 4:02}:{i % 50:02}:00", client=i % 7, rc="00" if i % 4 else "U1")
    return logs


def shown(df):
    return sorted(map(str, df.collect()))


def test_pages_of_open_hours_equal_the_batch_form(spark, tmp_path):
    everything = Logs(spark)
    parts = [page_logs(spark, "2024-01-29", 30), page_logs(spark, "2024-01-30", 20, 100), page_logs(spark, "2024-01-30", 20, 200)]
    for part in parts:
        write(part, f"{tmp_path}/logs", *pages.PAGE_LOGS)
        for name, rows in part.rows.items():
            everything.rows[name] += rows
        streams = {t: live.read_stream(spark, f"{tmp_path}/logs/{t}", t) for t in pages.PAGE_LOGS}
        pages.start_pages(streams, f"{tmp_path}/out", f"{tmp_path}/progress", PAGE_DAY, every=None).awaitTermination(120)
        for name, build in pages.PAGES.items():
            assert shown(pages.current_page(spark, f"{tmp_path}/out", name)) == shown(build(everything.tables(), PAGE_DAY))


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    refresh = pages.refresh_pages(str(tmp_path), PAGE_DAY)
    batches = [page_logs(spark, "2024-01-30", 20), page_logs(spark, "2024-01-30", 20, 100)]
    frames = [pages.merged({t: logs.frame(t) for t in pages.PAGE_LOGS}) for logs in batches]
    assert pages.current_page(spark, str(tmp_path), "txn_hourly_health") is None
    for i, frame in enumerate(frames):
        refresh(frame, i)
    before = {name: shown(pages.current_page(spark, str(tmp_path), name)) for name in pages.PAGES}
    rows = pages.landed_tables(spark, str(tmp_path), 1).txn_requests.count()
    refresh(frames[1], 1)
    assert rows == 40 == pages.landed_tables(spark, str(tmp_path), 1).txn_requests.count()
    assert before == {name: shown(pages.current_page(spark, str(tmp_path), name)) for name in pages.PAGES}
    # a page that was not finished is not shown
    (tmp_path / "pages" / "txn_hourly_health" / "batch=1" / "_SUCCESS").unlink()
    refresh(frames[0], 0)
    assert shown(pages.current_page(spark, str(tmp_path), "txn_hourly_health")) != before["txn_hourly_health"]


def test_an_empty_batch_gives_empty_pages(spark, tmp_path):
    logs = Logs(spark)
    pages.refresh_pages(str(tmp_path), PAGE_DAY)(pages.merged({t: logs.frame(t) for t in pages.PAGE_LOGS}), 0)
    assert pages.current_page(spark, str(tmp_path), "txn_hourly_health").count() == 0
