"""Exact quantiles, moments and sketches of large groups."""

import math
import random
import statistics as plain
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from railpulse.functions.moments import mean_from, merged_moments, moments, spread_from
from railpulse.functions.timeparts import DayRange
from railpulse.operators.quantiles import exact_quantile
from railpulse.plans import overview, statistics
from railpulse.plans.hourly import bio_hourly_health, txn_hourly_health


def discrete(values, q):
    known = sorted(v for v in values if v is not None)
    return known[max(math.ceil(q * len(known)), 1) - 1] if known else None


KINDS = {
    "bigint": lambda p: p.choice([p.randint(-5, 5), p.randint(-2**63, 2**63 - 1), 2**63 - 1, -2**63]),
    "int": lambda p: p.randint(-2**31, 2**31 - 1),
    "double": lambda p: p.choice([0.0, -1.5, p.gauss(0, 1e300), p.gauss(0, 1e-300), math.inf, -math.inf, p.random()]),
    "decimal(12,3)": lambda p: Decimal(p.randint(-10**11, 10**11)) / 1000,
    "decimal(38,0)": lambda p: Decimal(p.randint(-10**18, 10**18)),
    "date": lambda p: date(1960, 1, 1) + timedelta(days=p.randint(0, 40_000)),
    "timestamp": lambda p: datetime(1950, 1, 1) + timedelta(microseconds=p.randint(0, 10**16)),
}


@pytest.mark.parametrize("kind, q", [*((kind, 0.5) for kind in KINDS), ("bigint", 0.0), ("bigint", 1.0), ("double", 0.9)])
def test_quantiles_of_every_kind(spark, kind, q):
    pick = random.Random(kind)
    rows = [(k, KINDS[kind](pick) if pick.random() < 0.9 else None) for k in ("a", "b", None) for _ in range(pick.randint(1, 60))]
    rows += [("none", None), ("one", KINDS[kind](pick))]
    df = spark.createDataFrame(rows, f"k string, v {kind}")
    found = {r.k: r.m for r in exact_quantile(df, ["k"], "v", q, "m").collect()}
    expected = {k: discrete([v for kk, v in rows if kk == k], q) for k in {k for k, _ in rows}}
    assert found == {k: v for k, v in expected.items() if v is not None}
    assert exact_quantile(df, ["k"], "v", q).schema["v"].dataType == df.schema["v"].dataType


def test_nan_is_above_all_and_clashing_names(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, 1.0)], "digit int, n double")
    assert [tuple(r) for r in exact_quantile(df, ["digit"], "n").collect()] == [(1, 2.0)]
    assert math.isnan(exact_quantile(df, ["digit"], "n", 1.0).first().n)


def test_without_keys_and_without_rows(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("v"))
    assert exact_quantile(df, [], "v").collect() == [(500,)]
    assert exact_quantile(df.where("v < 0"), [], "v").collect() == []
    with pytest.raises(ValueError, match="quantiles"):
        exact_quantile(spark.createDataFrame([("x",)], "v string"), [], "v")


def test_a_group_larger_than_a_task_could_hold(spark):
    """Three million distinct values in one group: no task holds them, the counts that are shuffled stay few."""
    df = spark.range(3_000_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 3_000_017 - 1_000_000).alias("v"))
    assert exact_quantile(df, ["k"], "v").first().v == df.selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").first()[0]
    plan = exact_quantile(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "ObjectHashAggregate" not in plan


def test_moments_in_any_order_and_from_parts(spark):
    pick = random.Random(9)
    values = [pick.randint(-10**9, 10**9) + 10**12 for _ in range(999)]
    rows = [(i % 3, v) for i, v in enumerate(values)] + [(0, None), (7, None), (8, 5), (9, 4), (9, 4), (9, 4)]
    results = set()
    for shuffle in range(3):
        pick.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v bigint").repartition(3 + shuffle)
        whole = df.groupBy("k").agg(*moments(F.col("v"), "v"))
        parts = df.groupBy("k", F.spark_partition_id()).agg(*moments(F.col("v"), "v")).groupBy("k").agg(*merged_moments("v"))
        for sums in (whole, parts):
            out = sums.select("k", mean_from("v"), spread_from("v"), spread_from("v", "pop")).collect()
            results.add(tuple(sorted(map(tuple, out))))
    assert len(results) == 1
    found = {k: rest for k, *rest in results.pop()}
    assert found[7] == [None, None, None] and found[8] == [5.0, None, 0.0] and found[9] == [4.0, 0.0, 0.0]
    for k in range(3):
        mine = [v for kk, v in rows if kk == k and v is not None]
        assert found[k][0] == pytest.approx(plain.mean(mine), rel=1e-15)
        assert found[k][1] == pytest.approx(plain.stdev(mine), rel=1e-12)
        assert found[k][2] == pytest.approx(plain.pstdev(mine), rel=1e-12)


DAY = date(2024, 1, 30)


def test_amount_statistics(logs):
    for i in range(41):
        logs.txn(i, "2024-01-30 08:10:00", amount=i * 100, aggregator="ybl" if i % 2 else None)
    logs.txn(99, "2024-01-30 08:10:00", amount=None, aggregator="ybl")
    found = {r.aggregator: r for r in statistics.amount_statistics(logs.tables(), DayRange(DAY, DAY)).collect()}
    odd, even = [i * 100 for i in range(41) if i % 2], [i * 100 for i in range(41) if not i % 2]
    for name, values in (("ybl", odd), (None, even)):
        row = found[name]
        assert (row.txns, row.median_amount) == (len(values), plain.median_low(values))
        assert row.mean_amount == plain.mean(values) and row.spread_amount == pytest.approx(plain.stdev(values))


def test_users_of_a_day_from_hourly_sketches(spark, logs, tmp_path):
    for i in range(300):
        logs.bio(i, f"2024-01-{29 + i % 2} {i % 24:02}:10:00", client=i % 90)
    logs.bio(999, "2024-01-30 10:00:00", client=None)
    tables, days = logs.tables(), DayRange(date(2024, 1, 29), DAY)
    for _ in range(2):  # written again: replaced
        statistics.write_sketches(statistics.user_sketches(tables, days), f"{tmp_path}/s")
    kept = spark.read.parquet(f"{tmp_path}/s")
    assert kept.count() == len({(r["op_time"].day, r["op_time"].hour) for r in logs.rows["bio_log"] if r["client_id"] is not None})
    assert {r.day.day: r.users for r in statistics.distinct_users(kept).collect()} == {29: 45, 30: 45}
    assert statistics.distinct_users(kept, []).first().users == 90


def test_sketches_of_many_users_are_near(spark):
    many = spark.range(400_000).select((F.col("id") % 24).alias("hour"), (F.col("id") % 150_000).alias("client_id"))
    sketches = many.groupBy("hour").agg(F.hll_sketch_agg("client_id", statistics.SKETCH_BITS).alias("clients"))
    assert statistics.distinct_users(sketches, []).first().users == pytest.approx(150_000, rel=0.03)


def test_coverage_is_observed_while_writing(spark, logs, tmp_path):
    logs.txn(1, "2024-01-30 08:10:00")
    tables = logs.tables()
    for with_bio in (False, True):
        if with_bio:
            tables = logs.bio(2, "2024-01-30 08:10:00").tables()
        txn, bio = txn_hourly_health(tables, DAY), bio_hourly_health(tables, DAY)
        coverage = statistics.Coverage()
        for name, df in zip(("txn", "bio"), coverage.watch(txn, bio)):
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        assert coverage.result(spark).collect() == overview.data_coverage(txn, bio).collect()
