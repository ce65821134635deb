import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from railpulse.functions.flags import band_flag, grade, is_flagged, mentions
from railpulse.functions.measures import (
    clamp, mean_of, median_of, rate, safe_ratio, spread_of, sum_or_zero, sum_where, times,
)
from railpulse.functions.timeparts import hour_label, hour_number, hour_start
from railpulse.operators.columns import round_numbers, select_available, to_long


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def stats(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(
        median_of("x").alias("median"), median_of("x", exact=False).alias("sketch"),
        mean_of("x").alias("mean"), spread_of("x").alias("samp"),
        spread_of("x", "pop").alias("pop"), spread_of("x", "samp", False).alias("builtin"),
    ).first()


def test_median_is_the_lower_discrete_one(spark):
    assert stats(spark, [4.0, 1.0, 3.0, 2.0, None]).median == 2.0
    assert stats(spark, [4.0, 1.0, 3.0, 2.0, None]).sketch == 2.0


def test_spread_of_one_value_and_of_none(spark):
    single, empty = stats(spark, [5.0]), stats(spark, [None])
    assert (single.samp, single.pop, single.mean) == (None, 0.0, 5.0)
    assert (empty.samp, empty.pop, empty.mean, empty.median) == (None, None, None, None)


def test_spread_does_not_depend_on_order(spark):
    for order in ([0.0, 100.0, 100.0, 100.0], [100.0, 0.0, 100.0, 100.0], [100.0] * 3 + [0.0]):
        assert stats(spark, order).samp == 50.0
    assert abs(stats(spark, [1.0, 2.5, 7.0]).samp - stats(spark, [7.0, 1.0, 2.5]).builtin) < 1e-12


def test_rounding_halves(spark):
    assert one(spark, F.round(F.lit(0.125), 2)) == 0.13
    assert one(spark, F.bround(F.lit(0.125), 2)) == 0.12


def test_rates_with_nothing_to_count(spark):
    assert one(spark, rate(F.lit(0), F.lit(0), digits=2)) is None
    assert one(spark, rate(F.lit(0), F.lit(0), digits=2, empty=0.0)) == 0.0
    assert one(spark, rate(F.lit(2), F.lit(3), digits=2)) == 66.67
    assert one(spark, safe_ratio(F.lit(3), F.lit(2))) == 1.5


def test_products_do_not_overflow(spark):
    big = F.lit(10**12)
    assert one(spark, times(big, big)) == 10**24
    odd = [F.lit(n) for n in (200_001, 200_001, 300_007)]
    assert one(spark, times(*odd)) == 200_001 * 200_001 * 300_007
    with pytest.raises(ArithmeticException):
        one(spark, times(big, big, big, big))
    assert one(spark, times(big, F.lit(None).cast("bigint"))) is None


def test_clamp(spark):
    values = [one(spark, clamp(F.lit(v).cast("double"), 0.0, 100.0)) for v in (-1, 50, 101, None)]
    assert values == [0.0, 50.0, 100.0, 0.0]


def test_sums_of_nothing(spark):
    df = spark.createDataFrame([(1, 5)], "k int, x int")
    row = df.agg(
        sum_where(F.col("k") > 1, F.col("x")).alias("none"),
        sum_or_zero(F.when(F.col("k") > 1, F.col("x"))).alias("zero"),
    ).first()
    assert (row.none, row.zero) == (None, 0)


def test_hours(spark):
    df = spark.sql("SELECT timestamp'2024-01-30 05:59:59.9' AS ts")
    row = df.select(
        hour_label("ts").alias("label"), hour_start("ts").cast("string").alias("start"),
        hour_number(hour_label("ts")).alias("n"), hour_number(F.lit("noon")).alias("bad"),
    ).first()
    assert (row.label, row.start, row.n, row.bad) == ("05:00", "2024-01-30 05:00:00", 5, None)


def test_band_flag_labels(spark):
    def flag(value, center, spread, **kw):
        value, center, spread = (F.lit(v).cast("double") for v in (value, center, spread))
        return one(spark, band_flag(value, center, spread, **kw))

    assert flag(7, 10, 2) == "low" and flag(13, 10, 2) == "high"
    assert flag(8, 10, 2) == "normal"  # the bound itself is inside
    assert flag(7, 10, 2, k=2.0) == "normal"
    assert flag(7, 10, None) == "normal" and flag(7, None, None) == "normal"
    assert flag(None, 10, 2) == "normal" and flag(None, 10, 2, missing="No Data") == "No Data"


def test_grade_and_flag_tests(spark):
    assert [one(spark, grade(F.lit(v).cast("double"), 90, 75)) for v in (90, 75, 74.9, None)] == [
        "green", "yellow", "red", "red",
    ]
    labels = [one(spark, is_flagged(F.lit(v), "Normal", "normal")) for v in ("normal", "x", None)]
    assert labels == [False, True, True]
    assert [one(spark, mentions(F.lit(v), "Anomaly")) for v in ("Lower Anomaly ↓", "ok", None)] == [
        True, False, False,
    ]


def test_columns(spark):
    df = spark.createDataFrame([("00:00", 1.005, 2.125, 3)], "hour string, a double, b double, n int")
    assert select_available(df, ["b", "zzz", "hour"]).columns == ["b", "hour"]
    assert round_numbers(df).first().b == 2.12
    long = to_long(df, ["hour"], {"A": "a", "N": "n"}, "series", "value")
    assert sorted(map(tuple, long.collect())) == [("00:00", "A", 1.005), ("00:00", "N", 3.0)]
