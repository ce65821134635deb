from railpulse.plans import overview, states

TXN = (
    "hour string, overall_success_rate double, total_amount_cr double, total_txns bigint,"
    " success_txns bigint, ybl_success_rate double, nsdl_success_rate double,"
    " ybln_success_rate double, avg_success_rate double, stddev_success_rate double,"
    " avg_amount_cr double, stddev_amount_cr double, success_rate_anomaly string,"
    " amount_cr_anomaly string"
)
BIO = (
    "hour string, fa2_rate_yesterday double, nsdl_rate_yesterday double,"
    " ybl_rate_yesterday double, per_user_rate_yesterday double, median_fa2_succ_rate double,"
    " median_fa2_per_user_rate double, total_attempts bigint, successful_attempts bigint,"
    " fa2_succ_flag string"
)
STATES = (
    "final_state string, yesterday_gtv double, yesterday_transactions bigint,"
    " yesterday_success_rate double, median_90d_gtv double, median_90d_success_rate double,"
    " stddev_90d_gtv double, gtv_vs_median_ratio double"
)


def txn(spark, *rows):
    """(hour, rate, gtv, total, success, flag)"""
    return spark.createDataFrame(
        [(h, r, g, n, s, r, r, None, 90.0, 1.0, 10.0, 2.0, f, "normal") for h, r, g, n, s, f in rows],
        TXN,
    )


def bio(spark, *rows):
    """(hour, rate, attempts, successes, flag)"""
    return spark.createDataFrame(
        [(h, r, r, r, 1.0, 80.0, 1.0, a, s, f) for h, r, a, s, f in rows], BIO
    )


def state_rows(spark, *rows):
    """(state, gtv, median, sigma)"""
    return spark.createDataFrame(
        [(n, g, 1, 90.0, m, 90.0, s, g / m if g and m else None) for n, g, m, s in rows], STATES
    )


def some_txn(spark):
    return txn(spark, ("09:00", 98.0, 5.0, 100, 98, "normal"), ("10:00", 80.0, 15.0, 200, 160, "low"))


def some_bio(spark):
    return bio(spark, ("09:00", 91.0, 10, 9, "normal"), ("11:00", None, None, None, "normal"))


def test_health_score(spark):
    row = overview.health_score(some_txn(spark), some_bio(spark)).first()
    assert (row.txn_score, row.bio_score) == (89.0, 91.0)
    assert abs(row.overall_score - 89.6) < 1e-12


def test_score_of_missing_rates_is_zero(spark):
    row = overview.health_score(txn(spark), bio(spark, ("09:00", None, 0, 0, "normal"))).first()
    assert tuple(row) == (0.0, 0.0, 0.0)


def test_bands(spark):
    row = overview.health_bands(some_txn(spark), some_bio(spark)).first()
    assert (row.overall_band, row.txn_band, row.bio_band) == ("yellow", "yellow", "yellow")
    assert (row.ybl_band, row.ybln_band) == ("yellow", "red")
    basic = overview.health_bands(some_txn(spark), some_bio(spark), overview.BASIC_BIO_LIMITS)
    assert basic.first().bio_band == "green"


def test_pace(spark):
    def pace(gtv, median):
        df = spark.createDataFrame([(gtv, median)], "total_amount_cr double, median_amount_cr double")
        return overview.gtv_pace(df).first().pace

    assert [pace(241.0, 10.0), pace(199.0, 10.0), pace(220.0, 10.0), pace(1.0, None)] == [
        "up", "down", "flat", "flat",
    ]


def test_anomaly_count(spark):
    flags = bio(spark, ("01:00", 1.0, 1, 1, "No Data"), ("02:00", 1.0, 1, 1, "Normal"))
    row = overview.anomaly_count(some_txn(spark), flags).first()
    assert tuple(row) == (1, 1, 2, "yellow")


def test_anomaly_lists(spark):
    rows = bio(spark, ("01:00", 1.0, 1, 1, "No Data"), ("02:00", 2.0, 1, 1, "Lower Anomaly ↓"),
               ("03:00", 3.0, 1, 1, "normal"), ("04:00", 4.0, 1, 1, None))
    assert [r.hour for r in overview.bio_anomalies(rows).collect()] == ["02:00"]
    basic = [r.hour for r in overview.bio_anomalies(rows, keep_no_data=True).collect()]
    assert basic == ["01:00", "02:00", "03:00", "04:00"]
    assert [r.hour for r in overview.txn_anomalies(some_txn(spark)).collect()] == ["10:00"]


def test_totals_and_coverage(spark):
    t, b = some_txn(spark), some_bio(spark)
    assert tuple(overview.txn_totals(t).first()) == (300, 258, 20.0, 10.0, "10:00")
    assert tuple(overview.bio_totals(b).first()) == (10, 9)
    assert tuple(overview.txn_totals(txn(spark)).first()) == (0, 0, 0.0, None, None)
    assert overview.data_coverage(t, b).first()[0] == "Complete"
    assert overview.data_coverage(t, bio(spark)).first()[0] == "Partial"
    means = overview.aggregator_means(t, b).first()
    assert (means.avg_ybl_rate, means.avg_ybln_rate, means.avg_nsdl_bio_rate) == (89.0, None, 91.0)


def test_hour_range_is_inclusive(spark):
    t = txn(spark, *[(f"{h:02}:00", 1.0, 1.0, 1, 1, "normal") for h in range(24)])
    assert [r.hour for r in overview.hour_range(t, 9, 11).collect()] == ["09:00", "10:00", "11:00"]
    assert overview.hour_range(t).count() == 24


def test_value_anomalies_by_k(spark):
    t = some_txn(spark)  # mean 10, sigma 2, values 5 and 15
    assert [r.amount_cr_anomaly for r in overview.gtv_anomaly_k(t, 2.0).collect()] == ["low", "high"]
    assert overview.gtv_anomaly_k(t, 3.0).collect() == []
    assert overview.gtv_anomaly_k(t.drop("stddev_amount_cr")).collect() == []


def test_volume_status(spark):
    def status(*volumes):
        rows = [(f"{i:02}:00", 1.0, 1.0, v, v, "normal") for i, v in enumerate(volumes)]
        return overview.volume_status(txn(spark, *rows)).first().volume_status

    assert [status(10, 30), status(30, 10), status(10, 10)] == ["High", "Low", "Normal"]


def test_failures_and_range(spark):
    t = some_txn(spark)
    assert [tuple(r) for r in overview.failed_txns(t).collect()] == [("09:00", 98, 2), ("10:00", 160, 40)]
    assert tuple(overview.failed_summary(t).first()) == (258, 42, 86.0, 14.0)
    assert tuple(overview.failed_summary(txn(spark)).first()) == (0, 0, 0.0, 100.0)
    assert tuple(overview.success_range(t).first()) == (89.0, 80.0, 98.0)


def test_series(spark):
    t = some_txn(spark)
    long = overview.aggregator_long(t, overview.TXN_SERIES, ["YBL", "YBLN"])
    assert {r.aggregator for r in long.collect()} == {"YBL", "YBLN"}
    pairs = overview.current_vs_baseline(t, overview.HEALTH_PAIRS).collect()
    assert ("10:00", "gtv", 15.0, 10.0) in [tuple(r) for r in pairs]
    assert overview.txn_detail(t).columns == list(overview.TXN_DETAIL)
    assert overview.bio_detail(some_bio(spark)).columns == list(overview.BIO_DETAIL)
    assert len(overview.overview_reports(t, some_bio(spark))) == 19


def test_movers(spark):
    df = state_rows(spark, ("a", 2.0, 1.0, 1.0), ("b", 0.5, 0.1, 1.0), ("c", 2.0, 4.0, 1.0),
                    ("d", 3.0, 3.0, 1.0), ("e", 2.4, 2.0, 1.0), ("f", 2.0, None, None))
    up = [tuple(r) for r in states.top_gainers(df).collect()]
    assert up == [("a", 2.0, 1.0, 200.0), ("e", 2.4, 2.0, 120.0)]
    assert [r.final_state for r in states.top_decliners(df).collect()] == ["c"]
    assert len(states.top_gainers(df, 1).collect()) == 1


def test_shares_round_before_they_fold(spark):
    df = state_rows(spark, ("big", 96.004, 1.0, 1.0), ("edge", 1.996, 1.0, 1.0),
                    ("s1", 1.0, 1.0, 1.0), ("s2", 1.0, 1.0, 1.0), ("none", None, 1.0, 1.0))
    rows = {r.final_state: r.percentage for r in states.state_share_others(df).collect()}
    assert rows == {"big": 96.0, "edge": 2.0, "Others (2 states)": 2.0}
    assert states.share_table(df).columns == ["State", "GTV (Cr)", "Share (%)"]


def test_shares_without_small_states(spark):
    df = state_rows(spark, ("a", 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0))
    assert {r.final_state for r in states.state_share_others(df).collect()} == {"a", "b"}


def test_variation_and_threshold(spark):
    df = state_rows(spark, ("up", 2.0, 1.0, 0.5), ("down", 0.5, 1.0, 0.4), ("same", 1.05, 1.0, 0.2),
                    ("zero", 1.0, 0.0, 1.0), ("new", 1.0, None, None))
    sides = {r.final_state: (r.side, r.variation) for r in states.state_variation(df).collect()}
    assert sides == {"up": ("above", 100.0), "down": ("below", -50.0)}
    assert [r.final_state for r in states.above_median(df).collect()] == ["up"]
    assert [r.final_state for r in states.below_median(df).collect()] == ["down"]
    status = {r.final_state: r.status for r in states.state_threshold(df).collect()}
    assert status == {
        "up": "Above 1σ", "down": "Below 1σ", "same": "Normal", "zero": "Normal", "new": "Normal",
    }
    assert [r.final_state for r in states.below_one_sigma(df).collect()] == ["down"]
    assert [r.final_state for r in states.above_one_sigma(df).collect()] == ["up"]


def test_state_filters(spark):
    df = state_rows(spark, ("a", 2.0, 1.0, 1.0), ("b", 0.0, 1.0, 1.0), ("c", None, 1.0, 1.0))
    names = lambda out: [r.final_state for r in out.collect()]
    assert names(states.filter_states(df)) == ["a", "b", "c"]
    assert names(states.filter_states(df, only_active=True)) == ["a"]
    assert names(states.filter_states(df, min_gtv=3.0)) == []
    assert names(states.filter_states(df, min_success=90.0)) == ["a", "b", "c"]
    assert states.state_table(df).columns == list(states.STATE_TABLE_HEADERS.values())
    summary = states.state_summary(df).first()
    assert tuple(summary) == (3, 1, 2.0, 90.0)
    assert names(states.top_states(df, 2)) == ["a", "b"]


def test_state_trends(spark):
    trend = spark.createDataFrame(
        [(d, s, g, 1, 90.0) for s, values in (("a", (1.0, 3.0)), ("b", (5.0, None)), ("c", (1.0, 1.0)))
         for d, g in enumerate(values)],
        "date int, final_state string, gtv double, transactions bigint, success_rate double",
    )
    top = states.top_state_trend(trend, 2)
    assert top.columns == trend.columns
    assert {r.final_state for r in top.collect()} == {"a", "b"} and top.count() == 4
    assert [r[0] for r in states.available_states(trend).collect()] == ["a", "b", "c"]
    detail = states.state_detail(trend, state_rows(spark, ("a", 1.0, 7.0, 1.0)), "a").collect()
    assert [(r.date, r.median_90d_gtv) for r in detail] == [(0, 7.0), (1, 7.0)]
    other = states.state_detail(trend, state_rows(spark, ("a", 1.0, 7.0, 1.0)), "b")
    assert other.first().median_90d_gtv == 0.0
