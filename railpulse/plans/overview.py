"""Reports on the hourly transaction and authentication frames.

``txn`` and ``bio`` are results of the plans in ``hourly``: at most one row per hour.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.functions.flags import band_flag, grade, is_flagged, mentions
from railpulse.functions.measures import clamp, rate, sum_or_zero
from railpulse.functions.timeparts import hour_number
from railpulse.operators.columns import round_numbers, select_available, to_long
from railpulse.operators.durable import keep
from railpulse.plans import hourly
from railpulse.sources.tables import PaymentTables

# Weights of the overall score and traffic-light limits (green, yellow).
TXN_WEIGHT, BIO_WEIGHT = 0.7, 0.3
OVERALL_LIMITS = (90, 75)
TXN_LIMITS = (95, 85)
BIO_LIMITS = (95, 85)
BASIC_BIO_LIMITS = (90, 80)
AGGREGATOR_LIMITS = (95, 85)

TXN_DETAIL = (
    "hour", "overall_success_rate", "total_amount_cr", "success_txns",
    "ybl_success_rate", "nsdl_success_rate",
)
BIO_DETAIL = (
    "hour", "fa2_rate_yesterday", "nsdl_rate_yesterday", "ybl_rate_yesterday",
    "per_user_rate_yesterday",
)
TXN_SERIES = {
    "YBL": "ybl_success_rate", "NSDL": "nsdl_success_rate", "YBLN": "ybln_success_rate",
}
BIO_SERIES = {"YBL": "ybl_rate_yesterday", "NSDL": "nsdl_rate_yesterday"}


def _stacked(
    txn: DataFrame, bio: DataFrame, columns: dict[str, tuple[str | None, str | None]]
) -> DataFrame:
    """Rows of both frames under common names, so that one aggregation sees both."""

    def part(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            F.lit("txn" if side == 0 else "bio").alias("source"),
            *[
                (F.col(c[side]) if c[side] else F.lit(None)).alias(name)
                for name, c in columns.items()
            ],
        )

    return part(txn, 0).unionByName(part(bio, 1))


def health_score(txn: DataFrame, bio: DataFrame) -> DataFrame:
    """Mean hourly success rates, each within 0..100, and their weighted sum."""
    rates = _stacked(
        txn,
        bio,
        {"txn": ("overall_success_rate", None), "bio": (None, "fa2_rate_yesterday")},
    )
    scores = rates.agg(
        clamp(F.avg("txn"), 0.0, 100.0).alias("txn_score"),
        clamp(F.avg("bio"), 0.0, 100.0).alias("bio_score"),
    )
    overall = F.col("txn_score") * TXN_WEIGHT + F.col("bio_score") * BIO_WEIGHT
    return scores.withColumn("overall_score", overall)


def health_bands(
    txn: DataFrame, bio: DataFrame, bio_limits: tuple[float, float] = BIO_LIMITS
) -> DataFrame:
    """Traffic lights of the scores and of the aggregators' mean rates."""
    rates = _stacked(
        txn,
        bio,
        {
            "txn": ("overall_success_rate", None),
            "bio": (None, "fa2_rate_yesterday"),
            "ybl": ("ybl_success_rate", None),
            "nsdl": ("nsdl_success_rate", None),
            "ybln": ("ybln_success_rate", None),
        },
    )
    scores = rates.agg(
        clamp(F.avg("txn"), 0.0, 100.0).alias("txn"),
        clamp(F.avg("bio"), 0.0, 100.0).alias("bio"),
        *[F.avg(a).alias(a) for a in ("ybl", "nsdl", "ybln")],
    )
    overall = F.col("txn") * TXN_WEIGHT + F.col("bio") * BIO_WEIGHT
    return scores.select(
        grade(overall, *OVERALL_LIMITS).alias("overall_band"),
        grade(F.col("txn"), *TXN_LIMITS).alias("txn_band"),
        grade(F.col("bio"), *bio_limits).alias("bio_band"),
        *[
            grade(F.col(a), *AGGREGATOR_LIMITS).alias(f"{a}_band")
            for a in ("ybl", "nsdl", "ybln")
        ],
    )


def gtv_pace(txn: DataFrame) -> DataFrame:
    """The day's value against the mean hourly median: above 24 of them or below 20."""
    sums = txn.agg(
        sum_or_zero(F.col("total_amount_cr")).cast("double").alias("total_gtv"),
        F.avg("total_amount_cr").alias("avg_gtv_per_hour"),
        F.avg("median_amount_cr").alias("median_gtv"),
    )
    pace = (
        F.when(F.col("total_gtv") > F.col("median_gtv") * 24, "up")
        .when(F.col("total_gtv") < F.col("median_gtv") * 20, "down")
        .otherwise("flat")
    )
    return sums.withColumn("pace", pace)


def anomaly_count(txn: DataFrame, bio: DataFrame, bio_normal: str = "Normal") -> DataFrame:
    """Flagged hours of both frames; an hour without data counts as flagged."""
    flags = _stacked(txn, bio, {"flag": ("success_rate_anomaly", "fa2_succ_flag")})

    def flagged(source: str, normal: str):
        return F.count_if((F.col("source") == source) & is_flagged(F.col("flag"), normal))

    counts = flags.agg(
        flagged("txn", "normal").alias("txn_anomalies"),
        flagged("bio", bio_normal).alias("bio_anomalies"),
    ).withColumn("total_anomalies", F.col("txn_anomalies") + F.col("bio_anomalies"))
    severity = (
        F.when(F.col("total_anomalies") > 5, "red")
        .when(F.col("total_anomalies") > 0, "yellow")
        .otherwise("green")
    )
    return counts.withColumn("severity", severity)


def aggregator_means(txn: DataFrame, bio: DataFrame) -> DataFrame:
    """Mean of the hourly rates per aggregator, not weighted by volume."""
    columns = {
        "avg_ybl_rate": ("ybl_success_rate", None),
        "avg_nsdl_rate": ("nsdl_success_rate", None),
        "avg_ybln_rate": ("ybln_success_rate", None),
        "avg_ybl_bio_rate": (None, "ybl_rate_yesterday"),
        "avg_nsdl_bio_rate": (None, "nsdl_rate_yesterday"),
    }
    return _stacked(txn, bio, columns).agg(*[F.avg(c).alias(c) for c in columns])


def txn_totals(txn: DataFrame) -> DataFrame:
    return txn.agg(
        sum_or_zero(F.col("total_txns")).alias("total_transactions"),
        sum_or_zero(F.col("success_txns")).alias("success_transactions"),
        sum_or_zero(F.col("total_amount_cr")).cast("double").alias("total_gtv"),
        F.avg("total_amount_cr").alias("avg_gtv_per_hour"),
        F.max("hour").alias("last_hour"),
    )


def bio_totals(bio: DataFrame) -> DataFrame:
    return bio.agg(
        sum_or_zero(F.col("total_attempts")).alias("total_bio_attempts"),
        sum_or_zero(F.col("successful_attempts")).alias("successful_bio_attempts"),
    )


def data_coverage(txn: DataFrame, bio: DataFrame) -> DataFrame:
    """Complete when both frames have rows, else Partial."""
    seen = _stacked(txn.limit(1), bio.limit(1), {}).agg(F.count_distinct("source").alias("n"))
    return seen.select(
        F.when(F.col("n") == 2, "Complete").otherwise("Partial").alias("data_coverage")
    )


def hour_range(df: DataFrame, first: int = 0, last: int = 23) -> DataFrame:
    """Rows of the hours from ``first`` to ``last``, both included."""
    return df.where(hour_number(F.col("hour")).between(first, last))


def txn_anomalies(txn: DataFrame) -> DataFrame:
    return txn.where(is_flagged(F.col("success_rate_anomaly"), "normal")).select(
        "hour", "success_rate_anomaly", "overall_success_rate"
    )


def bio_anomalies(bio: DataFrame, keep_no_data: bool = False) -> DataFrame:
    """Flagged authentication hours; the first form of the report also lists missing data."""
    flag = F.col("fa2_succ_flag")
    wanted = is_flagged(flag, "Normal")
    if not keep_no_data:
        wanted = is_flagged(flag, "Normal", "normal") & mentions(flag, "Anomaly")
    return bio.where(wanted).select("hour", "fa2_succ_flag", "fa2_rate_yesterday")


def gtv_anomaly_k(txn: DataFrame, k: float = 2.0) -> DataFrame:
    """Hours whose value leaves mean ± k σ; the stored flag serves where σ is not there."""
    flag = F.col("amount_cr_anomaly")
    if {"avg_amount_cr", "stddev_amount_cr", "total_amount_cr"} <= set(txn.columns):
        flag = band_flag(
            F.col("total_amount_cr"), F.col("avg_amount_cr"), F.col("stddev_amount_cr"), k
        )
    return (
        txn.select("hour", "total_amount_cr", flag.alias("amount_cr_anomaly"))
        .where(is_flagged(F.col("amount_cr_anomaly"), "normal"))
    )


def volume_status(txn: DataFrame) -> DataFrame:
    """Transactions of the last hour against the mean of the hours."""
    volumes = txn.agg(
        F.max("hour").alias("last_hour"),
        F.max_by("total_txns", "hour").alias("current_volume"),
        F.avg(F.col("total_txns").cast("double")).alias("avg_volume"),
    )
    status = (
        F.when(F.col("current_volume") > F.col("avg_volume") * 1.2, "High")
        .when(F.col("current_volume") < F.col("avg_volume") * 0.8, "Low")
        .otherwise("Normal")
    )
    return volumes.withColumn("volume_status", status)


def failed_txns(txn: DataFrame) -> DataFrame:
    failed = F.col("total_txns") - F.col("success_txns")
    return txn.select("hour", "success_txns", failed.alias("failed_txns"))


def failed_summary(txn: DataFrame) -> DataFrame:
    """Totals of successful and failed transactions and their percentages."""
    success, failed = F.col("total_success"), F.col("total_failed")
    return (
        failed_txns(txn)
        .agg(
            sum_or_zero(F.col("success_txns")).alias("total_success"),
            sum_or_zero(F.col("failed_txns")).alias("total_failed"),
        )
        .withColumn("success_pct", rate(success, success + failed, empty=0.0))
        .withColumn("failed_pct", F.lit(100.0) - F.col("success_pct"))
    )


def success_range(txn: DataFrame) -> DataFrame:
    value = "overall_success_rate"
    return txn.agg(
        F.avg(value).alias("avg_success_rate"),
        F.min(value).alias("min_success_rate"),
        F.max(value).alias("max_success_rate"),
    )


def txn_detail(txn: DataFrame) -> DataFrame:
    return round_numbers(select_available(txn, TXN_DETAIL))


def bio_detail(bio: DataFrame) -> DataFrame:
    return round_numbers(select_available(bio, BIO_DETAIL))


def aggregator_long(
    df: DataFrame, series: dict[str, str], show: Sequence[str] = ("YBL", "NSDL", "YBLN")
) -> DataFrame:
    """One row per hour and chosen aggregator."""
    chosen = {name: column for name, column in series.items() if name in show}
    return to_long(df, ["hour"], chosen, "aggregator", "rate")


def current_vs_baseline(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(hour, metric, current, baseline), one row per hour and metric, in one pass."""
    entries = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(now).cast("double").alias("current"),
            F.col(base).cast("double").alias("baseline"),
        )
        for metric, (now, base) in pairs.items()
    ]
    return df.select("hour", F.inline(F.array(*entries)))


HEALTH_PAIRS = {
    "success_rate": ("overall_success_rate", "avg_success_rate"),
    "gtv": ("total_amount_cr", "avg_amount_cr"),
}
MEDIAN_PAIRS = {
    "success_rate": ("overall_success_rate", "median_success_rate"),
    "gtv": ("total_amount_cr", "median_amount_cr"),
    "success_txns": ("success_txns", "median_success_txns"),
}
BIO_PAIRS = {
    "success_rate": ("fa2_rate_yesterday", "median_fa2_succ_rate"),
    "per_user_rate": ("per_user_rate_yesterday", "median_fa2_per_user_rate"),
}


def health_reports(tables: PaymentTables, as_of: date, k: float = 2.0) -> dict[str, DataFrame]:
    """All reports of the health page, the two frames under them computed once."""
    txn = keep(hourly.txn_hourly_health(tables, as_of))
    bio = keep(hourly.bio_hourly_health(tables, as_of))
    return overview_reports(txn, bio, k)


def overview_reports(txn: DataFrame, bio: DataFrame, k: float = 2.0) -> dict[str, DataFrame]:
    """The reports of the health page over two frames at hand."""
    return {
        "health_score": health_score(txn, bio),
        "health_bands": health_bands(txn, bio),
        "txn_totals": txn_totals(txn),
        "bio_totals": bio_totals(bio),
        "aggregator_means": aggregator_means(txn, bio),
        "data_coverage": data_coverage(txn, bio),
        "txn_anomalies": txn_anomalies(txn),
        "bio_anomalies": bio_anomalies(bio),
        "gtv_anomalies": gtv_anomaly_k(txn, k),
        "volume_status": volume_status(txn),
        "failed_txns": failed_txns(txn),
        "failed_summary": failed_summary(txn),
        "success_range": success_range(txn),
        "txn_detail": txn_detail(txn),
        "bio_detail": bio_detail(bio),
        "txn_aggregators": aggregator_long(txn, TXN_SERIES),
        "bio_aggregators": aggregator_long(bio, BIO_SERIES),
        "txn_series": current_vs_baseline(txn, HEALTH_PAIRS),
        "bio_series": current_vs_baseline(bio, BIO_PAIRS),
    }
