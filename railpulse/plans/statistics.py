"""Statistics over all transactions of a group, however many there are, and distinct clients from stored sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.moments import mean_from, moments, spread_from
from railpulse.functions.timeparts import DayRange
from railpulse.operators.quantiles import exact_quantile
from railpulse.sources.tables import PaymentTables, scan_days

# 2^15 registers: a standard error of 0.6 percent, 32 KB a sketch at most.
SKETCH_BITS = 15


def amount_statistics(
    tables: PaymentTables, days: DayRange, keys: Sequence[str] = ("aggregator", "master_trans_type")
) -> DataFrame:
    """(keys..., txns, mean_amount, spread_amount, median_amount) of the single requests in ``days``.

    Rows without an amount do not count. No group is held in memory: the mean and spread come from exact
    sums, the median from a refined histogram.
    """
    log = scan_days(tables.txn_requests, "op_time", days).select(*keys, "trans_amt").where(F.col("trans_amt").isNotNull())
    sums = log.groupBy(*keys).agg(*moments(F.col("trans_amt"), "amount"))
    medians = exact_quantile(log, keys, "trans_amt", 0.5, "median_amount").select(
        *[F.col(k).alias(f"_{k}") for k in keys], "median_amount"
    )
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sums.join(medians, same).select(
        *keys, F.col("amount_n").alias("txns"), mean_from("amount").alias("mean_amount"),
        spread_from("amount").alias("spread_amount"), "median_amount",
    )


def user_sketches(tables: PaymentTables, days: DayRange) -> DataFrame:
    """(day, hour, clients) with a mergeable sketch of the distinct clients of every hour of the authentication log."""
    log = scan_days(tables.bio_log, "op_time", days).where(F.col("client_id").isNotNull())
    return log.groupBy(F.to_date("op_time").alias("day"), F.hour("op_time").alias("hour")).agg(
        F.hll_sketch_agg("client_id", SKETCH_BITS).alias("clients")
    )


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Keep sketches by day; days that are written again are replaced."""
    (
        sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").parquet(path)
    )


def distinct_users(sketches: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(keys..., users): about how many distinct clients several hours or days have together, without the log."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("clients")).alias("users"))


class Coverage:
    """Whether both hourly datasets have rows, observed while they are written anyway."""

    def __init__(self):
        self._seen = [Observation("txn"), Observation("bio")]

    def watch(self, txn: DataFrame, bio: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The same frames; write each of them once."""
        rows = F.count(F.lit(1)).alias("rows")
        return txn.observe(self._seen[0], rows), bio.observe(self._seen[1], rows)

    def result(self, spark: SparkSession) -> DataFrame:
        """As ``overview.data_coverage``; waits for the writes, starts no job."""
        complete = all(seen.get["rows"] > 0 for seen in self._seen)
        return spark.range(1).select(F.lit("Complete" if complete else "Partial").alias("data_coverage"))
