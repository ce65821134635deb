"""Pairing the rows of a change log.

A pair of an INSERT and an UPDATE row of one request is only ever counted and
summed, and nothing promises that a request has one of each. The operators here
therefore work on *copies*: equal rows are counted before they are shuffled, and a
join multiplies the counts. A request id that a third of all rows share (a default
value, say) costs one row per map task instead of a quadratic number of pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.functions.measures import times

INSERT, UPDATE = "INSERT", "UPDATE"


def latest_by(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = ()
) -> DataFrame:
    """The latest row per key, all columns kept.

    Spark limits every map task to one row per key before the shuffle
    (WindowGroupLimit), so a hot key does not travel whole.
    """
    recent = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in ties])
    return df.withColumn("_rn", F.row_number().over(recent)).where("_rn = 1").drop("_rn")


def count_copies(
    df: DataFrame,
    keys: Sequence[str],
    copies: str = "copies",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per distinct ``keys`` with the number of rows it stands for."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(copies), *extra)


def cdc_pair(
    log: DataFrame,
    key: str,
    insert_columns: Mapping[str, str],
    update_columns: Mapping[str, str],
    latest_update: str | None = None,
    ties: Sequence[str] = (),
    op_column: str = "op_name",
) -> DataFrame:
    """INSERT rows joined with the UPDATE rows of the same ``key``.

    The column maps go from output name to log column and say which side a value
    is taken from. With ``latest_update`` (a time column) only the latest UPDATE of a
    request takes part, otherwise all do. The result has one row per distinct
    combination and ``copies``, the number of pairs it stands for.
    """
    inserts = log.where(F.col(op_column) == INSERT)
    updates = log.where(F.col(op_column) == UPDATE)
    if latest_update is not None:
        updates = latest_by(updates, [key], latest_update, ties)

    def side(df: DataFrame, columns: Mapping[str, str], copies: str) -> DataFrame:
        picked = df.select(key, *[F.col(c).alias(name) for name, c in columns.items()])
        return count_copies(picked, [key, *columns], copies)

    left = side(inserts, insert_columns, "_inserts")
    right = side(updates, update_columns, "_updates")
    return left.join(right, key).select(
        key,
        *insert_columns,
        *update_columns,
        times(F.col("_inserts"), F.col("_updates")).alias("copies"),
    )


def final_outcome(
    log: DataFrame, key: str, clock: str, success: Column, op_column: str = "op_name"
) -> DataFrame:
    """Per ``key``: the number of INSERT rows and whether the latest UPDATE succeeded.

    One scan, one shuffle and no sort: time and success of an UPDATE are packed
    into one number whose maximum belongs to the latest UPDATE (of two at the same
    microsecond the successful one wins), which hash aggregation combines map-side.
    Keys without both kinds of row have no outcome.
    """
    is_insert = F.col(op_column) == INSERT
    is_update = F.col(op_column) == UPDATE
    succeeded = F.coalesce(success, F.lit(False)).cast("bigint")
    stamped = F.unix_micros(F.col(clock)) * 2 + succeeded
    return (
        log.where(is_insert | is_update)
        .groupBy(key)
        .agg(
            F.count_if(is_insert).alias("inserts"),
            F.max(F.when(is_update, stamped)).alias("_latest"),
        )
        .where((F.col("inserts") > 0) & F.col("_latest").isNotNull())
        .select(key, "inserts", (F.pmod("_latest", F.lit(2)) == 1).alias("succeeded"))
    )
