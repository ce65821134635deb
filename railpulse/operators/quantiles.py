"""Exact quantiles of groups of any size, by refining a histogram.

A value is a number of 64 bits in the order of its kind. Four passes look at 16 bits each: the first counts the rows of every group by their
highest bits and so finds the bits of the wanted value; the next ones count only the rows that begin with the bits found so far.
Counts are combined map-side, so a pass shuffles at most 65,536 rows per group and map task, whatever the group's size; no task
ever holds the values of a group, and the number of passes does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.operators.durable import keep

BITS, PASSES = 16, 4
_LOW = (1 << BITS) - 1
_NAN = 0x7FF8 << 48  # above all numbers


@F.pandas_udf(T.LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    """Doubles, none of them NaN, as whole numbers in the same order; -0.0 is 0.0."""
    bits = (values.to_numpy(np.float64, na_value=0.0) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)).where(values.notna())


@F.pandas_udf(T.DoubleType())
def _double_of(bits: pd.Series) -> pd.Series:
    found = bits.to_numpy(np.int64)
    return pd.Series(np.where(found < 0, found ^ np.int64(0x7FFFFFFFFFFFFFFF), found).view(np.float64))


def _coded(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value), F.lit(_NAN)).otherwise(_ordered_bits(value.cast("double")))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * F.lit(10 ** kind.scale)).cast("bigint")
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return value.cast("bigint")  # an error beyond 64 bits where ANSI mode is on
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_date(value).cast("bigint") if isinstance(kind, T.DateType) else F.unix_micros(value)
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    raise ValueError(f"no quantiles of {kind.simpleString()}")


def _decoded(code: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(code == _NAN, F.lit(float("nan"))).otherwise(_double_of(code)).cast(kind)
    if isinstance(kind, T.DecimalType):
        return (code.cast("decimal(19,0)") / F.lit(10 ** kind.scale)).cast(kind) if kind.scale else code.cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(code.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(code)
    return code.cast(kind)


def _found(counts: DataFrame, names: Sequence[str], rank: Column, prefix: Column) -> DataFrame:
    """Per group: the digit in which the row of ``rank`` lies, put behind ``prefix``, and its rank there."""
    below = Window.partitionBy(*names).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0))).withColumn("rank", rank)
    return ranked.where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n"))).select(
        *names, prefix.alias("prefix"), (F.col("rank") - F.col("below")).alias("rank")
    )


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, name: str | None = None
) -> DataFrame:
    """(keys..., ``name``): the discrete quantile of a column per group, as ``percentile_disc`` has it.

    NULLs are ignored; groups without a value have no row. Keys may be NULL and are one group then. Whole numbers, decimals of up to
    18 digits (or whole ones that fit in 64 bits), floating-point numbers, dates and times. Without ``keys`` all
    rows are one group.
    """
    kind, name = df.schema[value].dataType, name or value
    names = [f"_k{i}" for i in range(len(keys))]
    data = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], _coded(F.col(f"`{value}`"), kind).alias("_code"))
    data = data.where(F.col("_code").isNotNull())
    wanted = F.greatest(F.ceil(F.sum("n").over(Window.partitionBy(*names)) * F.lit(q)), F.lit(1)).cast("bigint")
    counts = data.groupBy(*names, F.shiftright("_code", 64 - BITS).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    found = keep(_found(counts, names, wanted, F.col("digit")))
    for step in range(2, PASSES + 1):
        shift = 64 - step * BITS
        # A row a group: Spark broadcasts it under the session's threshold; beyond, AQE splits a large group.
        known = found.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("prefix").alias("_prefix"), F.col("rank").alias("_rank"))
        same = F.shiftright("_code", shift + BITS) == F.col("_prefix")
        for n in names:
            same &= F.col(n).eqNullSafe(F.col(f"{n}_"))
        digit = F.shiftright("_code", shift).bitwiseAND(F.lit(_LOW))
        counts = data.join(known, same).groupBy(*names, "_prefix", "_rank", digit.alias("digit")).agg(
            F.count(F.lit(1)).alias("n")
        )
        prefix = F.shiftleft("_prefix", BITS).bitwiseOR(F.col("digit"))
        found = keep(_found(counts, names, F.col("_rank"), prefix))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], _decoded(F.col("prefix"), kind).alias(name))
