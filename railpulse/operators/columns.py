"""Choosing and naming report columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of ``columns`` that exist, in the given order."""
    return df.select([c for c in columns if c in df.columns])


def round_numbers(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating-point column half to even, as reports do."""
    return df.select(
        [
            F.bround(f.name, digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rename_columns(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns under their report headers."""
    return df.select([F.col(c).alias(header) for c, header in headers.items()])


def to_long(df: DataFrame, keys: Sequence[str], series: Mapping[str, str], name: str, value: str) -> DataFrame:
    """One row per key and series; ``series`` maps a series name to its column."""
    renamed = df.select(*keys, *[F.col(c).cast("double").alias(s) for s, c in series.items()])
    return renamed.unpivot(list(keys), list(series), name, value)
