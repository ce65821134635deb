"""Labels that depend on thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band_flag(
    value: Column,
    center: Column,
    spread: Column,
    k: float = 1.0,
    low: str = "low",
    high: str = "high",
    normal: str = "normal",
    missing: str | None = None,
) -> Column:
    """Label a value against ``center`` ± ``k`` · ``spread``.

    A missing bound leaves the value ``normal``; a missing value is ``missing``
    when that label is given.
    """
    margin = spread if k == 1.0 else F.lit(k) * spread
    flag = F.when(value < center - margin, low).when(value > center + margin, high)
    if missing is not None:
        flag = flag.when(value.isNull(), missing)
    return flag.otherwise(normal)


def grade(value: Column, green: float, yellow: float) -> Column:
    """Traffic light: a missing value is red."""
    return (
        F.when(value >= green, "green").when(value >= yellow, "yellow").otherwise("red")
    )


def is_flagged(flag: Column, *normal: str) -> Column:
    """The flag is none of the normal labels; a missing flag counts as flagged."""
    kept = ~flag.eqNullSafe(F.lit(normal[0]))
    for label in normal[1:]:
        kept = kept & ~flag.eqNullSafe(F.lit(label))
    return kept


def mentions(text: Column, part: str) -> Column:
    """``text`` contains ``part``; a missing text does not."""
    return F.coalesce(text.contains(part), F.lit(False))
