"""Mean and spread of groups of any size from exact sums, the same bits in any order of rows.

Numbers, sums and sums of squares of whole numbers are kept exactly, in 38 digits; such sums are combined map-side and from stored
parts alike. Only the last step is in floating point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railpulse.functions.measures import WHOLE, whole

PARTS = ("n", "sum", "squares")


def moments(value: Column, prefix: str) -> list[Column]:
    """Aggregates ``<prefix>_n``, ``_sum`` and ``_squares`` of a column of whole numbers; NULLs are ignored."""
    number = whole(value)
    return [
        F.count(number).alias(f"{prefix}_n"),
        F.coalesce(F.sum(number), F.lit(0).cast(WHOLE)).alias(f"{prefix}_sum"),
        F.coalesce(F.sum(whole(number * number)), F.lit(0).cast(WHOLE)).alias(f"{prefix}_squares"),
    ]


def merged_moments(prefix: str) -> list[Column]:
    """Aggregates that put stored moments together."""
    return [F.sum(whole(F.col(f"{prefix}_{part}"))).alias(f"{prefix}_{part}") for part in PARTS]


def mean_from(prefix: str) -> Column:
    """NULL for no values."""
    return F.try_divide(F.col(f"{prefix}_sum").cast("double"), F.col(f"{prefix}_n").cast("double"))


def spread_from(prefix: str, kind: str = "samp") -> Column:
    """Standard deviation of the sample (NULL for one value) or of the population (0).

    With q and r the quotient and rest of sum / n, the squares of the deviations add up to
    squares - n q² - 2 q r - r² / n: whole numbers but for the last, which is less than n.
    """
    n, total, squares = (F.col(f"{prefix}_{part}").cast(WHOLE) for part in PARTS)
    quotient = F.when(n > 0, whole(F.floor(F.try_divide(total, n))))
    rest = whole(total - quotient * n)
    # The floor of a decimal quotient may be one off in its last digit: put right here.
    quotient, rest = (
        F.when(rest < 0, quotient - 1).when(rest >= n, quotient + 1).otherwise(quotient),
        F.when(rest < 0, rest + n).when(rest >= n, rest - n).otherwise(rest),
    )
    exact = whole(squares - whole(whole(quotient * quotient) * n) - whole(whole(quotient * rest) * 2))
    off = rest.cast("double") * rest.cast("double") / n.cast("double")
    degrees = n.cast("double") - {"samp": 1, "pop": 0}[kind]
    return F.when(degrees > 0, F.sqrt(F.greatest(exact.cast("double") - off, F.lit(0.0)) / degrees))
