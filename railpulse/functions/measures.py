"""Ratios, rates, medians and spreads as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: rupees in a crore.
CRORE = 10_000_000.0


def in_crore(amount: Column) -> Column:
    """Amounts are whole numbers until here, so that sums do not depend on order."""
    return amount.cast("double") / F.lit(CRORE)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is zero or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rate(
    part: Column,
    whole: Column,
    scale: float = 100.0,
    digits: int | None = None,
    empty: float | None = None,
) -> Column:
    """``part / whole * scale``; ``empty`` is the value where ``whole`` is zero."""
    value = safe_ratio(part, whole)
    if scale != 1.0:
        value = value * F.lit(scale)
    if digits is not None:
        value = F.round(value, digits)
    if empty is not None:
        value = F.when(whole > 0, value).otherwise(F.lit(empty))
    return value


# Counts and amounts of copies are whole numbers of up to 38 digits: exact in any order of
# adding, and beyond, in the ANSI mode that ``session.configure`` sets, an error, never a wrong
# or missing number.
WHOLE = "decimal(38,0)"


def whole(value: Column) -> Column:
    return value.cast(WHOLE)


def times(*factors: Column) -> Column:
    """Exact product of counts and amounts."""
    product = whole(factors[0])
    for factor in factors[1:]:
        product = whole(product * whole(factor))
    return product


def sum_where(condition: Column, value: Column) -> Column:
    """NULL where no row of the group qualifies."""
    return F.sum(F.when(condition, value))


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def median_of(column: str, exact: bool = True, accuracy: int = 10_000) -> Column:
    """The lower discrete median of a named column, NULLs ignored.

    The exact form keeps a group's distinct values in memory and is meant for
    groups with a bounded number of them, such as days; ``exact=False`` sketches, and
    ``operators.quantiles.exact_quantile`` is exact for groups of any size.
    """
    if exact:
        return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)")
    return F.percentile_approx(column, 0.5, accuracy)


def _sorted_values(column: str) -> Column:
    return F.array_sort(F.collect_list(F.col(column).cast("double")))


def mean_of(column: str, ordered: bool = True) -> Column:
    """Mean of a named column, NULLs ignored.

    The ordered form adds a group's values in sorted order, so that the last bit,
    and a flag that hangs on it, does not depend on the order in which rows arrive.
    It is meant for groups with a bounded number of values, such as days; ``functions.moments`` has
    exact sums for groups of any size.
    """
    if not ordered:
        return F.avg(F.col(column).cast("double"))  # a decimal's mean would be rounded to four digits
    values = _sorted_values(column)
    total = F.aggregate(values, F.lit(0.0), lambda total, x: total + x)
    return F.try_divide(total, F.size(values))


def spread_of(column: str, kind: str = "samp", ordered: bool = True) -> Column:
    """Standard deviation of the sample (NULL for one value) or of the population (0).

    ``ordered`` as for ``mean_of``.
    """
    if not ordered:
        return {"samp": F.stddev_samp, "pop": F.stddev_pop}[kind](column)
    values = _sorted_values(column)
    # The mean rides along in the accumulator and is computed once per group.
    begin = F.struct(mean_of(column).alias("mean"), F.lit(0.0).alias("squares"))

    def add(state: Column, x: Column) -> Column:
        off = x - state["mean"]
        return F.struct(
            state["mean"].alias("mean"), (state["squares"] + off * off).alias("squares")
        )

    squares = F.aggregate(values, begin, add, lambda state: state["squares"])
    degrees = F.size(values) - {"samp": 1, "pop": 0}[kind]
    return F.when(degrees > 0, F.sqrt(F.try_divide(squares, degrees)))


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` moved into [low, high]; a missing value becomes ``low``."""
    return F.least(F.lit(high), F.greatest(F.lit(low), value))
