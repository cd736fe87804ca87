"""Arithmetic that answers NULL, never NaN, infinity or an error.

A missing input or an operation outside its domain has no answer; it must not
turn into a number that later sorts or averages as if it were real.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SESSIONS_PER_YEAR = 252
DAYS_PER_YEAR = 365.25
SHORTEST_SPAN_YEARS = 0.01


def ratio(top, bottom) -> Column:
    """top / bottom, NULL when the bottom is zero (ANSI mode would raise)."""
    return F.col(top) / F.nullif(F.col(bottom), F.lit(0.0)) if isinstance(top, str) \
        else top / F.nullif(bottom, F.lit(0.0))


def change(new: Column, old: Column) -> Column:
    return ratio(new - old, old)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def sqrt_or_null(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def pow_or_null(base: Column, exponent) -> Column:
    return finite(F.pow(base, exponent))


def ln_or_null(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def exp_or_null(x: Column) -> Column:
    return finite(F.exp(x))


def floor_at(x: Column, low: float) -> Column:
    """Larger of x and low, but NULL for a NULL x (greatest() would return low)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def annualised(deviation: Column) -> Column:
    """A per-session standard deviation on a yearly scale."""
    return deviation * F.sqrt(F.lit(float(SESSIONS_PER_YEAR)))


def years_between(first: Column, last: Column) -> Column:
    return F.date_diff(last, first) / F.lit(DAYS_PER_YEAR)


def growth_rate(first_value: Column, last_value: Column,
                first_date: Column, last_date: Column) -> Column:
    """Compound yearly growth between two dated values."""
    span = floor_at(years_between(first_date, last_date), SHORTEST_SPAN_YEARS)
    return pow_or_null(ratio(last_value, first_value), F.lit(1.0) / span) - 1


def compounded(returns: Column) -> Column:
    """Total return of an aggregate or window sum of log growth."""
    return exp_or_null(returns) - 1


def log_growth(r: Column) -> Column:
    return ln_or_null(1 + r)
